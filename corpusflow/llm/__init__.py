"""Corpus operators for training data: one module each, and their registered queries in ``catalog``.

Nothing outside this subpackage imports it.
"""
