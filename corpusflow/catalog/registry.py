"""All registered queries."""

from __future__ import annotations

from corpusflow.catalog import checked, cleaning, evaluation, learning, sampling, vocabulary  # noqa: F401 - they register
from corpusflow.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
