"""Column expressions for text cleaning.  All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters a Unicode-aware `\s` stands for, as a Java character-class body.
WHITESPACE = (
    r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_EDGES = rf"\A[{WHITESPACE}]+|[{WHITESPACE}]+\z"

NBSP_ENTITY = "&nbsp;"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def null_to_empty(column: Column | str) -> Column:
    return F.coalesce(_col(column), F.lit(""))


def collapse_whitespace(column: Column | str) -> Column:
    """Every run of Unicode whitespace becomes one space."""
    return F.regexp_replace(_col(column), f"[{WHITESPACE}]+", " ")


def strip(column: Column | str) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone removes only U+0020)."""
    return F.regexp_replace(_col(column), _EDGES, "")


def clean_text(column: Column | str) -> Column:
    """NBSP and ``&nbsp;`` to space, whitespace runs to one space, trimmed; NULL to ``''``."""
    spaced = F.replace(null_to_empty(column), F.lit(NBSP_ENTITY), F.lit(" "))
    return F.trim(collapse_whitespace(spaced))


def delete_prefix(column: Column | str, max_prefix_chars: int | None = None) -> Column:
    """Drop everything up to the first hyphen and strip; NULL to ``''``.

    With ``max_prefix_chars`` only a hyphen within that many leading characters counts as the
    end of a dateline, so a hyphenated word later in the text survives.
    """
    text = null_to_empty(column)
    hyphen = F.locate("-", text)
    # locate() is 0 without a hyphen, and a substring from position 1 is the whole text
    start = hyphen + F.lit(1)
    if max_prefix_chars is not None:
        start = F.when(hyphen <= max_prefix_chars + 1, start).otherwise(F.lit(1))
    return strip(F.substr(text, start))


def text_length(column: Column | str) -> Column:
    """Length in code points."""
    return F.length(_col(column))


def content_digest(column: Column | str) -> Column:
    """32-byte content key: grouping and shuffling by it never moves the text itself."""
    return F.unhex(F.sha2(_col(column), 256))
