"""Column expressions that turn text into words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Word-or-punctuation split, and words of two or more letters, digits, underscores.
WORD_OR_PUNCTUATION = r"(?U)\w+|[^\w\s]+"
TERM = r"[\p{L}\p{N}_]{2,}"
# Bytes of text that a Python worker turns into objects at a time.
SLICE_BYTES = 4_000_000


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def slices(batch: pa.Array, limit: int) -> Iterator[pa.Array]:
    """The batch in runs of rows with at most ``limit`` bytes of text, or list entries, each; a longer row is alone.

    An Arrow batch is bounded by rows: what a worker makes from it would grow with the length of the rows.
    """
    measure = pc.binary_length if pa.types.is_string(batch.type) or pa.types.is_large_string(batch.type) else pc.list_value_length
    ends = np.cumsum(pc.fill_null(measure(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        room = limit + (ends[begin - 1] if begin else 0)
        end = max(begin + 1, int(np.searchsorted(ends, room, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _compatibility_pattern() -> str:
    """Regex for characters that NFKC might touch.

    Below U+0300 there are no combining marks, so a character changes the result only if its own
    NFKC form differs; those are listed as ranges.  Everything from U+0300 on may matter.  The
    intersection rejects ASCII before the list is looked at.
    """
    changing = [c for c in range(0x300) if unicodedata.normalize("NFKC", chr(c)) != chr(c)] + [0x300]
    ranges: list[list[int]] = []
    for c in changing:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    ranges[-1][1] = 0x10FFFF
    listed = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges)
    return rf"[\x{{{changing[0]:x}}}-\x{{10ffff}}&&[{listed}]]"


NFKC_CANDIDATE = _compatibility_pattern()


@F.arrow_udf(StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for part in slices(batch, SLICE_BYTES):
            yield pa.array([t and unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string())


def nfkc(column: Column | str) -> Column:
    """Unicode NFKC.  Rows that cannot change are sent to Python as NULL and keep their text."""
    text = _col(column)
    return F.coalesce(_nfkc(F.when(text.rlike(NFKC_CANDIDATE), text)), text)


def words(column: Column | str, normalise: bool = True, special_tokens: Sequence[str] = ()) -> Column:
    """Array of words and punctuation runs, in order.

    ``special_tokens`` that the text spells out are kept in one piece.
    """
    text = nfkc(column) if normalise else _col(column)
    pattern = WORD_OR_PUNCTUATION
    if special_tokens:
        spelled = "|".join(re.escape(token) for token in special_tokens)
        pattern = rf"(?U){spelled}|\w+|(?:(?!{spelled})[^\w\s])+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def terms(column: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-cased terms of two or more characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(_col(column)), F.lit(TERM), F.lit(0))
    if stop_words:
        # array_except would also drop repeats, so filter
        found = F.filter(found, lambda t: ~t.isin(list(stop_words)))
    return found


# The blocks of ideographs that are words of their own.
IDEOGRAPHS = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
# ASCII marks count as punctuation whatever their Unicode category
_MARKS = r"!-/:-@\[-`{-~"
_REMOVED_ASCII = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_UNCASED_WORD = rf"[{_MARKS}]|[^\s{_MARKS}]+"


def uncased_character(c: str, spaced: bool = False) -> str:
    """What one character becomes in uncased text.

    Controls and formats go, white space becomes a blank, ideographs stand between blanks, everything else is
    decomposed, loses its accents and is lowered.  ``spaced`` puts punctuation between blanks as well.
    """
    if c in "\t\n\r":
        return " "
    category = unicodedata.category(c)
    if c == "\ufffd" or category in ("Cc", "Cf", "Co"):
        return ""
    if c.isspace():
        return " "
    # letter by letter: a final sigma is not known at its place
    out = "".join(x.lower() for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    if spaced:
        out = "".join(f" {x} " if _is_mark(x) else x for x in out)
    return f" {out} " if any(low <= ord(c) <= high for low, high in IDEOGRAPHS) else out


def _is_mark(c: str) -> bool:
    return ("!" <= c <= "~" and not c.isalnum()) or unicodedata.category(c)[0] == "P"


def _uncased_udf(spaced: bool, special_tokens: tuple[str, ...]):
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        class Table(dict):
            def __missing__(self, code: int) -> str:
                self[code] = found = uncased_character(chr(code), spaced)
                return found

        table = Table()
        kept = re.compile("(" + "|".join(re.escape(t) for t in special_tokens) + ")") if special_tokens else None

        def change(text: str | None) -> str | None:
            if text is None or kept is None:
                return text and text.translate(table)
            parts = kept.split(text)  # special tokens at odd places
            return "".join(f" {part} " if i % 2 else part.translate(table) for i, part in enumerate(parts))

        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                yield pa.array([change(t) for t in part.to_pylist()], pa.string())

    return run


def uncased(column: Column | str, spaced: bool = False, special_tokens: Sequence[str] = ()) -> Column:
    """Lower-case text without accents and control characters, ideographs between blanks.

    ASCII texts never leave the JVM; only others, and those that spell out a special token, go to Python,
    character by character through a table.
    """
    text = _col(column)
    plain = F.lower(F.translate(F.regexp_replace(text, _REMOVED_ASCII, ""), "\t\n\r", "   "))
    spelled = "|".join(["[^\\x00-\\x7F]", *(re.escape(t) for t in special_tokens)])
    changed = _uncased_udf(spaced, tuple(special_tokens))(F.when(text.rlike(spelled), text))
    return F.coalesce(changed, plain)


def uncased_words(column: Column | str, special_tokens: Sequence[str] = ()) -> Column:
    """Words of uncased text: every punctuation mark and every ideograph is one, and so is a spelled special token.

    Special tokens hold capitals or marks, which uncased words cannot.
    """
    spelled = "".join(re.escape(token) + "|" for token in special_tokens)
    return F.regexp_extract_all(uncased(column, True, special_tokens), F.lit(spelled + _UNCASED_WORD), F.lit(0))
