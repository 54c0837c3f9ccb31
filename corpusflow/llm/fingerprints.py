"""Document fingerprints: a Merkle tree over the paragraphs and sections of every text, in DataFrame functions.

A line is a paragraph.  A section is a run of paragraphs that ends at a blank one or where a paragraph's digest
begins with ``0`` (one in sixteen), so that text put in or taken out moves no section border but those beside it.
A branch is the digest and the length of a paragraph; a section's digest is taken over its branches, the root over
the digests of the sections.  Equal roots mean equal texts; where two trees differ, the first differing section and in it
the first differing paragraph locate the edit without a look at the rest.

Below the paragraphs lie pieces: runs of at most 40 characters that start anew after every ``.``, ``!``, ``?`` and
line break.  A text of under 80 characters has pieces of four characters, or it would have next to none; it is
unlike longer texts.  The fingerprint is the root and the sorted digests (32 bits) of the distinct pieces.  The likeness of two
fingerprints is 1 for equal roots, otherwise the share of both texts' distinct pieces that the other has as well (Dice).

* A null text is an empty one.  An empty text has one empty paragraph and no pieces: it is unlike any other text.
* Texts of the same pieces in another order have different roots and a likeness of 1.
* Very long texts are read whole; the work grows with their length.
* Order is by id, nulls first, then by a digest of the row.  Repeated rows are documents of their own that follow
  each other; the last row is followed by the first, a single row by itself.
* Ids are integers.  Extra columns are not read, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.llm.common import row_key
from corpusflow.operators.corpus import compute_once
from corpusflow.session import materialise

PIECE = r"[^.!?\n]{1,40}[.!?]*|[.!?]+"
SHORT, SHORT_PIECE = 80, r"[^\n]{1,4}"
#: The digest of an empty paragraph.
BLANK = "d41d8cd98f00b204e9800998ecf8427e"
#: Hexadecimal digits of the root and of a piece.
ROOT, DIGITS = 64, 8


def tree(text: Column) -> Column:
    """The branches ``digest:length`` in order, ``,`` between two of a section and ``;`` between sections."""
    branches = F.transform(F.split(text, "\n", -1), lambda p: F.concat(F.md5(p), F.lit(":"), F.length(p)))
    ends = lambda b: F.when(b.startswith("0") | b.startswith(BLANK), ";").otherwise(",")
    joined = F.array_join(F.transform(branches, lambda b: F.concat(b, ends(b))), "")
    return F.regexp_replace(joined, "[,;]$", "")


def sections(branches: Column) -> Column:
    return F.split(branches, ";")


def root(branches: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections(branches), lambda s: F.md5(s)), ""), 256)


def fingerprint(text: Column, branches: Column) -> Column:
    """Root and pieces as one string; ``branches`` is the text's :func:`tree`."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for pattern in (SHORT_PIECE, PIECE)]
    found = F.when(F.length(text) < SHORT, found[0]).otherwise(found[1])
    pieces = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.substring(F.md5(x), 1, DIGITS))))
    return F.concat(root(branches), F.lit(":"), F.array_join(pieces, ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints alone."""
    pieces = [F.regexp_extract_all(F.substr(x, F.lit(ROOT + 2)), F.lit(f".{{{DIGITS}}}"), F.lit(0)) for x in (a, b)]
    both = F.length(a) + F.length(b) - 2 * (ROOT + 1)
    share = 2 * DIGITS * F.size(F.array_intersect(*pieces)) / F.greatest(both, F.lit(1))
    return F.when(F.substring(a, 1, ROOT) == F.substring(b, 1, ROOT), 1.0).otherwise(share)


def _first_difference(a: Column, b: Column) -> Column:
    """The place, from 1, of the first difference of two arrays; 0 for none."""
    return F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")


def edit_start(a: Column, b: Column) -> Column:
    """Characters of the first text before the first paragraph that the second has otherwise; NULL for equal trees."""
    left, right = sections(a), sections(b)
    at = _first_difference(left, right)
    none = F.array().cast("array<string>")
    here = [F.coalesce(F.split(F.get(s, at - 1), ","), none) for s in (left, right)]
    same = F.flatten(F.transform(F.slice(left, F.lit(1), at - 1), lambda s: F.split(s, ",")))
    same = F.concat(same, F.slice(here[0], F.lit(1), _first_difference(*here) - 1))
    chars = F.aggregate(same, F.lit(0).cast("bigint"), lambda n, b: n + F.substring_index(b, ":", -1).cast("bigint") + 1)
    return F.when(at > 0, chars)


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tree`` and ``fingerprint``; columns of these names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = compute_once(docs, "tree", tree(text))
    return compute_once(whole, "fingerprint", fingerprint(text, F.col("tree")))


def in_stretches(docs: DataFrame, id_col: str, text_col: str, stretch_chars: int = 2_000_000, cells: int = 65_536) -> DataFrame:
    """(id, text, key, stretch, again): the documents in stretches of consecutive ids.

    The first row of a stretch is also dealt to the stretch before (``again``), where it follows the last; the first
    stretch counts as the one after the last.  Stretches are runs of cells of equal width between the smallest and the
    largest id, filled up to ``stretch_chars``; only the cells' sizes, at most ``cells`` + 1 rows, are ever in one task.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key("id", "text"))
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    low, high = low or 0, high or 0
    offset = F.col("id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    width = (high - low) // cells + 1
    cell = F.coalesce(F.floor(offset / F.lit(width)).cast("bigint") if width > 1 else offset.cast("bigint"), F.lit(-1))
    place = F.struct("id", "key")
    sizes = rows.groupBy(cell.alias("cell")).agg(F.sum(F.length("text")).alias("chars"), F.min(place).alias("first"))
    sizes = materialise(sizes, "cells")
    before = F.sum("chars").over(Window.orderBy("cell")) - F.col("chars")
    named = sizes.select("cell", F.floor(before / stretch_chars).cast("bigint").alias("stretch"), "first")
    firsts = named.groupBy("stretch").agg(F.min("first").alias("first"))
    last = F.max("stretch").over(Window.partitionBy())
    firsts = firsts.select("stretch", "first", F.coalesce(F.lag("stretch").over(Window.orderBy("stretch")), last).alias("previous"))
    places = named.drop("first").join(firsts, "stretch")
    # at most cells + 1 rows
    dealt = rows.withColumn("cell", cell).join(F.broadcast(places), "cell")
    own = F.struct(F.col("stretch"), F.lit(False).alias("again"))
    other = F.struct(F.col("previous").alias("stretch"), F.lit(True).alias("again"))
    begins = (F.col("key") == F.col("first.key")) & F.col("id").eqNullSafe(F.col("first.id"))
    dealt = dealt.withColumn("at", F.explode(F.when(begins, F.array(own, other)).otherwise(F.array(own))))
    return dealt.select("id", "text", "key", "at.stretch", "at.again")


def with_next(dealt: DataFrame, **taken: Column) -> DataFrame:
    """The rows of :func:`in_stretches` with values of the row that follows."""
    order = Window.partitionBy("stretch").orderBy("again", "id", "key")
    return dealt.withColumns({name: F.lead(value).over(order) for name, value in taken.items()}).where(~F.col("again"))


def tail_replaced(text: Column, other: Column, parts: int = 4) -> Column:
    """The last ``1 / parts`` of the characters replaced by the first as many of another text."""
    n = F.length(text)
    k = F.floor(n / parts).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - k), F.substr(other, F.lit(1), k))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside its edited text (its last quarter taken from the next document) and the next document.

    (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, edit_start)
    """
    dealt = fingerprint_documents(in_stretches(docs, id_col, text_col))
    rows = with_next(dealt, next_text=F.col("text"), next_fingerprint=F.col("fingerprint"))
    rows = compute_once(rows, "edited", tail_replaced(F.col("text"), F.col("next_text")))
    rows = compute_once(rows, "edited_tree", tree(F.col("edited")))
    rows = compute_once(rows, "edited_fingerprint", fingerprint(F.col("edited"), F.col("edited_tree")))
    mine = F.col("fingerprint")
    return rows.select(
        "id", F.length("text").cast("bigint").alias("n_chars"), "edited", "fingerprint", "edited_fingerprint",
        likeness(mine, F.col("edited_fingerprint")).alias("near_edited"), likeness(mine, F.col("next_fingerprint")).alias("near_next"),
        edit_start(F.col("tree"), F.col("edited_tree")).alias("edit_start"),
    )
