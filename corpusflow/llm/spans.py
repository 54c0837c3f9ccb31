"""Repeated runs of consecutive segments (lines, sentences) across all rows, in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.llm.common import packed, row_key, skew_join, unpacked
from corpusflow.session import materialise


def span_table(rows: DataFrame, width: int, digest: Callable[[list[Column]], Column], counts: Callable[[list[Column]], Column]) -> DataFrame:
    """(id, key, pos, span): the digest of every run of ``width`` segments for which ``counts`` holds.

    ``rows`` has id, key and the array ``segments``.
    """

    def span(i: Column) -> Column:
        run = [F.get(F.col("segments"), i + j) for j in range(width)]
        return F.when(counts(run), F.struct(i.alias("pos"), F.unhex(F.md5(digest(run))).alias("span")))

    starts = F.sequence(F.lit(0), F.size("segments") - width)
    runs = F.when(F.size("segments") >= width, F.transform(starts, span))
    return rows.select("id", "key", F.explode(runs).alias("s")).where("s IS NOT NULL").select("id", "key", "s.pos", "s.span")


def later_starts(spans: DataFrame) -> DataFrame:
    """(key, starts): where a row has a span that occurred before, in the order (id, key, pos)."""
    place = F.struct("id", "key", "pos")
    firsts = spans.groupBy("span").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = skew_join(spans, firsts, ["span"], "n").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def uncovered(segments: Column, starts: Column, width: int) -> Column:
    """The segments outside all spans: start positions are merged into runs, the gaps between runs kept."""
    n = F.size(starts)
    heads = F.filter(starts, lambda x, i: (i == 0) | (x - F.get(starts, i - 1) > width))
    tails = F.filter(starts, lambda x, i: (i == n - 1) | (F.get(starts, i + 1) - x > width))
    begin = F.concat(F.array(F.lit(0)), F.transform(tails, lambda x: x + width))
    end = F.concat(heads, F.array(F.size(segments)))
    return F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(segments, a + 1, b - a)))


def cut_repeats(
    docs: DataFrame, id_col: str, text_col: str, width: int, cut: Callable[[Column], Column], glue: str,
    digest: Callable[[list[Column]], Column], counts: Callable[[list[Column]], Column], count_col: str | None,
) -> DataFrame:
    """``docs`` without the segments that a repeated span covers anywhere but at its first place."""
    segments = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), cut(F.col(text_col)).alias("segments")
    )
    spans = materialise(span_table(segments, width, digest, counts), "spans")
    rows = packed(docs, key=row_key(id_col, text_col)).join(later_starts(spans), "key", "left")
    text = F.col("row").getField(text_col)
    some = F.col("starts").isNotNull()
    rows = rows.withColumn("segments", F.when(some, cut(text)))
    rows = rows.withColumn("kept", F.when(some, uncovered(F.col("segments"), F.col("starts"), width)))
    changed = {text_col: F.when(some, F.array_join("kept", glue)).otherwise(text)}
    if count_col:
        changed[count_col] = F.coalesce(F.size("segments") - F.size("kept"), F.lit(0))
    return unpacked(rows, docs.columns, **changed)
