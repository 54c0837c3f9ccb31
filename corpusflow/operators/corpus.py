"""Row-wise corpus steps: filters, tags and projections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions import text as tx

MIN_LENGTH = 750
MAX_LENGTH = 5000


def compute_once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``withColumn`` for an expensive expression that later steps use several times.

    The optimizer repeats a projected expression wherever it is used (a filter on the length of a
    cleaned text would clean it again, even below the scan's repartitioning).  The output of a
    generator is a plain column, so the expression runs once per row.
    """
    return df.withColumn(column, F.explode(F.array(value)))


def clean_column(df: DataFrame, column: str = "text") -> DataFrame:
    return compute_once(df, column, tx.clean_text(column))


def cut_dateline(df: DataFrame, column: str = "text", max_prefix_chars: int | None = None) -> DataFrame:
    """Prefix cut, then cleaning: the order used for wire reports."""
    return compute_once(df, column, tx.clean_text(tx.delete_prefix(column, max_prefix_chars)))


def keep_language(df: DataFrame, language: str = "en", column: str = "lang", body: str | None = None) -> DataFrame:
    """Rows in one language; with ``body`` also only rows that have a text at all."""
    kept = df.where(F.col(column) == language)
    return kept.where(F.col(body).isNotNull()) if body else kept


def keep_class(df: DataFrame, label, column: str = "source") -> DataFrame:
    return df.where(F.col(column) == F.lit(label))


def tag_source(df: DataFrame, source: str, column: str = "source") -> DataFrame:
    return df.withColumn(column, F.lit(source))


def add_length(df: DataFrame, column: str = "text", out: str = "length") -> DataFrame:
    return df.withColumn(out, tx.text_length(column))


def keep_lengths(
    df: DataFrame, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, column: str = "length"
) -> DataFrame:
    """Inclusive at both ends."""
    return df.where(F.col(column).between(min_length, max_length))


def drop_empty_texts(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows without text carry nothing to featurise; see :func:`count_empty_texts`."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def count_empty_texts(df: DataFrame, column: str = "text") -> DataFrame:
    empty = F.col(column).isNull() | (F.col(column) == "")
    return df.agg(F.count_if(empty).alias("dropped"), F.count_if(~empty).alias("kept"))


def corpus_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Stripped lines of a line corpus without blanks and ``=`` headings."""
    kept = compute_once(df, "text", tx.strip(column)).where((F.col("text") != "") & ~F.startswith("text", F.lit("=")))
    return kept if column == "text" else kept.drop(column)


def concat_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs; a column one input lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def rows_per(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows"))


def corpus_summary(df: DataFrame, column: str = "source") -> DataFrame:
    """Rows and total text length per class."""
    return df.groupBy(column).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("length").cast("bigint")).alias("total_length")
    )
