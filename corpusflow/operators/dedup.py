"""Duplicate removal by content digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from corpusflow.functions.text import content_digest
from corpusflow.operators.corpus import concat_sources
from corpusflow.operators.lookup import lookup_join
from corpusflow.session import materialise


def repeated_ids(
    df: DataFrame, within: Sequence[str] = (), text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """The ids of all rows whose text occurs at a lower id.

    The digests are written once, ``(class, digest, id)``, with keys that are never NULL; only texts that occur more
    than once are looked at again.  Few such texts are broadcast, and the digests stay where they are.
    """
    keys = [F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("")).alias(f"_{i}") for i, name in enumerate(within)]
    digest = F.coalesce(content_digest(text), F.lit(bytearray()))
    narrow = materialise(df.select(*keys, digest.alias("_digest"), id_col), "digests")
    on = [*(f"_{i}" for i in range(len(within))), "_digest"]
    firsts = narrow.groupBy(*on).agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return lookup_join(narrow, firsts, on, "inner").where(F.col(id_col) > F.col("_first")).select(id_col)


def drop_duplicate_texts(
    df: DataFrame, within: Sequence[str] = (), text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Keep the first row (lowest id) of every text, per ``within`` group or over everything.

    The ids of the repeated rows, the few, are taken out by an anti join on the unique id, which has
    no hot keys; as long as they are small the text rows stay where they are.  A corpus written
    with :func:`corpusflow.sources.writers.write_bucketed` on the id keeps its text in place in any case.
    """
    return df.join(repeated_ids(df, within, text, id_col), id_col, "left_anti")


def union_distinct(
    frames: Sequence[DataFrame], within: Sequence[str] = (), text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Concatenate, then drop duplicate texts."""
    return drop_duplicate_texts(concat_sources(frames), within, text, id_col)


def class_conflicts(df: DataFrame, label: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Texts that occur in more than one class."""
    narrow = df.select(content_digest(text).alias("_digest"), label, id_col)
    # collapse to one row per (text, class) first: the second step then sees at most one row per class
    per_class = narrow.groupBy("_digest", label).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(id_col).alias("_first")
    )
    return (
        per_class.groupBy("_digest")
        .agg(
            F.min("_first").alias("first_doc_id"),
            F.sum("_rows").alias("n_rows"),
            F.count(F.lit(1)).alias("n_classes"),
            F.array_join(F.sort_array(F.collect_list(label)), ",").alias("classes"),
        )
        .where(F.col("n_classes") > 1)
        .drop("_digest")
    )
