"""Label names and ids: one dimension table for every labelling scheme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusflow.operators.lookup import lookup_join
from corpusflow.session import materialise

# Label -> id per scheme.
SCHEMES = {
    "neural_news": {"real": 0, "neural": 1},
    "binary": {"human": 0, "neural": 1},
    "source": {"true": 0, "fake": 1, "neural": 2},
    "classifier": {"real": 0, "fake": 1, "neural": 2},
}


def label_dim(spark: SparkSession) -> DataFrame:
    """``(scheme, label, label_id)`` for the fixed schemes."""
    rows = ", ".join(
        f"('{scheme}', '{label}', {label_id})"
        for scheme, mapping in SCHEMES.items()
        for label, label_id in mapping.items()
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(scheme, label, label_id)")


def alphabetical_scheme(df: DataFrame, column: str, scheme: str = "alphabetical") -> DataFrame:
    """Distinct labels numbered from 0 in sorted order, as a label dimension.

    The distinct labels are sorted once, in ranges; a label's number is its place in its range plus
    the sizes of the ranges before.  Any number of labels will do.
    """
    labels = df.select(F.col(column).alias("label")).where("label is not null").distinct().orderBy("label")
    # partition and row number in one: rising in the sorted order
    placed = labels.select("label", F.monotonically_increasing_id().alias("_place"))
    placed = materialise(placed.withColumn("_range", F.shiftright("_place", 33)), "labels")
    # one row per range, as many as the sort had partitions
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(1))
    before = Window.partitionBy("_all").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sizes.select("_range", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    row = F.col("_place").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(offsets), "_range").select(
        F.lit(scheme).alias("scheme"), "label", (F.col("_before") + row).cast("int").alias("label_id")
    )


def add_label_id(
    df: DataFrame,
    dim: DataFrame,
    scheme: str,
    column: str = "source",
    out: str = "label_id",
    on_unknown: str = "error",
) -> DataFrame:
    """Attach the id of a label name.  ``on_unknown``: ``"error"`` fails the job, ``"null"`` leaves NULL."""
    if on_unknown not in ("error", "null"):
        raise ValueError("on_unknown must be 'error' or 'null'")
    names = dim.where(F.col("scheme") == scheme).select(
        F.col("label").alias(column), F.col("label_id").cast("int").alias(out)
    )
    joined = lookup_join(df, names, column)
    if on_unknown == "error":
        message = F.concat(F.lit("unknown label: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL")))
        joined = joined.withColumn(out, F.coalesce(F.col(out), F.raise_error(message).cast("int")))
    return joined.select(*df.columns, out)


def add_label_name(
    df: DataFrame, dim: DataFrame, scheme: str, column: str = "prediction", out: str = "label"
) -> DataFrame:
    """Attach the name of a label id."""
    names = dim.where(F.col("scheme") == scheme).select(F.col("label_id").alias(column), F.col("label").alias(out))
    return lookup_join(df, names, column).select(*df.columns, out)


def normalize_label(column: Column | str) -> Column:
    """``real`` becomes ``human``; every other label stays."""
    label = F.col(column) if isinstance(column, str) else column
    return F.when(label == "real", F.lit("human")).otherwise(label)
