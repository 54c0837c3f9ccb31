"""Exploration tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HISTOGRAM_BINS = 40


def length_histogram(df: DataFrame, column: str = "length", label: str = "source", bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between each class's own minimum and maximum; the last bin is closed.

    Values are counted per (class, length) first, so the corpus is read once and everything after
    that works on distinct lengths.  Empty bins are listed with 0.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(label, F.col(column).cast("bigint").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ends = counts.groupBy(label).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    # a class with a single value is drawn half a unit to either side
    low = F.when(span == 0, F.col("_lo") - 0.5).otherwise(F.col("_lo").cast("double"))
    width = F.when(span == 0, F.lit(1.0)).otherwise(span.cast("double")) / bins
    position = F.floor(F.try_divide((F.col("_v") - F.col("_lo")) * bins, span))
    bin_no = F.when(span == 0, F.lit(bins // 2)).otherwise(F.least(position, F.lit(bins - 1))).cast("int")
    filled = counts.join(ends, label).withColumn("bin", bin_no).groupBy(label, "bin").agg(F.sum("_n").alias("_n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(filled, [label, "bin"], "left").select(
        label,
        "bin",
        (low + width * F.col("bin")).alias("bin_start"),
        F.coalesce("_n", F.lit(0)).alias("n_rows"),
    )


def cluster_source_counts(df: DataFrame, cluster: str = "cluster", source: str = "source") -> DataFrame:
    return df.groupBy(cluster, source).agg(F.count(F.lit(1)).alias("n_rows"))
