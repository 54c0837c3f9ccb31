"""Readers.  Every schema is explicit; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusflow.sources.csv_blocks import read_csv_blocks

TEXT_SCHEMA = StructType([StructField("text", StringType())])

# Quotes are doubled inside quoted fields; fields may span lines and keep their outer blanks.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "mode": "FAILFAST",
}


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV files with header, a task per file: quoted fields with line breaks keep a file in one split.
    Large files are for :func:`read_csv_parallel`, or for :func:`ingest_csv`, once, and Parquet from there on."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_csv_parallel(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of :func:`read_csv`, from as many tasks as the files have blocks."""
    return read_csv_blocks(spark, path, schema, CSV_OPTIONS).drop("_file", "_block", "_row")


def read_optional_csv(spark: SparkSession, path: str | None, schema: StructType | str = TEXT_SCHEMA) -> DataFrame:
    """No path gives an empty table of the same schema."""
    if path:
        return read_csv(spark, path, schema)
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def ingest_csv(
    spark: SparkSession, path: str, table_path: str, schema: StructType | str = TEXT_SCHEMA, source_no: int = 0
) -> DataFrame:
    """Turn CSV into Parquet once and give every row its permanent ``doc_id``.

    Ids grow by file path and then by the row's place in its file, so "keep first" later means what it
    says; one sort does that, once.  ``source_no`` (0 to 31) keeps the ids of several inputs apart and
    in that order.  They are fixed by being written; the returned table reads the Parquet, never
    the CSV again.
    """
    if not 0 <= source_no < 32:
        raise ValueError("source_no must be 0 to 31")
    number = F.lit(source_no << 58).cast("bigint") + F.monotonically_increasing_id()
    # Spark packs blocks into tasks by size: neither tasks nor their rows come in the order of paths
    placed = read_csv_blocks(spark, path, schema, CSV_OPTIONS).orderBy("_file", "_block", "_row")
    columns = [c for c in placed.columns if c not in ("_file", "_block", "_row")]
    rows = placed.select(*columns, number.alias("doc_id"))
    rows.write.mode("errorifexists").parquet(table_path)
    return spark.read.parquet(table_path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; ``split=...`` folders become the partition column ``split``."""
    return spark.read.parquet(path)


def read_corpus(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A Parquet corpus for text work.

    A file with one row group is one task.  Where the scan yields fewer tasks than there are cores,
    the rows are spread by id; a large table has splits enough and is left as it is.  Filters and
    column pruning still reach the scan.
    """
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, id_col) if rows.rdd.getNumPartitions() < cores else rows


def read_split(spark: SparkSession, path: str, split: str, variant: str | None = None) -> DataFrame:
    """One named split (and variant).  Only its folder is listed and read."""
    rows = read_table(spark, path).where(F.col("split") == split)
    return rows.where(F.col("variant") == variant) if variant is not None else rows


def has_split(df: DataFrame, split: str) -> bool:
    return not df.where(F.col("split") == split).isEmpty()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``value``."""
    return spark.read.option("lineSep", "\n").text(path)


def read_results(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
