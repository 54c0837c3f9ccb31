"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": '""',
}


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple = ()) -> None:
    """The prepared corpus, as Parquet (default) or CSV."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(**CSV_OPTIONS).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")


def write_bucketed(df: DataFrame, table: str, buckets: int, id_col: str = "doc_id", path: str | None = None) -> None:
    """The corpus as a table bucketed and sorted by id.

    Joins on the id (duplicate removal, up-sampling) then read the text where it lies; only the
    other, narrow side is shuffled.
    """
    writer = df.repartition(buckets, id_col).write.bucketBy(buckets, id_col).sortBy(id_col).format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_lines(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(column).write.mode("errorifexists").text(path)


def write_submissions(df: DataFrame, path: str) -> None:
    """Tab-separated ``index, prediction`` files, one folder per ``output_name``, in index order.

    Rows are range-partitioned by output and index: a small test set becomes one file, a large one
    several files that follow each other, never one task.
    """
    rows = df.select("output_name", "index", "prediction").repartitionByRange("output_name", "index")
    rows.sortWithinPartitions("output_name", "index").write.mode("errorifexists").partitionBy("output_name").option(
        "sep", "\t"
    ).option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
