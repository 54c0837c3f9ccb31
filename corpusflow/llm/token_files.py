"""Token counts from flat token files that have no index.

A file is a plain run of fixed-width token ids; a document ends at the end-of-document id.  Files are cut
into blocks of bytes that tasks read and search on their own, whole blocks at a time in numpy.  A document
that crosses blocks is stitched by a prefix scan: where the last separator before a block lies, and how
many documents ended before it, come from running values over the blocks of the file.

* Two separators in a row are an empty document (0 tokens); an empty file holds no document.
* Tokens after the last separator are one more document, marked ``ended = false``.
* A file whose size is not a multiple of the token width is an error.
* Null and empty texts are written as empty documents.  Repeated rows are separate documents; a null id stays null.
* Documents of a file lie in the order of the task's rows.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusflow.llm.pieces import encode_texts

WIDTH = 2
# The end id 2 as two little-endian bytes is plain text, so Spark's text writer can put it after each row.
END_ID = 2
SEPARATOR = "\x02\x00"


def write_token_files(docs: DataFrame, path: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Flat 16-bit token files in ``path/kind=tokens``, one a task, each document followed by the end id.

    Nothing is shuffled.  Beside each token file the task writes its documents' places and ids in
    ``path/kind=ids``, under the same file number; :func:`placed_ids` reads them.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number within its task
    rows = docs.select(place.alias("place"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rows = encode_texts(rows, model, width=WIDTH).drop("text")
    tokens = F.struct(F.lit("tokens").alias("kind"), F.col("ids").cast("string").alias("value"))  # the bytes as they are
    ids = F.struct(F.lit("ids").alias("kind"), F.concat_ws(",", F.col("place").cast("string"), "id").alias("value"))
    both = rows.select("place", F.explode(F.array(tokens, ids)).alias("out")).select("place", "out.*")
    ordered = both.sortWithinPartitions("kind", "place").select("kind", "value")
    ordered.write.partitionBy("kind").option("lineSep", SEPARATOR).option("compression", "none").text(path)


def file_number(path: Column) -> Column:
    return F.regexp_extract(path, "part-([0-9]+)", 1).cast("bigint")


def placed_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(number, doc, id): which document lies at which place of which token file."""
    rows = spark.read.option("lineSep", SEPARATOR).schema("value string, kind string").text(path).where("kind = 'ids'")
    cut = F.split("value", ",", 2)
    return rows.select(
        file_number(F.col("_metadata.file_name")).alias("number"), cut[0].cast("bigint").alias("doc"), F.get(cut, 1).cast(id_type).alias("id")
    )


def _scan(width: int, end_id: int, block_bytes: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for path, at in zip(batch["path"], batch["at"], strict=True):
                uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as file:
                    ids = np.frombuffer(file.read_at(block_bytes, at), f"<u{width}")
                found = np.flatnonzero(ids == end_id)
                first, last = (int(found[0]), int(found[-1])) if len(found) else (None, None)
                out.append((path, at // width, first, last, (np.diff(found) - 1).tolist()))
            yield pd.DataFrame(out, columns=["path", "begin", "first", "last", "inner"]).astype({"first": "Int64", "last": "Int64"})

    return scan


def scan_token_files(
    spark: SparkSession, path: str, width: int = WIDTH, end_id: int = END_ID, block_bytes: int = 1 << 20, within: str = ""
) -> DataFrame:
    """(path, doc, start, n_tokens, ended): one row a document, numbered from 0 in each file.

    Reads the files at any depth below ``path`` whose path holds ``within``.
    """
    if block_bytes % width:
        raise ValueError("a block must hold whole tokens")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.where(F.col("path").contains(within))
    odd = F.raise_error(F.concat(F.lit("not whole tokens: "), F.col("path")))
    files = files.select("path", F.when(F.col("length") % width == 0, F.col("length")).otherwise(odd.cast("bigint")).alias("length")).where("length > 0")
    blocks = files.select("path", F.explode(F.expr(f"sequence(0L, length - 1, {block_bytes}L)")).alias("at"))
    found = blocks.repartition("path", "at").mapInPandas(
        _scan(width, end_id, block_bytes), "path string, begin bigint, first bigint, last bigint, inner array<int>"
    )
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ends_here = F.when(F.col("first").isNotNull(), F.size("inner") + 1).otherwise(0)
    stitched = found.select(
        "*",
        F.coalesce(F.max(F.col("begin") + F.col("last")).over(before) + 1, F.lit(0)).alias("open"),
        F.coalesce(F.sum(ends_here).over(before), F.lit(0)).alias("docs"),
    ).where(F.col("first").isNotNull())
    lengths = F.concat(F.array(F.col("begin") + F.col("first") - F.col("open")), F.col("inner").cast("array<bigint>"))
    docs = stitched.select("path", "docs", "begin", "first", "open", F.posexplode(lengths).alias("i", "n_tokens"), "inner")
    before_it = F.aggregate(F.slice("inner", 1, F.greatest(F.col("i") - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x + 1)
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("begin") + F.col("first") + 1 + before_it)
    ended = docs.select("path", (F.col("docs") + F.col("i")).alias("doc"), start.alias("start"), "n_tokens", F.lit(True).alias("ended"))
    ends = found.groupBy("path").agg(F.max(F.col("begin") + F.col("last")).alias("last"), F.sum(ends_here).alias("doc"))
    tail = F.coalesce(F.col("last") + 1, F.lit(0))
    rest = files.join(ends, "path").select(
        "path", "doc", tail.alias("start"), (F.col("length") / width - tail).cast("bigint").alias("n_tokens"), F.lit(False).alias("ended")
    )
    return ended.unionByName(rest.where("n_tokens > 0"))
