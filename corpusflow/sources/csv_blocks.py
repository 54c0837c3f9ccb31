"""CSV files read block by block: quoted fields may hold line breaks, and one file is still many tasks.

Spark's text source cuts files into blocks at line ends.  Whether a line break ends a record depends on the
quotes before it, all the way from the start of the file.  So a first pass finds for every block how it
ends, inside a quoted field or outside, for either way in which it may begin; a prefix scan over these maps tells how every
block does begin.  The second pass then cuts each block into records on its own, and what lies across block ends is put
together from its pieces.  Records are parsed by Spark.

* A quote opens a field only at its start; doubled quotes inside stand for one; a quote elsewhere is a character.
* Records end with LF or CR LF; a line break inside quotes is kept as it is.  Empty lines are no records.
* Every file begins with a header, which has to begin in its first block.  Compressed files are one block.
* A quoted field that the file does not close reaches to its end; in the strict mode such a record is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

QUOTE, DELIMITER = '"', ","


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted field, or outside at the start of a record, ends inside one."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if inside:
            close = line.find(QUOTE, at)
            while close >= 0 and line[close + 1 : close + 2] == QUOTE:
                close = line.find(QUOTE, close + 2)
            if close < 0:
                return True
            at = line.find(DELIMITER, close + 1) + 1
        elif line.startswith(QUOTE, at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(DELIMITER, at) + 1
        if not at:
            return False
        inside = False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            yield from zip(*[c.to_pylist() for c in batch.slice(at, 1000).columns], strict=True)


def block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, from_outside, from_inside): whether a block ends inside quotes, for either beginning."""
    found: dict[tuple[str, int], list[bool]] = {}
    for file, block, line in _rows(batches):
        ends = found.setdefault((file, block), [False, True])
        ends[0], ends[1] = ends_inside(line, ends[0]), ends_inside(line, ends[1])
    columns = [[k[0] for k in found], [k[1] for k in found], [e[0] for e in found.values()], [e[1] for e in found.values()]]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "from_outside", "from_inside"])


def begin_inside(ends: DataFrame) -> DataFrame:
    """``(file, block)`` of the blocks that begin inside quotes: the blocks' maps composed from the start of each file.

    A map leaves the state as it is, swaps it, or sets it.  After a block the state is that of the last
    block that sets it, or outside, with the swaps since.
    """
    swaps = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    sets = F.col("from_outside") == F.col("from_inside")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    scanned = ends.withColumn("swapped", F.sum(swaps).over(order) % 2)
    base = F.last(F.when(sets, (F.col("from_outside").cast("int") + F.col("swapped")) % 2), ignorenulls=True).over(order)
    scanned = scanned.withColumn("inside", (F.coalesce(base, F.lit(0)) + F.col("swapped")) % 2)
    before = F.lag("inside", 1, 0).over(Window.partitionBy("file").orderBy("block"))
    return scanned.withColumn("before", before).where("before = 1").select("file", "block")


def _records(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """(file, block, row, opened, closed, header, record): records, and pieces of those that cross block ends."""
    carried = lines.sparkSession.sparkContext.broadcast(inside)
    names = ["file", "block", "row", "opened", "closed", "header", "record"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = carried.value
        place, within, opened, header, number = None, False, True, False, 0
        parts: list[str] = []
        out: list[tuple] = []

        def put(closed: bool) -> None:
            nonlocal parts, opened, header, number
            text = "\n".join(parts)
            if closed:
                text = text.removesuffix("\r")
            if text or not (opened and closed):
                if not (header and opened and closed):
                    out.append((*place, number, opened, closed, header and opened, text))
                header = header and not opened
                number += 1
            parts, opened = [], True

        for file, block, line in _rows(batches):
            if (file, block) != place:
                if parts:
                    put(False)
                place, within, number, header = (file, block), (file, block) in begins, 0, block == 0
                opened = not within
            parts.append(line)
            within = ends_inside(line, within)
            if not within:
                put(True)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if parts:
            put(False)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return lines.mapInArrow(cut, "file string, block bigint, row bigint, opened boolean, closed boolean, header boolean, record string")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records put together from their pieces, at the place where they begin."""
    so_far = Window.partitionBy("file").orderBy("block", "opened").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.last(F.when(F.col("opened"), F.struct("block", "row", "header")), ignorenulls=True).over(so_far)
    whole = pieces.withColumn("begin", begin).groupBy("file", "begin").agg(
        F.array_sort(F.collect_list(F.struct("block", ~F.col("opened"), "record"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return whole.where("NOT begin.header").select("file", "begin.block", "begin.row", text.alias("record"))


def read_csv_blocks(spark: SparkSession, path: str, schema: StructType | str, options: dict) -> DataFrame:
    """The records of CSV files with a header, as columns of ``schema``, and their places ``_file``, ``_block``, ``_row``.

    The files are read three times.  What is broadcast is an entry for each block of the input that begins inside
    quotes, a block being as large as ``spark.sql.files.maxPartitionBytes``; keep that setting until the result is written.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = _lines(spark, path)
    ends = lines.mapInArrow(block_ends, "file string, block bigint, from_outside boolean, from_inside boolean")
    inside = {(row["file"], row["block"]) for row in begin_inside(ends).collect()}
    cut = _records(lines, inside)
    whole = cut.where("opened AND closed").select("file", "block", "row", "record")
    rows = whole.unionByName(_stitched(cut.where("NOT (opened AND closed)"))) if inside else whole
    kept = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k != "header"}
    parsed = rows.select(F.from_csv("record", fields.toDDL(), kept).alias("r"), F.col("file").alias("_file"), F.col("block").alias("_block"), F.col("row").alias("_row"))
    return parsed.select("r.*", "_file", "_block", "_row")
