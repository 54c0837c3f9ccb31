"""Seeded shuffles, exact samples, class balancing and stratified splits.

Every choice depends only on ``md5(seed:doc_id)``, never on partitioning, so a rerun on another
cluster gives the same rows.  Quotas are met exactly without ranking the corpus: the hash value at
the wanted rank of each class is looked up first (a histogram over hash prefixes finds the one
prefix the rank falls in, only that sliver is ordered), and the corpus itself is then filtered by
comparing hashes.  Text rows are never shuffled as long as the table of classes is small enough to broadcast.

Classes, their sizes, quotas and cut points are tables like any other: there may be as many classes as rows.
Rows without a class are a class of their own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.operators.corpus import concat_sources, keep_class
from corpusflow.operators.lookup import BROADCAST_ROWS, counted_join
from corpusflow.session import materialise

SEED = 42
# rows one hash prefix should hold, and the longest prefix (16**5 cells at most)
ROWS_PER_PREFIX = 50_000
MAX_PREFIX_DIGITS = 5
# hex digits turned into a BIGINT draw: 60 bits, so the modulo bias is negligible at any row count
DRAW_DIGITS = 15


def hash_key(seed: int, id_col: str = "doc_id") -> Column:
    """The random order key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def prefix_digits(rows: int) -> int:
    """Hash-prefix length that leaves about ``ROWS_PER_PREFIX`` of ``rows`` rows in one prefix."""
    digits = 1
    while digits < MAX_PREFIX_DIGITS and rows > ROWS_PER_PREFIX * 16**digits:
        digits += 1
    return digits


def with_shuffle_key(df: DataFrame, seed: int = SEED, id_col: str = "doc_id", out: str = "shuffle_key") -> DataFrame:
    return df.withColumn(out, hash_key(seed, id_col))


def shuffled(df: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Random total order.  This is a global sort; use :func:`with_shuffle_key` when a key is enough."""
    key = hash_key(seed, id_col)
    return df.orderBy(key, F.col(id_col))


def class_key(column: str) -> Column:
    """The class as a string that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def class_counts(df: DataFrame, column: str) -> DataFrame:
    """``(_class, n)``: rows per class."""
    return materialise(df.groupBy(class_key(column).alias("_class")).agg(F.count(F.lit(1)).alias("n")), "classes")


def class_size(df: DataFrame, column: str, label) -> int:
    return keep_class(df, label, column).count()


def global_rank(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``_rank`` 0, 1, ... in a total order, of any number of rows.

    Rows are sorted in ranges; only the sizes of the ranges meet in one task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the upper bits number the range, the lower 33 the row in it
    placed = materialise(placed.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "ranges")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")).withColumn("_all", F.lit(1))
    before = F.sum("_size").over(Window.partitionBy("_all").orderBy("_range")) - F.col("_size")
    starts = F.broadcast(sizes.select("_range", before.alias("_start")))
    return placed.join(starts, "_range").withColumn("_rank", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def hash_cuts(df: DataFrame, column: str, asked: DataFrame, largest: int, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """``(_class, _cut, _h)``: the hash keys at the 1-based ranks that ``asked`` ``(_class, _cut, _rank)`` names.

    ``largest`` is the row count of the largest class.  Two narrow passes over (class, id): one counts hash prefixes,
    one orders only the rows whose prefix holds a wanted rank.
    """
    keyed = df.select(class_key(column).alias("_class"), hash_key(seed, id_col).alias("_h"))
    keyed = keyed.withColumn("_prefix", F.substring("_h", 1, prefix_digits(largest)))
    # at most 16**MAX_PREFIX_DIGITS rows per class from here on
    cells = keyed.groupBy("_class", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_end", F.sum("_n").over(upto))
    inside = (F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_n"))
    place = F.col("_rank") - (F.col("_end") - F.col("_n"))
    hit = cells.join(asked, "_class").where(inside).select("_class", "_prefix", "_cut", place.alias("_place"))
    within = Window.partitionBy("_class", "_cut").orderBy("_h")
    # broadcast only while Spark's own size limit holds; a (class, prefix) is a bounded part of a class
    rows = keyed.join(hit, ["_class", "_prefix"]).withColumn("_row", F.row_number().over(within))
    return rows.where(F.col("_row") == F.col("_place")).select("_class", "_cut", "_h")


def _join_cuts(df: DataFrame, column: str, cuts: DataFrame, classes: int, total: int) -> DataFrame:
    """``df`` beside the cut points ``(_class, n, ...)`` of its classes, so many in all."""
    keyed = df.withColumn("_class", class_key(column))
    if classes <= BROADCAST_ROWS:
        return keyed.join(F.broadcast(cuts.drop("n")), "_class").drop("_class")
    return counted_join(keyed, cuts, "_class", "n", total).drop("_class")


def sample_exact(
    df: DataFrame, sizes: Mapping[object, int] | DataFrame, column: str, seed: int = SEED, id_col: str = "doc_id"
) -> DataFrame:
    """Exactly so many rows of each listed class, without replacement.

    ``sizes`` maps classes to sizes, or is a table ``(_class, size)`` with the key of :func:`class_key`.
    """
    if isinstance(sizes, Mapping):
        kind = df.schema[column].dataType.simpleString()
        listed = df.sparkSession.createDataFrame(list(sizes.items()), f"label {kind}, size bigint")
        sizes = listed.select(class_key("label").alias("_class"), "size")
    have = class_counts(df, column)
    asked = sizes.join(have, "_class", "left").select("_class", "size", F.coalesce("n", F.lit(0)).alias("n"))
    short = F.when(F.col("size") > F.col("n"), F.struct("_class", "n", "size"))
    found = asked.agg(F.min(short).alias("short"), F.max("n").alias("largest"), F.sum("n").alias("total"), F.count("*").alias("classes")).first()
    if found["short"]:
        cls, n, size = found["short"]
        raise ValueError(f"class {cls[1:]!r} has {n} rows, cannot draw {size} without replacement")
    ranks = asked.where("size > 0").select("_class", F.lit(0).alias("_cut"), F.col("size").alias("_rank"))
    cuts = hash_cuts(df, column, ranks, found["largest"] or 0, seed, id_col)
    cuts = materialise(cuts.join(have, "_class").select("_class", "n", F.col("_h").alias("_to")), "cuts")
    drawn = _join_cuts(df, column, cuts, found["classes"], found["total"] or 0)
    return drawn.where(hash_key(seed, id_col) <= F.col("_to")).drop("_to")


def dense_index(df: DataFrame, rows: int, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """``(id, index)`` with index 0..rows-1 in hash order, computed prefix by prefix.

    The row number is taken inside one hash prefix and shifted by the number of
    rows in smaller prefixes, so no task ever orders a whole class.
    """
    keyed = df.select(id_col, hash_key(seed, id_col).alias("_h"))
    keyed = keyed.withColumn("_prefix", F.substring("_h", 1, prefix_digits(rows)))
    # 16**MAX_PREFIX_DIGITS rows at most: small enough for one running sum and for a broadcast
    cells = keyed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(1))
    upto = Window.partitionBy("_all").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    offsets = cells.select("_prefix", (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_h", id_col))
    return (
        keyed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_prefix")
        .select(id_col, (F.col("_offset") + F.col("_place") - 1).alias("index"))
    )


def sample_with_replacement(df: DataFrame, size: int, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Exactly ``size`` draws; a row drawn k times appears k times, numbered in ``copy``.

    Draws are counted per row before they meet the data, so a join key occurs once on either side.
    """
    population = df.count()
    if size and not population:
        raise ValueError("cannot draw from an empty class")
    spark = df.sparkSession
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    pick = F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("bigint") % F.lit(max(population, 1))
    drawn = spark.range(size).select(pick.alias("index")).groupBy("index").agg(F.count(F.lit(1)).alias("_copies"))
    chosen = dense_index(df, population, seed, id_col).join(drawn, "index").select(id_col, "_copies")
    return (
        df.join(chosen, id_col)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        .drop("_copies")
    )


def balance(
    df: DataFrame,
    mode: str = "none",
    column: str = "source",
    small: str = "neural",
    target: str = "true",
    seed: int = SEED,
    id_col: str = "doc_id",
) -> DataFrame:
    """Balanced corpus.

    ``up``    draws class ``small`` with replacement to the size of class ``target``
    ``down``  draws every other class without replacement to the size of class ``small``
    ``none``  leaves the table as it is

    Balancing needs a class on every row: rows without one are an error.
    """
    if mode == "none":
        return df
    if mode not in ("up", "down"):
        raise ValueError("mode must be 'none', 'up' or 'down'")
    missing = df.where(F.col(column).isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows have no {column}")
    if mode == "up":
        drawn = sample_with_replacement(keep_class(df, small, column), class_size(df, column, target), seed, id_col)
        rest = df.where(~F.col(column).eqNullSafe(F.lit(small))).withColumn("copy", F.lit(1))
        return concat_sources([rest, drawn])
    others = df.where(F.col(column) != F.lit(small))
    sizes = class_counts(others, column).select("_class", F.lit(class_size(df, column, small)).cast("bigint").alias("size"))
    return concat_sources([sample_exact(others, sizes, column, seed, id_col), keep_class(df, small, column)])


def proportional_quotas(counts: DataFrame, whole: int, total: int, classes: int) -> DataFrame:
    """``(_class, n, quota)``: ``total`` shared over ``(_class, n)``, ``whole`` rows in all, by size.

    What is left over goes to the largest remainders, one each, ties by class.
    """
    if not whole or not total:
        return counts.withColumn("quota", F.lit(0).cast("bigint"))
    exact = F.col("n").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")
    rest = exact % F.lit(whole).cast("decimal(19,0)")
    shared = counts.select("_class", "n", F.call_function("div", exact, F.lit(whole).cast("decimal(19,0)")).alias("quota"), rest.alias("_over"))
    if classes <= BROADCAST_ROWS:
        every = Window.partitionBy(F.lit(1))
        place = F.row_number().over(every.orderBy(F.desc("_over"), "_class")) - 1
        ranked = shared.withColumns({"_rank": place, "_left": F.lit(total) - F.sum("quota").over(every)})
    else:
        left = total - shared.agg(F.sum("quota")).first()[0]
        ranked = global_rank(shared, F.desc("_over"), F.col("_class")).withColumn("_left", F.lit(left))
    return ranked.select("_class", "n", (F.col("quota") + (F.col("_rank") < F.col("_left")).cast("bigint")).alias("quota"))


def stratified_split(
    df: DataFrame,
    column: str = "source",
    test: float = 0.2,
    valid_of_rest: float = 0.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    out: str = "split",
) -> DataFrame:
    """Add ``split``: ``test``, ``valid`` or ``train``, class ratios kept, sizes exact.

    ``test`` is the share of all rows (rounded up); ``valid_of_rest`` the share of what remains.
    0.2 with 0.125 gives 70/10/20.
    """
    sizes = class_counts(df, column)
    total, largest, classes = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    n_test = math.ceil(round(test * total, 9))
    n_valid = math.ceil(round(valid_of_rest * (total - n_test), 9))
    tests = proportional_quotas(sizes, total, n_test, classes).withColumnRenamed("quota", "_t")
    rest = tests.select("_class", (F.col("n") - F.col("_t")).alias("n"))
    valids = proportional_quotas(rest, total - n_test, n_valid, classes).select("_class", F.col("quota").alias("_v"))
    quotas = tests.join(valids, "_class") if n_valid else tests.withColumn("_v", F.lit(0).cast("bigint"))
    if classes > BROADCAST_ROWS:
        quotas = materialise(quotas, "quotas")
    upto = [F.col("_t"), F.col("_t") + F.col("_v")]
    both = F.array(*[F.struct(F.lit(i).alias("_cut"), rank.alias("_rank")) for i, rank in enumerate(upto)])
    asked = quotas.select("_class", F.inline(both)).where("_rank > 0")
    found = hash_cuts(df, column, asked, largest, seed, id_col).groupBy("_class")
    found = found.agg(*[F.max(F.when(F.col("_cut") == i, F.col("_h"))).alias(c) for i, c in enumerate(("_test", "_valid"))])
    # a class without rows in a part has no cut point: nothing is at or below the empty string
    cuts = quotas.select("_class", "n").join(found, "_class", "left").fillna("", ["_test", "_valid"])
    key = hash_key(seed, id_col)
    name = F.when(key <= F.col("_test"), "test").when(key <= F.col("_valid"), "valid").otherwise("train")
    return _join_cuts(df, column, materialise(cuts, "cuts"), classes, total).withColumn(out, name).drop("_test", "_valid")
