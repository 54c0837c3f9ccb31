"""Approximate nearest neighbours by cosine: an NN-descent graph, searched greedily.

The graph starts from small blocks: vectors on the same side of a few random planes, compared among themselves,
several times over with other planes.  Each round of NN-descent then joins every node's neighbours (its own
and a bounded number of those that have it as neighbour) with their vectors, compares neighbours of the
same node, at least one of them new, and keeps the best of every node, until few lists change.  A query
walks the graph with a beam: in every step the nodes reached are joined with their vectors and adjacency and scored, and
those among the nearest of all so far lead on; the walk ends when none of them leads to a node not scored yet.  Graph and beam work on
half-precision unit vectors; the nodes of the last beam are scored exactly, in double precision.

* Rows without id and vectors that are null, empty, zero, or hold null or non-finite components take no
  part; nor do vectors of another length than the most common one.
* Graph and search know distinct vectors alone; the smallest ids of each are kept beside and put in at the end, so
  copies fill no lists.  Ties go to the smaller id.
* Repeated rows (same id, same vector) are one row.  Rows that share an id but not the vector are separate
  candidates; a query never returns rows of its own id.
* With fewer candidates than asked for, all are returned.  Empty tables, no rows.
* Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.llm.common import skew_join
from corpusflow.session import bound_batches, materialise

if TYPE_CHECKING:
    import pyarrow as pa

LIST = "node bigint, ids array<bigint>, sims array<float>"
GRAPH = "node bigint, code binary, ids array<bigint>, sims array<float>, fresh array<boolean>"


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def rows_of(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node, id, vector): the rows that take part, stored; ``node`` names a vector, so equal vectors share it."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull())
    rows = rows.where(F.coalesce(_valid(F.col("vector")), F.lit(False)))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is not None:
        rows = rows.where(F.size("vector") == common["d"])
    plain = F.transform("vector", lambda x: x + F.lit(0.0))  # one zero, not two
    return materialise(rows.withColumn("vector", plain).withColumn("node", F.xxhash64("vector")), "vectors")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, dict[str, list]]]:
    """Runs of equal ``key`` in sorted batches."""
    held: dict[str, list] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000).to_pydict()
            keys = part[key]
            begin = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[begin]:
                    continue
                if held and held[key][0] != keys[begin]:
                    yield held[key][0], held
                    held = {}
                for name, values in part.items():
                    held.setdefault(name, []).extend(values[begin:i])
                begin = i
    if held:
        yield held[key][0], held


def _matrix(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<f2").reshape(len(codes), -1).astype(np.float32)


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    import pyarrow as pa

    node, ids, sims = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32()))], ["node", "ids", "sims"]
    )


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    for batch in batches:
        codes = []
        for v in batch.column("vector").to_pylist():
            x = np.asarray(v)
            x = x / np.abs(x).max()  # neither the squares nor the halves overflow
            codes.append((x / np.linalg.norm(x)).astype("<f2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(codes, pa.binary())], ["node", "code"])


def _side(planes: np.ndarray):
    """For each start, the cell of a vector: on which side of the start's planes it lies."""

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("code").to_pylist())
            for start, own in enumerate(planes):
                bits = (x @ own.T > 0).reshape(len(x), -1)
                cell = bits @ (1 << np.arange(bits.shape[1], dtype=np.int64)) if bits.shape[1] else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("code"), pa.array(np.full(len(x), start, np.int32)), pa.array(cell.astype(np.int64))],
                    ["node", "code", "start", "cell"],
                )

    return side


def _block_lists(k: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            x, node = _matrix(rows["code"]), np.asarray(rows["node"], np.int64)
            if len(x) > 1:
                sims = x @ x.T
                np.fill_diagonal(sims, -np.inf)
                best = np.argpartition(-sims, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
                yield _lists([(int(n), node[b].tolist(), s[b].tolist()) for n, b, s in zip(node, best, sims, strict=True)])

    return compare


def best_of(ids: list[int], sims: list[float], k: int) -> list[tuple[float, int]]:
    """The ``k`` most similar of the ids, each once, nearest first."""
    most: dict[int, float] = {}
    for i, s in zip(ids, sims, strict=True):
        most[i] = max(s, most.get(i, -2.0))
    return sorted(((s, i) for i, s in most.items()), key=lambda x: (-x[0], x[1]))[:k]


def _merge(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            rows = batch.drop_columns("code").to_pydict()
            out = []
            for node, old, found, sims in zip(rows["node"], rows["old"], rows["ids"], rows["sims"], strict=True):
                best = best_of([i for x in found for i in x], [s for x in sims for s in x], k)
                known = set(old or ())
                out.append((node, [i for _, i in best], [s for s, _ in best], [i not in known for _, i in best]))
            node, ids, sims, fresh = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), batch.column("code"), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32())), pa.array(fresh, pa.list_(pa.bool_()))],
                ["node", "code", "ids", "sims", "fresh"],
            )

    return merge


def _join_lists(k: int):
    """At one node: every pair of its neighbours with a new one; better partners of each, at most ``k``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "centre"):
            fresh = np.asarray(rows["fresh"], bool)
            if len(fresh) < 2 or not fresh.any():
                continue
            x, node = _matrix(rows["code"]), np.asarray(rows["node"], np.int64)
            sims = x @ x.T
            sims[~(fresh[:, None] | fresh[None, :])] = -np.inf
            np.fill_diagonal(sims, -np.inf)
            sims[sims <= np.asarray(rows["worst"], np.float32)[:, None]] = -np.inf
            out = []
            for i in np.flatnonzero((sims > -np.inf).any(axis=1)):
                b = np.argsort(-sims[i], kind="stable")[:k]
                b = b[sims[i, b] > -np.inf]
                out.append((int(node[i]), node[b].tolist(), sims[i, b].tolist()))
            if out:
                yield _lists(out)

    return join


def build_graph(
    nodes: DataFrame, k: int = 20, block: int = 256, starts: int = 8, rounds: int = 6, settled: float = 0.02, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """(codes, graph): (node, code) and (node, code, ids, sims), the ``k`` nearest found of every node, nearest first.

    Ends when less than the share ``settled`` of all list entries is new in a round, or after ``rounds``.
    """
    codes = materialise(nodes.mapInArrow(_encode, "node bigint, code binary"), "codes")
    total = codes.count()
    first = codes.first()
    if first is None:
        return codes, codes.sparkSession.createDataFrame([], GRAPH).drop("fresh")
    dims = len(first["code"]) // 2
    rng = np.random.default_rng(seed)
    bits = max(0, int(np.log2(max(1, total / block))))
    if total <= block:
        starts = 1  # one block holds every pair
    planes = rng.standard_normal((starts, bits, dims)).astype(np.float32)
    celled = materialise(codes.mapInArrow(_side(planes), "node bigint, code binary, start int, cell bigint"), "cells")
    sized = skew_join(celled, celled.groupBy("start", "cell").agg(F.count("*").alias("n")), ["start", "cell"], "n")
    part = F.pmod(F.xxhash64("node", "start"), F.ceil(F.col("n") / block))
    blocks = sized.select(F.xxhash64("start", "cell", part).alias("block"), "node", "code").repartition("block").sortWithinPartitions("block")
    lists = blocks.mapInArrow(_block_lists(k), LIST)
    gathered = lists.groupBy("node").agg(F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims"))
    gathered = codes.join(gathered, "node", "left").withColumn("old", F.lit(None).cast("array<bigint>"))
    empty = F.array().cast("array<array<bigint>>"), F.array().cast("array<array<float>>")
    gathered = gathered.select("node", "code", "old", F.coalesce("ids", empty[0]).alias("ids"), F.coalesce("sims", empty[1]).alias("sims"))
    graph = materialise(gathered.mapInArrow(_merge(k), GRAPH), "graph")
    for _ in range(rounds):
        new = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        if new <= settled * total * k:
            break
        out = graph.select(F.col("node").alias("centre"), F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("centre", F.col("e.ids").alias("node"), "e.fresh")
        back = out.select(F.col("node").alias("centre"), F.col("centre").alias("node"), "fresh")
        nearest = Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("node"))
        back = back.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).drop("place")
        members = out.unionByName(back).groupBy("centre", "node").agg(F.max("fresh").alias("fresh"))
        worst = F.when(F.size("sims") < k, -2.0).otherwise(F.element_at("sims", -1)).cast("float").alias("worst")
        local = members.join(graph.select("node", "code", worst), "node").repartition("centre").sortWithinPartitions("centre")
        better = local.mapInArrow(_join_lists(k), LIST).groupBy("node").agg(F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims"))
        merged = graph.select("node", "code", F.col("ids").alias("old"), F.col("sims").alias("old_sims")).join(better, "node", "left")
        merged = merged.select(
            "node", "code", "old",
            F.concat(F.array("old"), F.coalesce("ids", empty[0])).alias("ids"), F.concat(F.array("old_sims"), F.coalesce("sims", empty[1])).alias("sims"),
        )
        graph = materialise(merged.mapInArrow(_merge(k), GRAPH), "graph")
    return codes, graph.drop("fresh")


STATE = "query bigint, code binary, ids array<bigint>, sims array<float>, seen array<bigint>, open array<bigint>"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that a node leads to, as bytes."""
    import pyarrow as pa

    for batch in batches:
        ways = [way.values.to_numpy().astype("<i8").tobytes() for way in batch.column("next")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(ways, pa.binary())], ["node", "code", "way"])


def _visit(beam: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score the nodes a query has reached and walk on from those that come into its beam."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            out = []
            for query, code, *lists, found in zip(*(batch.column(c) for c in ("query", "code", "ids", "sims", "seen", "found")), strict=True):
                ids, sims, seen = (x.values.to_numpy() for x in lists)
                around = np.zeros(0, np.int64)
                if found.is_valid:
                    node, codes, ways = (found.values.field(c) for c in ("node", "c", "way"))
                    held, scores = len(ids), _matrix(codes.to_pylist()) @ _matrix([code.as_py()])[0]
                    ids, sims = np.concatenate([ids, node.to_numpy()]), np.concatenate([sims, scores])
                    best = np.lexsort((ids, -sims))[:beam]
                    seen = np.union1d(seen, node.to_numpy())
                    come = ways.take(pa.array(best[best >= held] - held)).to_pylist()
                    around = np.setdiff1d(np.frombuffer(b"".join(come), "<i8"), seen)
                    ids, sims = ids[best], sims[best]
                out.append((query.as_py(), code.as_py(), ids, sims, seen, around))
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.binary(), longs, pa.list_(pa.float32()), longs, longs]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query", "code", "ids", "sims", "seen", "open"])

    return visit


def search_graph(codes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = 64, entries: int = 32) -> DataFrame:
    """(query, ids): for each of ``queries`` (query, code) the nodes of its last beam.

    A query that is a node of the graph starts at itself, any other at ``entries`` fixed nodes.  Each step brings the
    nodes to score together with the nodes they lead to, so that a step is one join.
    """
    k = graph.select(F.max(F.size("ids"))).first()[0] or 1
    back = graph.select(F.explode("ids").alias("node"), F.col("node").alias("other"))
    nearest = Window.partitionBy("node").orderBy(F.xxhash64("other"))
    back = back.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k).groupBy("node").agg(F.collect_list("other").alias("back"))
    roads = graph.join(back, "node", "left")
    roads = roads.select("node", "code", F.array_union("ids", F.coalesce("back", F.array().cast("array<bigint>"))).alias("next"))
    roads = materialise(roads.mapInArrow(_ways, "node bigint, code binary, way binary"), "roads")
    fixed = [r["node"] for r in codes.orderBy(F.xxhash64("node")).limit(entries).select("node").collect()]
    inside = codes.select(F.col("node").alias("query"), F.lit(True).alias("inside"))
    none = F.array().cast("array<bigint>")
    start = F.when(F.col("inside"), F.array("query")).otherwise(F.array(*[F.lit(n) for n in fixed]).cast("array<bigint>"))
    state = queries.join(inside, "query", "left").select(
        "query", "code", none.alias("ids"), F.array().cast("array<float>").alias("sims"), none.alias("seen"), start.alias("open")
    )
    ended = None
    while True:
        reached = state.select("query", F.explode("open").alias("node"))
        found = reached.join(roads.withColumnRenamed("code", "c"), "node").groupBy("query").agg(F.collect_list(F.struct("node", "c", "way")).alias("found"))
        state = materialise(state.drop("open").join(found, "query", "left").mapInArrow(_visit(beam), STATE), "beams")
        over = state.where(F.size("open") == 0).select("query", "ids")
        ended = over if ended is None else ended.unionByName(over)
        state = state.where(F.size("open") > 0)
        if state.isEmpty():
            return ended


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 5, beam: int = 160, **options
) -> DataFrame:
    """(query_id, rank, id, score): the ``top`` nearest found of every row for which ``is_query`` holds.

    ``is_query`` is a condition on the column ``id``.
    """
    bound_batches(vectors.sparkSession)  # rows of a step hold hundreds of vectors
    rows = rows_of(vectors, id_col, vector_col)
    nodes = materialise(rows.groupBy("node").agg(F.first("vector").alias("vector")), "nodes")
    # no query needs more ids of one vector than ``top`` and its own; the limit holds in every task before the shuffle
    place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    named = rows.select("node", "id").distinct()
    least = named.withColumn("place", place).where(F.col("place") <= top + 1)
    least = materialise(least.groupBy("node").agg(F.array_sort(F.collect_list("id")).alias("ids")), "least_ids")
    asked = materialise(named.where(is_query), "asked")
    sizes = asked.groupBy("node").agg(F.count("*").alias("n"))
    codes, graph = build_graph(nodes, **options)
    queries = codes.withColumnRenamed("node", "query").join(sizes.select(F.col("node").alias("query")), "query")
    beams = search_graph(codes, graph, queries, beam=max(beam, 2 * top))
    pairs = beams.select("query", F.explode("ids").alias("node"))
    left = nodes.select(F.col("node").alias("query"), F.col("vector").alias("a"))
    both = pairs.join(nodes.select("node", F.col("vector").alias("b")), "node").join(left, "query")

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    score = dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))
    scored = both.select(F.col("query").alias("own"), "node", score.alias("score")).join(least, "node")
    hits = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))
    found = scored.select("own", F.explode(hits).alias("hit"))
    lists = materialise(found.groupBy(F.col("own").alias("node")).agg(F.array_sort(F.collect_list("hit")).alias("hits")).join(sizes, "node"), "found")
    answered = skew_join(asked, lists, ["node"], "n").select(
        F.col("id").alias("query_id"), "node", F.slice(F.filter("hits", lambda h: h["id"] != F.col("id")), 1, top).alias("hits")
    )
    out = answered.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.far")).alias("score"))
