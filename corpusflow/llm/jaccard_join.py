"""N-gram Jaccard join: MinHash prefixes in several trees and exact verification.

A text is the set of its runs of ``n`` words (lower case, cut at blanks).  Its MinHash signature holds
``trees`` labels.  The depth of the prefix is one for all texts: shortened from ``max_depth``, one value at a time, until a pair
exactly at the threshold shares a prefix in some tree with probability ``recall``.  Texts that share it in a tree are a node, found by
the hash of the prefix; no trie is kept and no prefix is shortened further for the data.  All pairs of a node are then compared exactly:

* texts with the same words are one text with a number of copies, before anything is compared;
* nodes with the same texts are compared once;
* a large node is cut by hash into blocks, and every pair of blocks is one bounded unit of work;
* a pair that shares nodes of several trees is compared in the first of them alone;
* a unit returns how many links each text has and the edges that connect what is not connected yet, never pairs.

Results: one row per document with its class (documents connected by links) and its number of links.

* A null text, and one without words, is linked to nothing: its class is its own.
* A text with fewer than ``n`` words is one run of all its words.
* Texts of any length are compared whole.  Repeated rows (same id, same text) are copies of each other.
* Classes are named by their smallest id; a null id never names a class unless it is the only one.
* Extra columns are not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corpusflow.llm.common import packed, row_key, skew_join, unpacked
from corpusflow.llm.components import components
from corpusflow.session import materialise

if TYPE_CHECKING:
    import pyarrow as pa

BLOCK = 256  # texts of a block; a unit of work compares at most two blocks
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")
_P = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return [w for w in _BLANKS.split((text or "").lower()) if w]


def shingles(words: list[str], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words."""
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    n = min(n, len(codes))
    out = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(_P) + codes[i : len(codes) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def tree_labels(runs: np.ndarray, trees: int, depth: int) -> list[int]:
    """For each tree the hash of the first ``depth`` MinHash values of the text's label."""
    rng = np.random.default_rng(20)
    by = rng.integers(0, 2**64, trees * depth, np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**64, trees * depth, np.uint64)
    least = np.full(trees * depth, 2**64 - 1, np.uint64)
    for at in range(0, len(runs), 4096):
        mixed = runs[at : at + 4096, None] * by + plus
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    values = (least >> np.uint64(16)).reshape(trees, depth)
    label = np.zeros(trees, np.uint64)
    for i in range(depth):
        label = label * np.uint64(_P) + values[:, i]
        label ^= label >> np.uint64(31)
    return label.view(np.int64).tolist()


def _signatures(n: int, trees: int, depth: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                digests, labels = [], []
                for text in part.column("text").to_pylist():
                    words = words_of(text)
                    digests.append(hashlib.md5(" ".join(words).encode()).digest() if words else None)
                    labels.append(tree_labels(shingles(words, n), trees, depth) if words else None)
                new = [pa.array(digests, pa.binary()), pa.array(labels, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), *new], ["id", "key", "digest", "labels"])

    return sign


def common_counts(runs: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many runs every two texts share: a 0/1 matrix of texts by shared runs times itself, some columns at a time."""
    text = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    _, place, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    held = shared[place]
    text, column = text[held], column[place[held]]
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    common = np.zeros((len(runs), len(runs)), np.float64)
    total = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, total, columns):
        at = slice(*np.searchsorted(column, (begin, begin + columns)))
        part = np.zeros((len(runs), min(columns, total - begin)), np.float32)
        part[text[at], column[at] - begin] = 1
        common += part @ part.T
    return common


def _parts(linked: np.ndarray) -> np.ndarray:
    """For each text the first text of its connected part."""
    part = np.full(len(linked), -1)
    for root in range(len(linked)):
        if part[root] >= 0:
            continue
        part[root], reached = root, [root]
        for a in reached:  # grows while it is read
            new = np.flatnonzero(linked[a] & (part < 0))
            part[new] = root
            reached += new.tolist()
    return part


def linked_within(digests: list[bytes], copies: list[int], labels: np.ndarray, runs: list[np.ndarray], blocks: np.ndarray, tree: int, cross: bool, threshold: float):
    """(links of each text, edges between its parts) among the pairs whose first common node is in ``tree``.

    Links asked for elsewhere, in an earlier tree or inside one block, make the parts that are connected without
    this unit; the edges only connect those parts.  A pair of blocks of one group of near copies gives one edge, and
    a group that an earlier tree has connected gives none.
    """
    n = len(digests)
    asked = ~np.eye(n, dtype=bool)
    if cross:
        asked &= blocks[:, None] != blocks[None, :]
    for earlier in labels[:, :tree].T:
        asked &= earlier[:, None] != earlier[None, :]
    if not asked.any():
        return [0] * n, []
    size = np.asarray([len(r) for r in runs], float)
    common = common_counts(runs)
    near = common / (size[:, None] + size[None, :] - common) >= threshold
    np.fill_diagonal(near, False)
    linked = asked & near
    edges = []
    if linked.any():
        known, joined = _parts(near & ~asked), _parts(near)
        heads = np.flatnonzero(known == np.arange(n))  # one text of every known part
        for root in np.unique(joined[heads]):
            chain = heads[joined[heads] == root].tolist()  # a chain, not a star: no node gets many edges
            edges += [(digests[a], digests[b]) for a, b in zip(chain[:-1], chain[1:], strict=True)]
    return (linked @ np.asarray(copies, np.int64)).tolist(), edges


def _compare(n: int, threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        def finish(unit, rows):
            rows = sorted({r["digest"]: r for r in rows}.values(), key=lambda r: r["digest"])  # repeated rows bring a text twice
            runs = [r["runs"] for r in rows]
            labels = np.asarray([r["labels"] for r in rows], np.int64)
            links, edges = linked_within(
                [r["digest"] for r in rows], [r["copies"] for r in rows], labels, runs, np.asarray([r["block"] for r in rows]), unit[0], unit[2] != unit[3], threshold
            )
            out = [(r["digest"], None, k) for r, k in zip(rows, links, strict=True) if k] + [(a, b, 0) for a, b in edges]
            if out:
                a, b, k = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(k, pa.int64())], ["a", "b", "links"])

        unit, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for r in batch.slice(at, 200).to_pylist():
                    now = (r["tree"], r["label"], r["i"], r["j"])
                    if now != unit and rows:
                        yield from finish(unit, rows)
                        rows = []
                    unit = now
                    r["runs"] = shingles(words_of(r.pop("text")), n)
                    rows.append(r)
        if rows:
            yield from finish(unit, rows)

    return compare


def _units(texts: DataFrame) -> DataFrame:
    """(tree, label, i, j, block, digest): which text is compared in which unit."""
    spread = texts.select("digest", F.xxhash64("digest").alias("h"), F.posexplode("labels").alias("tree", "label"))
    nodes = spread.groupBy("tree", "label").agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("mark"), F.min("digest").alias("low"), F.max("digest").alias("high")
    )
    same = nodes.where("n > 1").groupBy("n", "mark", "low", "high").agg(F.min(F.struct("tree", "label")).alias("node"))
    kept = materialise(same.select("node.tree", "node.label", "n"), "nodes")
    members = skew_join(materialise(spread, "spread"), kept, ["tree", "label"], "n")
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod("h", F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = members.select("tree", "label", "block", "digest", other)
    return pairs.select("tree", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, trees: int = 24,
    max_depth: int = 8, recall: float = 0.9999,
) -> DataFrame:
    """(id, key, class_id, first_key, n_links): one row a row of ``docs``; ``first_key`` is the row key of the class's first document."""
    depth = prefix_depth(trees, max_depth, threshold, recall)
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = materialise(
        rows.mapInArrow(_signatures(n, trees, depth), f"id {id_type}, key binary, digest binary, labels array<bigint>"), "signatures"
    )
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")
    texts = signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(place).alias("first"), F.first("labels").alias("labels")
    )
    texts = materialise(texts, "texts")
    units = materialise(_units(texts), "units")
    wanted = texts.join(units.select("digest").distinct(), "digest", "left_semi")
    held = wanted.select(F.col("first.key").alias("key"), "digest", "copies", "labels").join(rows.select("key", "text"), "key")
    work = units.join(held.drop("key"), "digest").repartition("tree", "label", "i", "j").sortWithinPartitions("tree", "label", "i", "j")
    found = materialise(work.mapInArrow(_compare(n, threshold), "a binary, b binary, links bigint"), "links")
    links = found.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    groups = components(found.where("b IS NOT NULL")).withColumnRenamed("node", "digest")
    named = texts.drop("labels").join(groups, "digest", "left").join(links, "digest", "left")
    named = materialise(named.withColumn("root", F.coalesce("root", "digest")), "named")
    firsts = named.groupBy("root").agg(F.min("first").alias("lead"), F.count("*").alias("n"))
    named = skew_join(named, firsts, ["root"], "n").select(
        "digest", "copies", "lead", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    joined = skew_join(signed.where("digest IS NOT NULL").select("id", "key", "digest"), named, ["digest"], "copies")
    joined = joined.select("id", "key", F.col("lead.id").alias("class_id"), F.col("lead.key").alias("first_key"), "n_links")
    alone = signed.where("digest IS NULL")
    return joined.unionByName(alone.select("id", "key", F.col("id").alias("class_id"), F.col("key").alias("first_key"), F.lit(0).cast("bigint").alias("n_links")))


def keep_first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first document of every class, all columns; of repeated rows one stays."""
    classes = jaccard_classes(docs, id_col, text_col, **options)
    firsts = classes.where(F.col("key") == F.col("first_key")).select("key").distinct()
    kept = packed(docs, key=row_key(id_col, text_col)).join(firsts, "key").dropDuplicates(["key"])
    return unpacked(kept, docs.columns)
