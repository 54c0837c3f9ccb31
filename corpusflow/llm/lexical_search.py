"""Ranked lexical search: best-first over intervals of documents, bounded by range maxima of posting lists.

Terms are runs of letters, digits and non-ASCII characters, ``A`` to ``Z`` lowered.  With N documents that have a term, L terms in
all of them, n in one, df documents holding a term and tf occurrences, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))),
a document's measure is m = 100 - 90 + 90 n N div L, and its score the sum of w * (10^9 tf div (1000 tf + 8 m)) over the
query's distinct terms.  All but the logarithm is 64-bit integers.

One pass counts the terms of every document and keeps those that some query asks for.  The search cuts that table into runs of
documents that fit a bound, within the task and without a shuffle.  Of a run it builds each term's posting list in the order
of ids, with the impacts beside it, and a sparse table of range maxima over them.  A query begins with the interval of all
documents; an interval's bound is the sum of its terms' maxima in it.  The intervals of the highest bounds are split
at the document of their largest impact, which is scored exactly, and the parts get bounds of their own from two table
entries a term.  What cannot reach the best found so far is dropped, until nothing is left.  The best carry over to the
task's next run, and the tasks' best are ranked at the end.

* Null texts have no terms; neither they nor empty texts count in N.  A query without terms, or whose terms no document
  holds, gives no rows; so does a table without terms.
* Repeated documents are documents of their own.  Equal scores rank by id, a null id first.  Document ids are integers.
* Query rows of the same id are one query with the terms of all of them; a null id is an id.
* Very long texts are counted whole.  Extra columns are not read, whatever their names.
* Queries are searched in blocks of about ``block_terms`` terms, each block in passes of its own: that bounds what is broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusflow.session import materialise

#: Letters lowered, digits and bytes of longer characters as they are, all else blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms asked for in one block of queries.
BLOCK_TERMS = 200_000
#: Postings of one run of documents, and its documents.
RUN_POSTINGS, RUN_DOCS = 500_000, 50_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, term)."""
    for batch in batches:
        found = [sorted(set(words_of(t or b""))) for t in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
        terms = pa.array([t for f in found for t in f], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), terms], ["item", "term"])


def postings(docs: DataFrame, id_col: str, text_col: str, codes: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs): the number of a document's terms, and code and frequency of those asked for."""
    carried = docs.sparkSession.sparkContext.broadcast(codes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = carried.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # few texts as Python objects at a time
                part = batch.slice(at, 500)
                n, terms, tfs, ends = [], [], [], [0]
                for text in part.column(1).to_pylist():
                    words = words_of(text or b"")
                    found = Counter([known[w] for w in words if w in known])
                    n.append(len(words))
                    terms += found.keys()
                    tfs += found.values()
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(count, "id bigint, n bigint, terms array<int>, tfs array<int>")


class Run:
    """Posting lists of a run of documents, in the order of ids, with a sparse table of range maxima over each."""

    def __init__(self, ids, nulls, n, ends, terms, tfs, weights, total_docs, total_terms):
        order = np.lexsort((ids, ~nulls))  # null ids first
        self.ids, self.nulls = ids[order], int(nulls.sum())
        self.docs = len(ids)
        if 90 * int(n.max(initial=0)) * total_docs < 2**63:
            measure = 100 - 90 + (90 * n * total_docs) // total_terms
        else:
            measure = np.asarray([100 - 90 + 90 * int(x) * total_docs // total_terms for x in n], np.int64)
        place = np.empty(self.docs, np.int64)
        place[order] = np.arange(self.docs)
        doc = np.repeat(np.arange(self.docs), np.diff(ends))
        impact = weights[terms] * (1_000_000_000 * tfs // (1_000 * tfs + 8 * measure[doc]))
        keys = terms * self.docs + place[doc]
        by_key = np.argsort(keys)
        self.keys, self.impact = keys[by_key], impact[by_key]
        # best[k, i]: where the first largest impact of the 2**k postings from i on lies; never asked across the end of a list
        longest = int(np.bincount(terms).max(initial=1))
        best = [np.arange(len(keys), dtype=np.int32)]
        while 2 ** len(best) <= longest:
            half = 2 ** (len(best) - 1)
            left, right = best[-1], np.concatenate([best[-1][half:], best[-1][-1:].repeat(half)])[: len(keys)]
            best.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.best = np.stack(best)
        self.log = np.zeros(longest + 1, np.int64)
        for k in range(1, len(best)):
            self.log[2**k :] = k

    def maxima(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of intervals with a column per term: the sum of the terms' maxima, and the document of the largest."""
        size = end - begin
        some = size > 0
        level = self.log[np.maximum(size, 0)]
        begin = np.where(some, begin, 0)
        left = self.best[level, begin]
        right = self.best[level, np.where(some, end - (1 << level), 0)]
        at = np.where(self.impact[left] >= self.impact[right], left, right)
        value = np.where(some, self.impact[at], 0)
        top = at[np.arange(len(at)), value.argmax(axis=1)]
        return value.sum(axis=1), self.keys[top] % self.docs

    def search(self, terms: np.ndarray, found: list[tuple[int, bool, int]], top: int) -> list[tuple[int, bool, int]]:
        """``found`` with what this run holds of the best: (-score, has an id, id) in rank order, ``top`` of them at most."""
        lists = np.searchsorted(self.keys, np.concatenate([terms, terms + 1]) * self.docs)
        begin, end = lists[: len(terms)], lists[len(terms) :]
        held = end > begin
        terms, begin, end = terms[held], begin[held][None, :], end[held][None, :]
        if not len(terms):
            return found
        base = terms * self.docs
        bound, split = self.maxima(begin, end)
        low = np.zeros(1, np.int64)
        while True:
            # what can still enter: a higher score, or the same at a smaller id
            least = -found[-1][0] if len(found) == top else 0
            reach = self._below(found[-1]) if least else self.docs
            alive = (bound > least) | ((bound == least) & (low < reach) & (bound > 0))
            if not alive.all():
                low, bound, split, begin, end = low[alive], bound[alive], split[alive], begin[alive], end[alive]
            if not len(low):
                return found
            many = min(len(low), 32 + len(low) // 8)
            order = np.argpartition(-bound, many - 1)
            picked, rest = order[:many], order[many:]
            doc, b, e = split[picked], begin[picked], end[picked]
            at = np.searchsorted(self.keys, base + doc[:, None])
            hit = (at < e) & (self.keys[np.minimum(at, len(self.keys) - 1)] == base + doc[:, None])
            score = np.where(hit, self.impact[np.minimum(at, len(self.keys) - 1)], 0).sum(axis=1)
            new = [(-int(s), bool(d >= self.nulls), int(self.ids[d])) for s, d in zip(score, doc, strict=True) if s >= max(least, 1)]
            if new:
                found = sorted([*found, *new])[:top]
            halves = np.concatenate([b, at + hit]), np.concatenate([at, e])
            half_bound, half_split = self.maxima(*halves)
            low = np.concatenate([low[rest], low[picked], doc + 1])
            bound, split = np.concatenate([bound[rest], half_bound]), np.concatenate([split[rest], half_split])
            begin, end = np.concatenate([begin[rest], halves[0]]), np.concatenate([end[rest], halves[1]])

    def _below(self, entry: tuple[int, bool, int]) -> int:
        """How many documents of the run come before an entry of the same score."""
        return self.nulls + int(np.searchsorted(self.ids[self.nulls :], entry[2])) if entry[1] else 0


def _search(rows: DataFrame, queries: list[np.ndarray], weights: np.ndarray, total_docs: int, total_terms: int, top: int, run_postings: int, run_docs: int) -> DataFrame:
    """(query, id, score): the best of each task."""
    carried = rows.sparkSession.sparkContext.broadcast((queries, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = carried.value
        best: list[list] = [[] for _ in queries]

        def one(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, n, terms, tfs = [t.column(i).combine_chunks() for i in range(4)]
            ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))])
            if not ends[-1]:
                return
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs)]
            run = Run(ids.fill_null(0).to_numpy(), nulls, n.to_numpy(), ends, *flat, weights, total_docs, total_terms)
            for k, terms in enumerate(queries):
                best[k] = run.search(terms, best[k], top)

        held, size, docs = [], 0, 0
        for batch in batches:
            held.append(batch)
            docs += batch.num_rows
            size += len(batch.column(2).flatten())
            if size >= run_postings or docs >= run_docs:
                one(held)
                held, size, docs = [], 0, 0
        if held:
            one(held)
        rows = [(k, e[2] if e[1] else None, -e[0]) for k, entries in enumerate(best) for e in entries]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["query", "id", "score"])

    return rows.mapInArrow(search, "query int, id bigint, score bigint")


def search_documents(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    top: int = 10, block_terms: int = BLOCK_TERMS, run_postings: int = RUN_POSTINGS, run_docs: int = RUN_DOCS,
) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    asked = asked.mapInArrow(query_terms, f"item {kind}, term string").distinct()
    asked = materialise(asked.withColumn("block", F.xxhash64("item", F.lit(13))), "queries")
    blocks = -(-asked.count() // block_terms)
    found = None
    for block in range(blocks):
        # about ``block_terms`` rows
        mine = asked.where(F.pmod("block", F.lit(blocks)) == block).groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        codes: dict[bytes, int] = {}
        queries = [np.asarray([codes.setdefault(t.encode(), len(codes)) for t in row["terms"]], np.int64) for row in mine]
        if not queries:
            continue
        rows = materialise(postings(docs, id_col, text_col, codes), "postings")
        total_docs, total_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total_docs:
            break
        held = {r["term"]: r["df"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weight = [math.floor(1000 * math.log((2 * total_docs + 2) / (2 * held.get(c, 0) + 1))) for c in range(len(codes))]
        best = _search(rows, queries, np.asarray(weight, np.int64), total_docs, total_terms, top, run_postings, run_docs)
        names = spark.createDataFrame([(k, row["item"]) for k, row in enumerate(mine)], f"query int, item {kind}")
        best = best.join(F.broadcast(names), "query").select("item", "id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], f"item {kind}, id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "id", "score")
