"""Source divergence audit: how far the word frequencies of a language's sources lie apart.

A translate table over the UTF-8 bytes lowers ``A`` to ``Z`` and blanks every other ASCII byte that is no letter;
``bytes.split`` then gives the terms and a ``Counter`` per document their frequencies.  Terms in at least ``min_docs``
documents of their language are kept.  A (language, source) group with N occurrences of the V kept terms of its language
gives a term that it holds ``count`` times p = 1 + floor(SCALE * (count + 1) / (N + V)), and so does the language as a whole.
The divergence of p from q is floor((p - q)^2 / q).

All is integers.  Counts meet in decimals where 64 bits do not suffice; p is at most SCALE + 1, and the sum of the
divergences over all terms stays below 2^63 as long as V is below 10^9.

Pairs of sources are summed sparsely.  A term that neither source holds gives all such terms' value; a term that one of them
holds depends on its p alone, so the distinct p of a source with their numbers suffice; only for terms that both
hold the two counts have to meet.  That happens inside a task, term by term, and only sums per pair leave it.

* Null text, language and source are empty strings, which are values like any other.
* A group without terms has N = 0 and is compared with the others; a language without kept terms gives pairs of value 0.
* A language with one source has no pairs; its terms have p = q and are not reported.
* Repeated rows are documents of their own.  Equal values are ranked by item, in the order of UTF-8 bytes.
* Very long texts are counted whole, one at a time.  Extra columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.session import materialise

SCALE = 1_000_000_000
#: Letters lowered, bytes of longer characters as they are, all else blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Sums of pairs of sources that a task holds before it hands them on.
HELD = 500_000
#: Up to so many possible pairs are summed in an array by place.
DENSE = 1_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, terms, counts), a row per document."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):  # few texts as Python objects at a time
            part = batch.slice(at, 200)
            terms, counts, ends = [], [], [0]
            for text in part.column(2).to_pylist():
                found = Counter(terms_of(text))
                terms += (b"", *found.keys())  # names the group, whatever becomes of its terms
                counts += (0, *found.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["lang", "source", "terms", "counts"])


def kept_terms(docs: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, head): the counts of kept terms, the language's count, and 1 on one row of each term.

    Every group also has a row with an empty term, which no text holds.
    """
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*read, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.mapInArrow(count_terms, "lang string, source string, terms array<string>, counts array<bigint>")
    rows = rows.select("lang", "source", F.inline(F.arrays_zip("terms", "counts")).alias("term", "n"))
    counted = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    same = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"lang_n": F.sum("n").over(same), "all_docs": F.sum("docs").over(same), "least": F.min("source").over(same)})
    counted = counted.where((F.col("all_docs") >= min_docs) | (F.col("term") == ""))
    head = ((F.col("source") == F.col("least")) & (F.col("term") != "")).cast("bigint")
    return materialise(counted.select("lang", "source", "term", "n", "lang_n", head.alias("head")), "kept")


def share(count: Column | str, n: str, v: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)); 1 where there are no kept terms."""
    count = F.col(count) if isinstance(count, str) else count
    whole = lambda c: c.cast("decimal(19,0)")
    up = whole(count + 1) * F.lit(SCALE).cast("decimal(10,0)")
    large = F.call_function("div", up, whole(F.col(n)) + whole(F.col(v)))
    small = F.call_function("div", (count + 1) * SCALE, F.col(n) + F.col(v))
    part = F.when(count < 2**63 // SCALE - 1, small).otherwise(large)
    return F.when(F.col(v) > 0, 1 + part).otherwise(F.lit(1).cast("bigint"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows (lang, term, source, p, p0), each term's rows in a run, to sums (lang, source, item, value) over the terms both hold.

    A term's value is what its two counts give, less what the sums over either source's terms have for it already.
    """

    def far(p, q):
        return (p - q) * (p - q) // q

    def joined(batch: pa.RecordBatch, sums: dict) -> None:
        lang, source = [c.dictionary_encode() for c in (batch.column(0), batch.column(2))]
        codes = source.indices.to_numpy().astype(np.int64)
        p, p0 = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        _, ends = runs(batch)
        end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        langs, wide = lang.indices.to_numpy().astype(np.int64), len(source.dictionary)
        first, shift = np.arange(batch.num_rows), 0
        found_codes, found = [], []
        while len(first):
            shift += 1
            first = first[first + shift < end[first]]
            for a, b in ((first, first + shift), (first + shift, first)):
                found.append(far(p[a], p[b]) - far(p[a], p0[b]) - far(p0[a], p[b]) + far(p0[a], p0[b]))
                found_codes.append((langs[a] * wide + codes[a]) * wide + codes[b])
            if shift % 16 == 0 or not len(first):
                summed(sums, np.concatenate(found_codes), np.concatenate(found), lang, source, wide)
                found_codes, found = [], []

    def summed(sums, pairs, values, lang, source, wide) -> None:
        if not len(pairs):
            return
        each, place = np.unique(pairs, return_inverse=True) if len(lang.dictionary) * wide * wide > DENSE else (np.arange(len(lang.dictionary) * wide * wide), pairs)
        totals = np.zeros(len(each), np.int64)
        np.add.at(totals, place, values)
        each, totals = each[totals != 0], totals[totals != 0]
        names, langs = source.dictionary.to_pylist(), lang.dictionary.to_pylist()
        for pair, total in zip(each.tolist(), totals.tolist(), strict=True):
            key = (langs[pair // wide // wide], names[pair // wide % wide], names[pair % wide])
            sums[key] = sums.get(key, 0) + total

    def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """First rows and ends of the runs of a (lang, term)."""
        coded = [c.dictionary_encode().indices.to_numpy() for c in (batch.column(0), batch.column(1))]
        change = np.flatnonzero((np.diff(coded[0]) != 0) | (np.diff(coded[1]) != 0)) + 1
        return np.concatenate([[0], change]), np.concatenate([change, [batch.num_rows]])

    def handed_on(sums: dict) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(sums.values()), pa.int64())], ["lang", "source", "item", "value"])

    sums: dict = {}
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        last = int(runs(batch)[0][-1])  # the last term may go on in the next batch
        if last:
            joined(batch.slice(0, last), sums)
        rest = batch.slice(last)
        if len(sums) > held:
            yield handed_on(sums)
            sums = {}
    if rest is not None:
        joined(rest, sums)
    yield handed_on(sums)


def audit_sources(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top_terms: int = 200
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: the divergence of a source from every other source (``item``) of its language.  Part ``term``: the
    ``top_terms`` terms that a source uses more than its language does.
    """
    kept = kept_terms(docs, lang_col, source_col, text_col, min_docs)
    every = Window.partitionBy("lang")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"))
    groups = groups.withColumns({"vocabulary": F.sum("heads").over(every), "lang_total": F.sum("total").over(every)})
    groups = materialise(groups.withColumn("p0", share(F.lit(0), "total", "vocabulary")), "groups")
    # broadcast only while Spark's own size limit holds
    rows = kept.where(F.col("term") != "").join(groups.drop("heads"), ["lang", "source"])
    rows = rows.select("lang", "source", "term", share("n", "total", "vocabulary").alias("p"), "p0", share("lang_n", "lang_total", "vocabulary").alias("q"))

    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = rows.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))

    partners = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))

    def with_others(left: DataFrame) -> DataFrame:
        met = left.join(partners, "lang").withColumn("other", F.explode("others"))
        return met.where(F.col("source") != F.col("other.source"))

    p, p0, other = F.col("p"), F.col("p0"), F.col("other.p0")
    counts = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    alone = with_others(counts).select(
        "lang",
        F.inline(F.array(
            F.struct(F.col("source"), F.col("other.source").alias("item"), (F.col("m") * (divergence(p, other) - divergence(p0, other))).alias("value")),
            F.struct(F.col("other.source").alias("source"), F.col("source").alias("item"), (F.col("m") * (divergence(other, p) - divergence(other, p0))).alias("value")),
        )),
    )
    neither = with_others(groups).select("lang", "source", F.col("other.source").alias("item"), (F.col("vocabulary") * divergence(p0, other)).alias("value"))
    runs = rows.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = runs.mapInArrow(_both, "lang string, source string, item string, value bigint")
    pairs = alone.unionByName(neither).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(own)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
