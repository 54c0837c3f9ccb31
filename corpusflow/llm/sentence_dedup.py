"""Substring dedup: sentences of passages that occurred before are cut out.

Texts are cut into sentences, each with the white space after it: a sentence ends after ``.``, ``!`` or ``?``
before blanks, and at a line end.  Every run of ``width`` consecutive sentences with at least ``min_words``
words is hashed (128 bits, blanks around sentences do not count) and looked up over all documents.  A
run that occurs more than once keeps its first place in the order (document id, position); at any later
place its sentences are covered, and covered sentences go.

* A null text stays null and an empty text empty; both have no runs.
* A text with fewer sentences than a run is left alone; short runs (headings, lists of single words) are too.
* A document whose sentences are all covered keeps its row, with an empty text.
* Repeated rows (same id, same text) are one occurrence: they keep or lose the same sentences.
  Rows that share an id but not the text are ordered by a digest of the text.
* A null id counts as the smallest.  Extra columns pass through, whatever their names; one named like
  the count is replaced.  An empty table gives an empty table.

``dedup_sentences`` asks every two-sentence run for ``min_words``.  ``dedup_passages`` hashes every such run,
however short, and every single sentence of at least ``min_words``; covered sentences that follow each other
are one passage, and a passage goes if it has ``min_words`` as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.llm.common import packed, row_key, skew_join, unpacked
from corpusflow.llm.spans import cut_repeats
from corpusflow.operators.corpus import compute_once
from corpusflow.session import materialise

# between two sentences; up to eight blanks belong to the sentence before
SENTENCE_END = r"(?<=\n)(?=[^\n])|(?<=[.!?][ \t]{1,8})(?=\S)"
BLANKS = " \t\r\n"


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END, -1)


def _content(run: list[Column]) -> Column:
    return F.concat_ws("\x1f", *[F.trim(s, F.lit(BLANKS)) for s in run])


def _words(sentence: Column) -> Column:
    inner = F.trim(sentence, F.lit(BLANKS))
    return F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1


def dedup_sentences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, min_words: int = 16,
    count_col: str | None = "sentences_removed",
) -> DataFrame:
    """``docs`` with repeated passages cut from ``text_col``, and the number of sentences cut."""

    def long_enough(run: list[Column]) -> Column:
        return sum([_words(s) for s in run[1:]], _words(run[0])) >= min_words

    return cut_repeats(
        docs, id_col, text_col, width, cut=sentences, glue="", digest=_content, counts=long_enough, count_col=count_col
    )


def _all_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, key, pos, width, span): every two sentences in a row, and every sentence of ``min_words``."""
    segments = F.col("segments")

    def span(i: Column, width: int) -> Column:
        digest = F.unhex(F.md5(_content([F.get(segments, i + j) for j in range(width)])))
        return F.struct(i.alias("pos"), F.lit(width).alias("width"), digest.alias("span"))

    pairs = F.when(F.size(segments) >= 2, F.transform(F.sequence(F.lit(0), F.size(segments) - 2), lambda i: span(i, 2)))
    singles = F.transform(segments, lambda s, i: F.when(_words(s) >= min_words, span(i, 1)))
    runs = F.concat(F.coalesce(pairs, F.array()), F.filter(singles, lambda s: s.isNotNull()))
    return rows.select("id", "key", F.explode(runs).alias("s")).select("id", "key", "s.*")


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 16, count_col: str | None = "sentences_removed"
) -> DataFrame:
    """``docs`` without repeated passages of at least ``min_words``, whatever the length of their sentences."""
    text = F.col(text_col)
    split = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), sentences(text).alias("segments"))
    runs = materialise(_all_runs(compute_once(split.withColumnRenamed("segments", "cut"), "segments", F.col("cut")), min_words), "runs")
    place = F.struct("id", "key", "pos")
    firsts = runs.groupBy("span").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = skew_join(runs, firsts, ["span"], "n").where(~place.eqNullSafe(F.col("first")))
    later = later.groupBy("key").agg(F.collect_set(F.struct("pos", "width")).alias("runs"))

    text = F.col("row").getField(text_col)
    rows = packed(docs, key=row_key(id_col, text_col)).join(later, "key", "left")
    rows = compute_once(rows, "segments", F.when(F.col("runs").isNotNull(), sentences(text)))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["pos"], r["pos"] + r["width"] - 1)))
    rows = compute_once(rows, "covered", F.array_sort(F.array_distinct(places)))
    rows = compute_once(rows, "words", F.transform("segments", _words))
    covered, n = F.col("covered"), F.size("covered")
    heads = F.filter(covered, lambda x, i: (i == 0) | (x - F.get(covered, i - 1) > 1))
    tails = F.filter(covered, lambda x, i: (i == n - 1) | (F.get(covered, i + 1) - x > 1))
    passages = F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("head"), b.alias("tail")))

    def long_enough(p: Column) -> Column:
        return F.aggregate(F.slice("words", p["head"] + 1, p["tail"] - p["head"] + 1), F.lit(0), lambda acc, x: acc + x) >= min_words

    rows = compute_once(rows, "passages", F.filter(passages, long_enough))
    begin = F.concat(F.array(F.lit(0)), F.transform("passages", lambda p: p["tail"] + 1))
    end = F.concat(F.transform("passages", lambda p: p["head"]), F.array(F.size("segments")))
    kept = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice("segments", a + 1, b - a)))
    rows = compute_once(rows, "kept", F.when(F.col("runs").isNotNull(), kept))
    changed = {text_col: F.when(F.col("kept").isNotNull(), F.array_join("kept", "")).otherwise(text)}
    if count_col:
        changed[count_col] = F.coalesce(F.size("segments") - F.size("kept"), F.lit(0))
    return unpacked(rows, docs.columns, **changed)
