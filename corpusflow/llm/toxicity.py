"""Toxicity scores from two class-conditional Kneser-Ney models that share their backoff counts.

A word's probability in a class comes from its continuation count there, the number of different words that
precede it (copies of a text count once), discounted and interpolated with the share of *all* documents
that hold the word, which both classes share.  A word seen after ``discount`` predecessors or fewer gives all its
mass to the shared level, where the classes agree, so rare expressions say nothing.  A level of word
pairs above is left out: on the labelled tables pairs that near copies repeat outweighed all else.
A document's log-likelihoods under the toxic and the ordinary model are
divided by its length and compared; means over the words that favour one side by more than ``margin`` go
with them into a logistic calibration on sample documents that the counts have not seen.

Learned from: at most ``sample_docs`` labelled documents and ``sample_chars`` characters of each class, the lowest
hashes of their ids, as many toxic as ordinary ones.  That bounds the model, which is broadcast.  The
shared counts come from every document.  Scored: every document, its whole text.

* A null text counts as empty; a text without words gets the score of no evidence, which the calibration sets.
* Labels that are null or not 0 or 1, or without id, teach nothing; of several labels of one id the
  highest counts.  Without learnable documents of both classes every score is 0.
* Repeated rows get the same score; ties cannot arise, since every row is scored on its own.
* Extra columns pass through, whatever their names; ones named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from corpusflow.session import bound_batches, materialise

OUT = ["toxic_ll", "ordinary_ll", "favours_toxic", "favours_ordinary"]


def word_codes(text: Column) -> Column:
    """The 64-bit hashes of a text's lower-case words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


@dataclass
class Model:
    """Sorted word hashes and their probabilities; column 0 ordinary, 1 toxic."""

    words: np.ndarray
    p: np.ndarray  # relative to the shared probability of the word
    level: np.ndarray  # the same for words at the shared level
    margin: float

    def measures(self, codes: np.ndarray) -> tuple[float, float, float, float]:
        """Mean log-likelihoods, toxic and ordinary, and mean evidence beyond the margin for each side.

        Likelihoods are relative to the shared level's, the same for both classes.
        """
        if not len(codes):
            return 0.0, 0.0, 0.0, 0.0
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        logs = np.log(np.where((self.words[at] == codes)[:, None], self.p[at], self.level))
        ratio = logs[:, 1] - logs[:, 0] - np.log(self.level[1] / self.level[0])
        return (
            float(logs[:, 1].mean()), float(logs[:, 0].mean()),
            float(np.maximum(ratio - self.margin, 0).mean()), float(np.maximum(-ratio - self.margin, 0).mean()),
        )


def held_out(id_col: str) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_docs: int, sample_chars: int
) -> tuple[DataFrame, float] | None:
    """(toxic, fold, codes) of the bounded, balanced sample, and the odds of toxic among the learnable labels."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.max(label_col).cast("int").alias("toxic")).where(~held_out("id"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    of_each = min(sample_docs, *sizes.values())
    drawn = known.withColumn("draw", F.xxhash64("id", F.lit(7)))
    first = [drawn.where(F.col("toxic") == k).orderBy("draw", "id").limit(of_each) for k in (0, 1)]
    picked = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * sample_docs small rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    so_far = Window.partitionBy("toxic").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, 0)
    lengths = materialise(texts.withColumn("chars", F.coalesce(F.length("text"), F.lit(0))), "sample")
    bounded = lengths.withColumn("sum", F.sum("chars").over(so_far)).where(F.col("sum") <= sample_chars)
    fold = F.pmod(F.xxhash64("id", F.lit(8)), F.lit(5)).alias("fold")
    return materialise(bounded.select("toxic", fold, word_codes(F.col("text")).alias("codes")), "coded"), sizes[1] / sizes[0]


def fit(docs: DataFrame, sample: DataFrame, text_col: str, discount: float, margin: float) -> Model | None:
    """Continuation counts of the sample, shared counts of the whole corpus, and the bounded model of both."""
    codes = F.col("codes")
    places = F.sequence(F.lit(0), F.size(codes) - 1)
    after = F.transform(places, lambda i: F.struct(F.get(codes, i - 1).alias("v"), F.get(codes, i).alias("w")))
    pairs = sample.where(F.size(codes) > 0).select("toxic", F.explode(after).alias("p")).select("toxic", "p.*").distinct()
    counted = pairs.groupBy("w").agg(*[F.count_if(F.col("toxic") == k).alias(f"m{k}") for k in (0, 1)])
    counted = materialise(counted, "continuations")
    totals = counted.agg(
        *[F.sum(f"m{k}").alias(f"all{k}") for k in (0, 1)], *[F.sum(F.least(f"m{k}", F.lit(discount))).alias(f"left{k}") for k in (0, 1)]
    ).first()
    if not totals["all0"] or not totals["all1"]:
        return None
    shared = docs.select(F.explode(F.array_distinct(word_codes(F.col(text_col)))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    shared = materialise(shared, "shared")
    mass = shared.agg(F.sum("df")).first()[0]
    # words that some class knows beyond the discount; all others are at the shared level in both
    known = counted.where((F.col("m0") > discount) | (F.col("m1") > discount)).join(shared, "w").toPandas().sort_values("w")
    every = np.asarray([totals["all0"], totals["all1"]], float)
    level = np.asarray([totals["left0"], totals["left1"]], float) / every
    own = np.maximum(known[["m0", "m1"]].to_numpy(float) - discount, 0) / every
    p = level + own / (known["df"].to_numpy(float)[:, None] / mass)
    if not len(known):
        return Model(np.zeros(1, np.int64), level[None, :], level, margin)
    return Model(known["w"].to_numpy(np.int64), p, level, margin)


def measures(spark: SparkSession, codes: Column, model: Model) -> Column:
    """The struct of the measures of a column of word codes.  Nothing but the codes goes to the Python workers."""
    bound_batches(spark)
    carried = spark.sparkContext.broadcast(vars(model))  # plain arrays: workers need not have this package

    def measure(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(**carried.value)
        for part in parts:
            flat, ends = part.values.to_numpy(zero_copy_only=False), part.offsets.to_numpy()
            found = [own.measures(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in range(len(OUT))], OUT)

    kind = ", ".join(f"{c} double" for c in OUT)
    # else the rows of a filter on a score would be measured for the filter, and again for the result
    return F.arrow_udf(measure, kind).asNondeterministic()(codes)


def features(found: Column) -> list[Column]:
    return [found["toxic_ll"] - found["ordinary_ll"], found["favours_toxic"], found["favours_ordinary"]]


def calibrate(x: np.ndarray, y: np.ndarray, odds: float, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights of the three measures by Newton steps, and a bias moved to the given odds."""
    if not len(y):
        return np.asarray([0.0, 0.0, 0.0, np.log(odds)])
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    weights, penalty = np.zeros(4), np.diag([ridge, ridge, ridge, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(weights[:3] / scale, weights[3] + np.log(odds))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 10_000,
    sample_chars: int = 40_000_000, discount: float = 2.0, margin: float = 1.0,
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1), predicted and the mean log-likelihoods toxic_ll and ordinary_ll."""
    names = ["held_out", "score", "predicted", "toxic_ll", "ordinary_ll"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    drawn = labelled_sample(docs, labels, id_col, text_col, label_col, sample_docs, sample_chars)
    model = drawn and fit(docs, drawn[0].where("fold > 0"), text_col, discount, margin)
    if not model:
        zero = [F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("toxic_ll"), F.lit(0.0).alias("ordinary_ll")]
        return docs.select(*kept, held_out(id_col).alias("held_out"), *zero)
    seen = drawn[0].where("fold = 0").select("toxic", measures(docs.sparkSession, F.col("codes"), model).alias("found"))
    tried = seen.select("toxic", *[f.alias(f"x{i}") for i, f in enumerate(features(F.col("found")))]).toPandas()
    weights = calibrate(tried[["x0", "x1", "x2"]].to_numpy(float), tried["toxic"].to_numpy(float), drawn[1])
    free = "found"
    while free in {c.lower() for c in docs.columns}:
        free += "_"
    rows = docs.select(*kept, held_out(id_col).alias("held_out"), measures(docs.sparkSession, word_codes(F.col(text_col)), model).alias(free))
    found = F.col(free)
    z = sum((f * float(w) for f, w in zip(features(found), weights, strict=False)), F.lit(float(weights[3])))
    score = 1 / (1 + F.exp(-z))
    return rows.select(
        *kept, "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), found["toxic_ll"].alias("toxic_ll"),
        found["ordinary_ll"].alias("ordinary_ll"),
    )
