"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Every paragraph (line) of every document is a set of words and word pairs, hashed to a sparse vector.  Two logistic
regressions over these n-grams are nested: one tells licences from the class ``unknown``, one the families of licences
apart; a family's probability is the product.  They learn from notices of the families inside ordinary words, the first
also from the ordinary paragraphs of the whole corpus but a quarter, which is held out.
Of many ordinary paragraphs, notices weigh more, so that the families keep their share of the loss.  A family counts
as predicted when its probability exceeds a calibrated bound: the one that at most the share ``false_rate`` of the
ordinary paragraphs held out exceeds.  A prediction is confirmed when at least ``min_share`` of the word pairs of one
of the family's notices occur in the paragraph.

* Null and empty texts have no paragraph.  Paragraphs of any length are read whole, long ones in windows that overlap.
* A document may have many licences; each paragraph has at most one family, the most likely one.
* Repeated rows (same id, same text) give one result; a null id stays null.  Extra columns are not read.  An empty table
  gives no rows: with nothing ordinary to learn from, nothing is predicted.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructField, StructType

from corpusflow.llm.common import row_key
from corpusflow.operators.ones import OnesRegression, code_type, codes_array, codes_of, row_sums
from corpusflow.session import bound_batches, materialise

# Public notices by family.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}
UNKNOWN = "unknown"
WINDOW = 80  # words read together; half of it is more than the longest notice
ORDINARY = 6  # ordinary paragraphs to one notice in the loss, if there are so many
SLICE = 50_000  # words that a Python worker numbers at a time, or one paragraph: their numbers stay in its caches
CARRIERS = 200  # ordinary paragraphs whose words stand around the notices to learn from
FAMILIES = [*sorted(NOTICES), UNKNOWN]
_NO_WORD = r"[^\p{L}\p{M}\p{N}]+"


def paragraph_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _NO_WORD), lambda w: w != "")


def word_pairs(words: Column) -> Column:
    """Neighbouring words; a single word has no pair."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def pairs_of(notice: str) -> list[str]:
    words = [w for w in re.split(r"[\W_]+", notice.lower()) if w]
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def paragraphs(docs: DataFrame, id_col: str, text_col: str, *keep: Column) -> DataFrame:
    """(id, kept columns, paragraph, words): paragraphs numbered from 0 in each text, blank ones left out.

    A long paragraph is several rows, windows of WINDOW words that overlap by half.
    """
    cut = docs.select(F.col(id_col).alias("id"), *keep, F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "line"))
    cut = cut.withColumn("all", paragraph_words(F.col("line"))).drop("line").where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - WINDOW // 2 - 1, F.lit(0)), F.lit(WINDOW // 2))
    windows = F.transform(starts, lambda at: F.slice("all", at + 1, WINDOW))
    return cut.withColumn("words", F.explode(windows)).drop("all")


def template_share(pairs: Column, notices: list[str]) -> Column:
    """The largest share of a notice's word pairs that is in ``pairs``."""
    shares = []
    for notice in notices:
        own = pairs_of(notice)
        shares.append(F.size(F.array_intersect(pairs, F.array(*[F.lit(p) for p in own]))) / len(own))
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def _featured(rows: DataFrame, width: int) -> DataFrame:
    rows = rows.withColumn("pairs", word_pairs(F.col("words")))
    rows = rows.withColumn("terms", F.concat("words", "pairs"))  # repeats do not count
    return HashingTF(numFeatures=width, binary=True, inputCol="terms", outputCol="features").transform(rows).drop("terms")


def _known_pairs() -> list[str]:
    return sorted({p for notices in NOTICES.values() for n in notices for p in pairs_of(n)})


def _hits(pairs: Column) -> Column:
    """The pairs that are in any notice: all that :func:`template_share` looks at."""
    known = _known_pairs()
    return F.filter(pairs, lambda p: p.isin(known))


def term_ids(terms: pa.Array, width: int) -> np.ndarray:
    """The index that ``HashingTF`` gives each string: Murmur3 of its bytes with seed 42, modulo ``width``."""
    _, ends, data = terms.cast(pa.string()).buffers()
    ends = np.frombuffer(ends, np.int32, len(terms) + 1, 4 * terms.offset).astype(np.int64)
    at, size = ends[:-1], np.diff(ends)
    bytes_ = np.append(np.frombuffer(data or b"", np.uint8), np.zeros(4, np.uint8)).astype(np.uint32)

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)

    h = np.full(len(size), 42, np.uint32)
    whole, rows, block = size // 4, np.arange(len(size)), 0
    while (rows := rows[whole[rows] > block]).size:
        o = at[rows] + 4 * block
        k = bytes_[o] | bytes_[o + 1] << np.uint32(8) | bytes_[o + 2] << np.uint32(16) | bytes_[o + 3] << np.uint32(24)
        x = h[rows] ^ mixed(k)
        h[rows] = ((x << np.uint32(13)) | (x >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        block += 1
    o, left = at + 4 * whole, size % 4
    tail = sum((np.where(left > i, bytes_[o + i], np.uint32(0)) << np.uint32(8 * i) for i in range(3)), np.zeros(len(size), np.uint32))
    h ^= np.where(left > 0, mixed(tail), np.uint32(0))
    h ^= size.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % width


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _windows_of(words: pa.Array, known: pa.Array, width: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of each window of each list of words: its list and its hits; the ends of each window's columns, and these, in order."""
    coded = words.flatten().dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[codes]  # a split leaves an empty word at either end
    owner = np.repeat(np.arange(len(length)), length)[real]
    codes, length = codes[real], np.bincount(owner, minlength=len(length))
    first = np.cumsum(length) - length
    here = np.flatnonzero(owner[1:] == owner[:-1])  # words with a neighbour in the same list
    pairs = pc.binary_join_element_wise(names.take(pa.array(codes[here])), names.take(pa.array(codes[here + 1])), " ")
    pair_id, is_hit = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    pair_id[here] = term_ids(pairs, width)
    is_hit[here] = pc.is_in(pairs, value_set=known).to_numpy(zero_copy_only=False)
    pair_at = np.zeros(len(codes), np.int64)
    pair_at[here] = np.arange(len(here))

    step = WINDOW // 2
    n = np.where(length > 0, np.maximum(length - step - 1, 0) // step + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(length[of] - nth * step, WINDOW)
    start = first[of] + nth * step
    word_at, in_pairs = _ranges(start, size), _ranges(start, size - 1)
    window, pair_window = np.repeat(np.arange(len(of)), size), np.repeat(np.arange(len(of)), size - 1)
    terms = np.concatenate([window * width + term_ids(names, width)[codes][word_at], pair_window * width + pair_id[in_pairs]])
    terms.sort()
    terms = terms[np.append(True, terms[1:] != terms[:-1])[: len(terms)]]  # repeats do not count
    term_ends = np.append(0, np.cumsum(np.bincount(terms // width, minlength=len(of))))
    found = is_hit[in_pairs]
    ends = np.append(0, np.cumsum(np.bincount(pair_window[found], minlength=len(of)))).astype(np.int32)
    hits = pa.ListArray.from_arrays(pa.array(ends), pairs.take(pa.array(pair_at[in_pairs[found]])))
    return of, hits, term_ends, terms % width


def _vectors(ends: np.ndarray, columns: np.ndarray, width: int) -> pa.Array:
    """Rows of columns as ML vectors of ones."""
    offsets, n = pa.array(ends.astype(np.int32)), len(ends) - 1
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(columns.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(np.ones(len(columns)))),
        ],
        ["type", "size", "indices", "values"],
    )


def window_rows(docs: DataFrame, id_col: str, text_col: str, width: int, *keep: Column, as_codes: bool = False) -> DataFrame:
    """The windows of :func:`paragraphs` as (id, kept columns, paragraph, hits, features), or ``codes``, two bytes an entry, as the last.

    Words and pairs are hashed once, not once a window, to the columns of ``HashingTF``.
    """
    own = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))  # once a document, not once a line
    lines = own.select(*own.columns[:-1], F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    lines = lines.withColumn("words", F.split(F.lower("line"), _NO_WORD)).drop("line")
    known, most, stored = _known_pairs(), SLICE, codes_array if as_codes else _vectors
    last = StructField("codes", BinaryType()) if as_codes else StructField("features", VectorUDT())
    new = [StructField("hits", ArrayType(StringType())), last]
    schema = StructType([*lines.drop("words").schema.fields, *new])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = pa.array(known)
        for batch in batches:
            words, rest = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(ends):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                of, hits, *terms = _windows_of(words.slice(at, upto - at), among, width)
                columns = rest.slice(at, upto - at).take(pa.array(of)).columns
                yield pa.RecordBatch.from_arrays([*columns, hits, stored(*terms, width)], names=schema.names)
                at = upto

    bound_batches(docs.sparkSession)
    return lines.mapInArrow(numbered, schema)


def _is_ordinary(hits: Column) -> Column:
    every = [n for notices in NOTICES.values() for n in notices]
    return F.when(F.size(hits) == 0, True).otherwise(template_share(hits, every) < 0.5)


def _exceeded_by(values: DataFrame, share: float) -> float | None:
    """The quantile that ``share`` of a stored column of doubles exceeds, between two values in proportion."""
    n = values.count()
    if not n:
        return None
    place = (n - 1) * (1 - share)
    low = int(place)
    name = values.columns[0]
    most = values.orderBy(F.desc(name)).limit(n - low).orderBy(name).limit(2).collect()
    return most[0][0] if place == low else (low + 1 - place) * most[0][0] + (place - low) * most[1][0]


def _notices_in_prose(ordinary: list[list[str]], copies: int, seed: int) -> list[tuple[float, list[str]]]:
    """Each notice alone and between ordinary words, with a word lost now and then."""
    rng = random.Random(seed)
    out = []
    for family in sorted(NOTICES):
        for notice in NOTICES[family]:
            words = [w for w in re.split(r"[\W_]+", notice.lower()) if w]
            for copy in range(copies):
                kept = [w for w in words if copy == 0 or rng.random() > 0.05]
                before, after = (rng.choice(ordinary)[: rng.choice((0, 0, 5, 40))] for _ in range(2))
                out.append((float(FAMILIES.index(family)), before + kept + after))
    return out


def predicted(
    rows: DataFrame, of_licence: tuple[np.ndarray, float], of_families: tuple[np.ndarray, np.ndarray], width: int, bound: float | None = None
) -> DataFrame:
    """Each window's most likely family, in place of its ``codes``; no family is likelier than that there is a licence at all.

    With a ``bound``, the windows whose probability is above it.  The models are (weights, intercept), of families by row.
    """
    shared = rows.sparkSession.sparkContext.broadcast((of_licence, of_families))
    names = [c for c in rows.columns if c != "codes"]
    new = [StructField("probability", DoubleType()), StructField("family", StringType())]
    schema = StructType([*[rows.schema[c] for c in names], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, base), (families, bases) = shared.value
        for batch in batches:
            sizes, codes = codes_of(batch.column(len(names)), width)
            with np.errstate(over="ignore"):
                p = 1.0 - 1.0 / (1.0 + np.exp(row_sums(sizes, own.take(codes)) + base))
            asked = np.ones(len(p), bool) if bound is None else p > bound
            codes, sizes = codes[np.repeat(asked, sizes)], sizes[asked]
            margins = np.stack([row_sums(sizes, w.take(codes)) for w in families], axis=1) + bases
            shares = np.exp(margins - margins.max(axis=1, keepdims=True))
            shares = shares / shares.sum(axis=1, keepdims=True) * p[asked, None]
            best = shares.argmax(axis=1)
            probability = shares[np.arange(len(best)), best]
            kept = np.ones(len(best), bool) if bound is None else probability > bound
            columns = [batch.column(c).take(pa.array(np.flatnonzero(asked)[kept])) for c in names]
            family = pa.array([FAMILIES[i] for i in best[kept].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(probability[kept]), family], names=schema.names)

    return rows.select(*names, "codes").mapInArrow(run, schema)


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    false_rate: float = 0.001, min_share: float = 0.8, copies: int = 60, width: int = 1 << 16, seed: int = 5,
) -> DataFrame:
    """(id, paragraph, family, probability, template_share): the confirmed licence paragraphs."""
    spark = docs.sparkSession
    result = f"id {docs.schema[id_col].dataType.simpleString()}, paragraph int, family string, probability double, template_share double"
    draw = F.xxhash64(F.col(id_col).cast("string"), F.length(text_col), F.lit(seed))
    rows = window_rows(docs, id_col, text_col, width, row_key(id_col, text_col).alias("key"), draw.alias("draw"), as_codes=True)
    fold = F.pmod(F.xxhash64("draw", "paragraph", F.lit(seed)), F.lit(4)).cast("byte")
    # every paragraph's numbers are made once: training, calibration and prediction read this table
    rows = materialise(rows.withColumns({"ordinary": _is_ordinary(F.col("hits")), "fold": fold}), "paragraphs")
    ordinary = rows.where("ordinary")
    first = ordinary.select("draw", "paragraph").orderBy("draw", "paragraph").limit(CARRIERS).agg(F.max("draw")).first()[0]
    if first is None:
        return spark.createDataFrame([], result)
    carriers = paragraphs(docs.where(draw <= first), id_col, text_col, draw.alias("draw"))
    carriers = carriers.where(_is_ordinary(_hits(word_pairs(F.col("words")))))
    some = [r["words"] for r in carriers.orderBy("draw", "paragraph", "words").limit(CARRIERS).collect()]
    plain = ordinary.where("fold > 0")
    made = _notices_in_prose(some, copies, seed)
    weight = max(1.0, plain.count() / (ORDINARY * len(made)))
    notices = _featured(spark.createDataFrame(made, "label double, words array<string>"), width)
    notices = notices.select("label", F.lit(weight).alias("weight"), "features").coalesce(1)  # a fixed number of rows
    shown = [(r["label"], weight, 1.0, bytearray(r["features"].indices.astype(code_type(width)).tobytes())) for r in notices.collect()]
    shown = spark.createDataFrame(shown, "label double, weight double, licence double, codes binary").coalesce(1)
    unknown = F.lit(float(FAMILIES.index(UNKNOWN))).alias("label")
    training = shown.unionByName(plain.select(unknown, F.lit(1.0).alias("weight"), F.lit(0.0).alias("licence"), "codes"))
    fixed = dict(maxIter=60, regParam=1e-4, weightCol="weight")
    of_families = LogisticRegression(family="multinomial", **fixed).fit(notices)
    of_licence = OnesRegression(family="binomial", labelCol="licence", featuresCol="codes", **fixed).of(width).fit(training)
    of_families = of_families.coefficientMatrix.toArray(), of_families.interceptVector.toArray()
    of_licence = of_licence.coefficients.toArray(), of_licence.intercept

    held = predicted(ordinary.where("fold = 0").select("codes"), of_licence, of_families, width).select("probability")
    bound = _exceeded_by(materialise(held, "held"), false_rate)
    bound = 0.5 if bound is None else bound  # too few paragraphs to hold any out
    likely = predicted(rows.select("id", "key", "paragraph", "hits", "codes"), of_licence, of_families, width, bound)
    share = F.lit(None).cast("double")
    for family, own in NOTICES.items():
        share = F.when(F.col("family") == family, template_share(F.col("hits"), own)).otherwise(share)
    found = likely.withColumn("template_share", share).where(F.col("template_share") >= min_share)
    best = found.groupBy("id", "key", "paragraph").agg(F.max(F.struct("probability", "template_share", "family")).alias("best"))
    return best.select("id", "paragraph", "best.family", "best.probability", "best.template_share")
