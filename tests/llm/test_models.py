"""Toxicity, licences, nearest neighbours and the pipeline: held-out accuracy, brute force, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm.catalog import QUERIES
from corpusflow.llm.licences import NOTICES, pairs_of, scan_licences
from corpusflow.llm.nearest import nearest_neighbours
from corpusflow.llm.toxicity import Model, calibrate, score_toxicity

INSULTS = ["scum", "idiot", "clown", "moron"]


@pytest.fixture(scope="module")
def spoken(spark):
    """600 labelled texts; every twentieth word of a toxic one is an insult."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.randint(30, 90))]
        toxic = i % 4 == 0
        if toxic:
            words[::20] = [rng.choice(INSULTS) for _ in words[::20]]
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(toxic), "y"))
    rows += [(700, None, "x", 0.5), (701, "", "x", 0.5), (702, "scum " * 5000, "x", 0.5), (None, "no id", "x", 0.5), (3, rows[3][1], "x", 0.5)]
    labels += [(None, 1, "y"), (701, None, "y"), (702, 7, "y"), (0, 0, "y")]
    return (
        spark.createDataFrame(rows, "doc_id bigint, text string, codes string, score double"),
        spark.createDataFrame(labels, "doc_id bigint, toxic int, text string"),
    )


def test_toxicity_on_the_held_out_fold(spoken):
    docs, labels = spoken
    scored = score_toxicity(docs, labels)
    assert scored.columns == ["doc_id", "text", "codes", "held_out", "score", "predicted", "toxic_ll", "ordinary_ll"]
    rows = scored.collect()
    assert len(rows) == 605 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 600]
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held)
    assert right >= 0.95
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[702]["predicted"] == 1 and by_id[700]["predicted"] == by_id[701]["predicted"] == 0
    assert by_id[700]["score"] == by_id[701]["score"]


def test_toxicity_texts_stay_in_the_jvm(spoken):
    """Only word codes go to the Python workers, once, also when the scores are filtered."""
    docs, labels = spoken
    scored = score_toxicity(docs.withColumn("found", F.lit(1)), labels)
    assert scored.columns[:4] == ["doc_id", "text", "codes", "found"]
    plan = scored.where("predicted = 0").select("text", "score")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and len(re.findall(r"ArrowEvalPython \[", plan)) <= 1
    assert scored.where("predicted = 1").count() == score_toxicity(docs, labels).where("predicted = 1").count() > 0


def test_toxicity_learns_nothing_from_the_held_out_fold(spoken):
    docs, labels = spoken
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(fold, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted((repr(r["doc_id"]), r["score"]) for r in score_toxicity(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels(spoken):
    docs, labels = spoken
    for none in (labels.limit(0), labels.where("toxic = 1")):
        assert {(r["score"], r["predicted"]) for r in score_toxicity(docs, none).collect()} == {(0.0, 0)}
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_measures_are_mean_log_likelihoods():
    model = Model(np.asarray([5, 9]), np.asarray([[1.0, 3.0], [2.0, 0.5]]), np.asarray([0.5, 0.5]), 1.0)
    toxic, ordinary, for_toxic, for_ordinary = model.measures(np.asarray([5, 9, 7, 5]))
    assert toxic == pytest.approx(np.mean(np.log([3, 0.5, 0.5, 3]))) and ordinary == pytest.approx(np.mean(np.log([1, 2, 0.5, 1])))
    assert for_toxic == pytest.approx(2 * (np.log(3) - 1) / 4) and for_ordinary == pytest.approx((np.log(4) - 1) / 4)
    assert model.measures(np.asarray([], np.int64)) == (0, 0, 0, 0)


def test_calibration_is_a_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    w = calibrate(x, y, 1.0)
    p = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert np.abs((y - p).sum()) < 0.01 and ((p >= 0.5) == y).mean() > 0.7 and w[0] > 0
    assert calibrate(x, y, 2.0)[3] == pytest.approx(w[3] + np.log(2))


def test_toxicity_query_covers_the_table(spark, sf_dir):
    rows = QUERIES["op2_toxicity"](spark, sf_dir)
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and {"doc_id", "held_out", "score", "predicted"} <= set(rows.columns)


def test_licence_paragraphs(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))
    rows, asked = [], set()
    for i in range(160):
        lines = [prose(rng.randint(3, 40)) for _ in range(5)]
        if i % 4 == 0:
            family = sorted(NOTICES)[(i // 4) % len(NOTICES)]
            notice = NOTICES[family][(i // 40) % len(NOTICES[family])]
            lines[i % 5] = f"{prose(4)} {notice} {prose(4)}" if i % 3 else notice.upper()
            asked.add((i, i % 5, family))
        rows.append((i, "\n".join(lines), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "the license of the free work was public", "x"), (903, prose(20000) + " Released under the MIT License. " + prose(9), "x")]
    asked.add((903, 0, "mit"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    found = scan_licences(docs, copies=20).collect()
    assert {(r["id"], r["paragraph"], r["family"]) for r in found} == asked
    assert all(r["template_share"] >= 0.8 and 0 < r["probability"] <= 1 for r in found)
    assert scan_licences(docs.limit(0)).count() == 0


def test_licence_model_sees_every_document(spark, monkeypatch):
    """Ordinary paragraphs of all 1,500 documents reach training or calibration, each once."""
    from pyspark.ml.classification import LogisticRegression

    from corpusflow.llm import licences

    seen = {}
    fit, bound = LogisticRegression.fit, licences._exceeded_by
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: (seen.update(plain=rows.where("label = 8").count()), fit(self, rows))[1])
    monkeypatch.setattr(licences, "_exceeded_by", lambda values, share: (seen.update(held=values.count()), bound(values, share))[1])
    rows = [(i, "\n".join(f"w{i} w{i * k % 97} w{k}" for k in range(8))) for i in range(1500)]
    docs = spark.createDataFrame([*rows, (5000, "Released under the MIT License.")], "doc_id bigint, text string")
    assert [(r["id"], r["family"]) for r in scan_licences(docs, copies=5).collect()] == [(5000, "mit")]
    assert seen["plain"] + seen["held"] == 1500 * 8 and seen["held"] > 2000


def test_licence_windows_are_numbered_like_hashing_tf(spark):
    """The same windows, hits and vectors as in column functions; Python numbers words, the JVM no strings of pairs."""
    from corpusflow.llm import licences

    text = "One\n\nthe MIT License, released under the MIT license " + "x y " * 30 + "\n" + " ".join(f"w{i}é中" for i in range(121)) + "\n" + " ".join(f"v{i % 50}" for i in range(81))
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "İstanbul ΣΑΣ naïve ٣٤ 𝒳"), (4, " - \n;"), (5, "a_b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    key = F.col("doc_id").cast("string").alias("key")
    plain = licences._featured(licences.paragraphs(docs, "doc_id", "text", key), 1 << 16)
    plain = plain.select("id", "key", "paragraph", licences._hits(F.col("pairs")).alias("hits"), "features")
    found = licences.window_rows(docs, "doc_id", "text", 1 << 16, key)
    assert found.columns == plain.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect())) and found.count() == 16
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_licence_regression_of_all_paragraphs_has_two_classes(spark, monkeypatch):
    """A pass over every ordinary paragraph carries one weight a column, not one a column and family."""
    from pyspark.ml.classification import LogisticRegression

    sizes, fit = [], LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, rows: (model := fit(self, rows), sizes.append((rows.where("label = 8").count() > 0, model.numClasses)))[0])
    docs = spark.createDataFrame([*[(i, f"w{i} w{i % 7}\nv{i}") for i in range(200)], (500, "Released under the MIT License.")], "doc_id bigint, text string")
    assert [(r["id"], r["family"]) for r in scan_licences(docs, copies=5).collect()] == [(500, "mit")]
    assert sorted(sizes) == [(False, 8), (True, 2)]


def test_regression_of_ones_is_that_of_the_library(spark):
    """The same weights from two bytes an entry; sums of many tasks are added up before they reach the driver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    from corpusflow.operators import ones

    rng = np.random.default_rng(1)
    for width, parts in ((300, 3), (70_000, 40)):
        rows = []
        for i in range(600):
            columns = np.unique(np.append(rng.integers(0, 40, rng.integers(0, 9)), [width - 1 - i % 3] * (i % 8 == 0)).astype(int))
            code = bytearray(columns.astype(ones.code_type(width)).tobytes())
            rows.append((float(i % 8 == 0) if i % 11 else 1.0, 2.5 if i % 8 == 0 else 1.0, code, Vectors.sparse(width, columns.tolist(), [1.0] * len(columns))))
        df = spark.createDataFrame(rows, ["label", "weight", "codes", "features"]).repartition(parts).persist()
        fixed = dict(family="binomial", maxIter=12, regParam=1e-4, weightCol="weight")
        theirs = LogisticRegression(**fixed).fit(df)
        mine = ones.OnesRegression(featuresCol="codes", **fixed).of(width).fit(df)
        assert np.abs(mine.coefficients.toArray() - theirs.coefficients.toArray()).max() < 1e-7 and abs(mine.intercept - theirs.intercept) < 1e-7
    one = ones.OnesRegression(featuresCol="codes", **fixed).of(width).fit(df.withColumn("label", F.lit(1.0)))
    assert one.intercept == np.inf and not one.coefficients.toArray().any()


def test_licence_paragraphs_are_stored_and_scored_as_codes(spark, monkeypatch):
    """No vector of doubles is stored, and no vector function of the JVM scores a paragraph."""
    from corpusflow.llm import licences

    stored, write = [], licences.materialise
    monkeypatch.setattr(licences, "materialise", lambda df, name="t": (stored.append(dict(df.dtypes)), write(df, name))[1])
    docs = spark.createDataFrame([*[(i, f"w{i} w{i % 7}\nv{i}") for i in range(200)], (500, "Released under the MIT License.")], "doc_id bigint, text string")
    found = scan_licences(docs, copies=5)
    assert [(r["id"], r["family"]) for r in found.collect()] == [(500, "mit")]
    assert stored[0]["codes"] == "binary" and "features" not in stored[0] and stored[1] == {"probability": "double"}
    assert "UDF(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_licence_bound_is_the_quantile(spark):
    from corpusflow.llm.licences import _exceeded_by

    rng = random.Random(3)
    values = [rng.random() for _ in range(1501)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    for share in (0.001, 0.1, 0.0004, 0.5):
        assert abs(_exceeded_by(df, share) - np.quantile(values, 1 - share)) < 1e-12
    assert _exceeded_by(df.limit(0), 0.1) is None and _exceeded_by(df.where(f"p = {max(values)!r}"), 0.001) == max(values)


def test_licence_query_equals_templates(spark, sf_dir):
    found = {(r["doc_id"], r["paragraph"]) for r in QUERIES["op5_licence_paragraphs"](spark, sf_dir).collect()}
    notices = [set(pairs_of(n)) for group in NOTICES.values() for n in group]
    asked = set()
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for i, line in enumerate((doc["text"] or "").split("\n")):
            if any(len(n & set(pairs_of(line))) >= 0.8 * len(n) for n in notices):
                asked.add((doc["doc_id"], i))
    assert found == asked and asked


def brute_nearest(rows, top, is_query):
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dims = max({len(v) for _, v in good}, key=lambda d: sum(len(v) == d for _, v in good), default=0)
    good = [(i, v) for i, v in good if len(v) == dims]
    out = {}
    for i, q in good:
        if is_query(i):
            found = sorted((-(v @ q) / np.sqrt((v @ v) * (q @ q)), j) for j, v in good if j != i)
            out[i] = [(j, -s) for s, j in found[:top]]
    return out


def test_nearest_small_and_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [2.0, 0.2]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0])]
    rows += [(None, [1.0, 1.0]), (10, [float("inf"), 1.0]), (1, [1.0, 0.1]), (50, [1e300, 1e299])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, node int")
    found = nearest_neighbours(df, F.col("id") % 50 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["id"], r["rank"], r["score"]))
    assert [x[:2] for x in got[0]] == [(1, 1), (2, 2), (50, 3)] or [x[:2] for x in got[0]][:1] == [(50, 1)] or {x[0] for x in got[0]} == {1, 2, 50}
    assert nearest_neighbours(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_nearest_recall(spark, sf_dir):
    found = QUERIES["op7_nearest_vectors"](spark, sf_dir).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    asked = brute_nearest(rows, 5, lambda i: i % 50 == 0)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({j for j, _ in asked[q]} & {j for j, _ in got[q]}) for q in asked)
    assert set(got) == set(asked) and hits >= 0.9 * sum(map(len, asked.values()))
    exact = dict(rows)
    for q, near in got.items():
        a = np.asarray(exact[q], float)
        for j, score in near:
            b = np.asarray(exact[j], float)
            assert score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_nearest_needs_few_jobs(spark):
    """What the driver keeps grows with the jobs: a step of the search is one join, however wide the beam."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1200, 8)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    spark.sparkContext.setJobGroup("nearest", "nearest")
    try:
        found = nearest_neighbours(df, F.col("id") % 50 == 0).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest"))
    asked = brute_nearest(rows, 5, lambda i: i % 50 == 0)
    got = {(r["query_id"], r["id"]) for r in found}
    assert sum((q, j) in got for q in asked for j, _ in asked[q]) >= 0.95 * 5 * len(asked)
    assert jobs < 150, jobs


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole, columns = docs, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        assert out.columns[: len(columns)] == columns and (i == 4 or out.columns == columns)
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = out
    ids = {r["doc_id"] for r in docs.collect()}
    assert 0.5 * whole.count() < len(ids) == docs.count()
    assert ids == {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}


def test_pipeline_on_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None, 1), (1, None, "en", "a", 0, 1), (2, "", "en", "a", 0, 1), (3, "a\nb\nc", "en", "a", 5, 1), (3, "a\nb\nc", "en", "a", 5, 1), (4, "a\nb\nc", "en", "a", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, lines_removed int")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
    assert sorted(repr(r["doc_id"]) for r in docs.collect()) == ["1", "2", "3", "None"]
    none = docs.select(*[c for c in docs.columns[:6]]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.materialise(stage(spark, none, sf_dir), name)
    assert none.count() == 0


def test_nearest_copies_and_ties(spark):
    """Every third vector is the same: the smallest ids of the copies, and no lost neighbours of the others."""
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, 0.0, -0.0] if i % 3 == 0 else rng.standard_normal(4).round(3).tolist()) for i in range(1500)]
    found = nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") % 50 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    asked = brute_nearest(rows, 5, lambda i: i % 50 == 0)
    assert got[0] == [3, 6, 9, 12, 15] and got[150] == [0, 3, 6, 9, 12]
    assert set(got) == set(asked)
    assert sum(len(set(got[q]) & {j for j, _ in asked[q]}) for q in asked) >= 0.95 * 5 * len(asked)
