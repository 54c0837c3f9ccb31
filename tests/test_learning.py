import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusflow.catalog.learning import STOP_WORDS, examples
from corpusflow.operators import dedup, features as fe, models as mo, tasks as ta
from corpusflow.operators.descent import load_fits
from corpusflow.plans import classify, corpus as pc, explore, multitask
from corpusflow.session import checkpoint_root, materialise
from corpusflow.sources import readers, stores, writers

DOCS = "{}/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(DOCS.format(sf_dir)).select("doc_id", "text", "lang")
    return materialise(dedup.drop_duplicate_texts(rows))


def test_vectors_and_rows_hold_the_same_weights(docs):
    model = fe.fit_tfidf(docs, 50, stop_words=STOP_WORDS)
    counter = next(s for s in model.stages if hasattr(s, "vocabulary"))
    vectors = fe.add_tfidf(docs, model).select("doc_id", vector_to_array("features").alias("v"))
    wide = {r["doc_id"]: np.array(r["v"]) for r in vectors.collect()}
    rows = fe.tfidf_rows(docs, 50, stop_words=STOP_WORDS).collect()
    place = {t: i for i, t in enumerate(counter.vocabulary)}
    dense = {i: np.zeros(50) for i in wide}
    for r in rows:
        dense[r["doc_id"]][place[r["term"]]] = r["weight"]
    assert all(np.allclose(wide[i], dense[i]) for i in wide)
    assert fe.vocabulary_size(model) == 50


def test_principal_components_match_numpy(spark):
    rng = np.random.default_rng(0)
    data = rng.standard_normal((300, 12)) * np.array([9, 5] + [1] * 10) + 3
    data[:, 5:][rng.random((300, 7)) < 0.7] = 0.0
    schema = StructType([StructField("doc_id", LongType()), StructField("features", VectorUDT())])
    # a mix of sparse and dense vectors over several partitions
    rows = [
        (i, Vectors.dense(r) if i % 2 else Vectors.sparse(12, [(j, float(v)) for j, v in enumerate(r) if v]))
        for i, r in enumerate(data)
    ]
    df = spark.createDataFrame(rows, schema).repartition(5).persist()
    centred = data - data.mean(axis=0)
    _, _, right = np.linalg.svd(centred, full_matrices=False)
    expected = np.abs(centred @ right[:2].T)
    for limit in (100, 1):  # direct, then subspace iteration
        got = fe.principal_components(df, 12, max_covariance=limit).orderBy("doc_id").collect()
        scores = np.abs(np.array([[r["x"], r["y"]] for r in got]))
        assert np.allclose(scores, expected, atol=1e-4)


@pytest.mark.parametrize("kind, iterations", [("lr", 30), ("svm", 10)])
def test_language_classifier_beats_the_majority(docs, kind, iterations):
    run = classify.classify_corpus(docs, "lang", kind, max_terms=300, max_iter=iterations, stop_words=STOP_WORDS)
    summary = run.summary.first()
    shares = [r["support"] for r in run.report.collect()]
    assert summary["n_rows"] == sum(shares)
    assert summary["accuracy"] > max(shares) / sum(shares) + 0.1
    assert {r["class_name"] for r in run.report.collect()} <= {"de", "en", "es", "fr"}


def test_cluster_layout(docs):
    rows = explore.cluster_layout(docs.withColumnRenamed("lang", "source"), max_terms=100, stop_words=STOP_WORDS)
    got = rows.collect()
    assert len(got) == docs.count() and {r["cluster"] for r in got} == {0, 1, 2}
    assert abs(np.mean([r["x"] for r in got])) < 1e-6


def test_model_store(spark, docs, tmp_path):
    path = str(tmp_path / "m")
    assert stores.load_model(spark, path) is None
    model = fe.fit_tfidf(docs, 20, stop_words=STOP_WORDS)
    stores.save_model(model, path)
    again = stores.load_model(spark, path)
    a, b = (m.transform(docs).select(F.sum(vector_to_array("features")[0])).first()[0] for m in (model, again))
    assert a == b


def test_regression_and_errors(spark):
    rows = spark.createDataFrame([([float(i), 1.0], float(2 * i)) for i in range(20)], "a array<double>, label double")
    rows = rows.withColumn("features", array_to_vector("a"))
    out = mo.predict(rows, mo.fit_regressor(rows, penalty=0.0)).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert out < 0.5
    with pytest.raises(ValueError):
        mo.fit_classifier(rows.withColumn("label_id", F.lit(0)), "tree")


def test_custom_model_is_batched(spark):
    def make():
        def run(x):
            return np.stack([x.sum(axis=1), np.full(len(x), float(len(x) <= 4))], axis=1)

        return run

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "i int, v array<double>").repartition(2)
    got = mo.score_with(rows, make, "v", batch_size=4, input_shapes=[[2]]).collect()
    assert all(r["logits"] == [r["i"] + 1.0, 1.0] for r in got)
    rows = rows.withColumn("logits", F.array(F.lit(2.34), F.lit(7.0))).withColumn("is_regression", F.col("i") % 2 == 0)
    assert {(r["i"] % 2, r["prediction"]) for r in mo.finish_predictions(rows).collect()} == {(0, 2.3), (1, 1.0)}


def test_text_columns():
    assert ta.text_columns(["idx", "sentence1", "sentence2", "question", "sentence"], True) == ("sentence1", "sentence2")
    assert ta.text_columns(["question", "sentence"], True) == ("question", "sentence")
    assert ta.text_columns(["text", "sentence"], False) == ("sentence",)
    for columns, pair in ((["sentence1", "hypothesis"], True), (["body"], False)):
        with pytest.raises(ValueError):
            ta.text_columns(columns, pair)


def test_tasks_report_a_metric_of_the_callers(spark, sf_dir, tmp_path):
    def measure(rows, keys):
        return rows.groupBy(*keys).agg(F.avg(F.size("logits")).alias("value")).withColumn("metric", F.lit("width"))

    rows = examples(spark, sf_dir)
    broken = rows.where("task = 'rte'").withColumn("label", F.col("label") + 0.5)
    config = multitask.TrainConfig(1, 1, 10, 2, tuple(STOP_WORDS))
    wanted = (("mnli", "MNLI", "width", True, False, 3), ("stsb", "STS-B", "width", True, True, 1), ("rte", "RTE", "width", True, False, 2))
    kept = rows.where("task IN ('mnli', 'stsb')").unionByName(broken)
    results, _ = multitask.train_all_tasks(kept, str(tmp_path / "m"), config, wanted, measure)
    assert {(r["task"], r["best_metric"], r["status"]) for r in results.collect()} == {("mnli", 3.0, "ok"), ("stsb", 1.0, "ok"), ("rte", None, "failed")}


def test_tasks_train_predict_and_survive_a_failure(spark, sf_dir, tmp_path):
    rows = examples(spark, sf_dir)
    config = multitask.TrainConfig(epochs=2, iterations_per_epoch=2, max_terms=30, parallel_tasks=2, stop_words=tuple(STOP_WORDS))
    wanted = tuple(t for t in ta.TASKS if t[0] in ("cola", "stsb", "mnli")) + (("none", "None", "accuracy", False, False, 2),)
    results, history = multitask.train_all_tasks(rows, str(tmp_path / "m"), config, wanted)
    got = {r["task"]: r for r in results.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"cola": "ok", "stsb": "ok", "mnli": "ok", "none": "failed"}
    assert got["none"]["error"] and got["cola"]["saved_epoch"] == 2
    assert got["mnli"]["val_acc_matched"] is not None and got["mnli"]["val_acc_mismatched"] is not None
    assert history.count() == 6
    states = {e: load_fits(spark, str(tmp_path / "m" / "epochs" / str(e))) for e in (1, 2)}
    assert {(k, e, f.descent.steps) for e, fits in states.items() for k, f in fits.items()} == {(k, e, 2 * e) for k in ("cola", "stsb", "mnli") for e in (1, 2)}
    scored = multitask.predict_all_tasks(rows, str(tmp_path / "m"), ta.TASKS)
    files = ta.submission_rows(scored, ta.task_dim(spark), ta.output_dim(spark))
    outputs = {r["output_name"] for r in files.select("output_name").distinct().collect()}
    assert outputs == {"CoLA", "STS-B", "MNLI-m", "MNLI-mm", "AX"}
    missing = ta.missing_outputs(ta.output_dim(spark), files)
    assert {r["output_name"] for r in missing.collect()} == {o[2] for o in ta.OUTPUTS} - outputs
    scores = [r["prediction"] for r in files.where("output_name = 'STS-B'").collect()]
    assert all(len(s.split(".")[1]) == 1 and 0 <= float(s) <= 5 for s in scores)
    writers.write_submissions(files, str(tmp_path / "sub"))
    parts = list((tmp_path / "sub").glob("output_name=AX/*.csv"))
    lines = parts[0].read_text().splitlines()
    assert len(parts) == 1 and lines[0] == "index\tprediction"
    assert [int(x.split("\t")[0]) for x in lines[1:]] == sorted(int(x.split("\t")[0]) for x in lines[1:])


def test_csv_keeps_every_character(spark, tmp_path):
    texts = ['a "quoted", text', "line one\nline two\r\nthree", "  outer blanks  ", "tab\tand\\slash", "é😀", '"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")
    writers.write_corpus(rows, str(tmp_path / "c"), "csv")
    back = readers.read_csv(spark, str(tmp_path / "c"), "n int, text string")
    assert [r["text"] for r in back.orderBy("n").collect()] == texts
    table = readers.ingest_csv(spark, str(tmp_path / "c"), str(tmp_path / "t"), "n int, text string", source_no=2)
    ids = [r["doc_id"] for r in table.collect()]
    assert len(set(ids)) == len(texts) and all(i >> 58 == 2 for i in ids)
    with pytest.raises(ValueError):
        writers.write_corpus(rows, str(tmp_path / "x"), "xml")


def test_ingested_ids_follow_paths(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4000), ("c", 50)):
        (tmp_path / f"{name}.csv").write_text("text\n" + "".join(f"{name}{i:05d}\n" for i in range(n)))
    rows = readers.ingest_csv(spark, f"{tmp_path}/*.csv", f"{tmp_path}/table").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows]
    assert texts == sorted(texts) and len(set(r["doc_id"] for r in rows)) == 4053


def test_prepare_corpus_rules(spark):
    schema = "doc_id bigint, text string"
    fake = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None)], schema)
    true = spark.createDataFrame([(11, "CITY - x y"), (12, "x\xa0y")], schema)
    news = spark.createDataFrame(
        [(21, "x y", "en", "real"), (22, "a b", "en", "neural"), (23, "n", "de", "neural"), (24, None, "en", "neural")],
        "doc_id bigint, body string, language string, label string",
    )
    got = {(r["doc_id"], r["source"], r["text"]) for r in pc.prepare_corpus(fake, true, news, 0, 99).collect()}
    assert got == {(1, "fake", "a b"), (3, "fake", ""), (11, "true", "x y"), (22, "neural", "a b")}
    everywhere = pc.prepare_corpus(fake, true, news, 1, 99, dedup_scope="global")
    assert {r["doc_id"] for r in everywhere.collect()} == {1, 11}
    assert {r["length"] for r in pc.prepare_corpus(fake, true, news, 4, 9).collect()} == set()
    with pytest.raises(ValueError):
        pc.prepare_corpus(fake, true, news, dedup_scope="none")


def test_bucketed_corpus_is_not_reshuffled(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as doc_id", "concat('t', id % 150) as text")
    writers.write_bucketed(rows, "bucketed_corpus", 4, path=str(tmp_path / "b"))
    table = spark.table("bucketed_corpus")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dedup.drop_duplicate_texts(table)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_corpus")
    # one exchange groups the digests, one brings the ids back; the text side has none
    assert plan.count("Exchange hashpartitioning") == 2


def test_checkpoint_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_root(spark) == (named or checkpoint_root(spark))
    assert spark.sparkContext.getCheckpointDir()


def test_classifier_on_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], rng.normal(2.0 * (i % 2), 1.0, 4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, kind string, embedding array<double>")
    for kind in ("lr", "svm"):
        run = classify.classify_vectors(fe.embedding_column(df), "kind", id_col="vec_id", kind=kind)
        found = run.summary.first()
        assert found["n_rows"] == 80 and found["accuracy"] > 0.9


def test_word_averages_separate_languages(docs):
    from corpusflow.catalog.checked import word_average_report

    report = word_average_report(docs.sparkSession, "/root/testdata/sf0.001").collect()
    hits = sum(r["recall"] * r["support"] for r in report)
    assert hits / sum(r["support"] for r in report) > 0.8


def test_word_vectors_are_learned_in_many_tasks(spark):
    rows = [(i, f"red blue green {'one two' if i % 2 else 'uno dos'} w{i % 7}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = fe.fit_word_average(df, size=4, chars_per_part=2000).stages[-1]
    assert 1 < model.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert model.getVectors().count() == 14 and fe.fit_word_average(df, size=4).stages[-1].getNumPartitions() == 1


def test_weights_move_only_repeated_ids(spark):
    """Equal to the weights by joins, with ids that repeat or are null; rows of other ids are not shuffled."""
    rows = [(i, f"alpha beta{i % 3} gamma gamma w{i}") for i in range(30)]
    rows += [(3, "beta0 delta"), (3, "alpha"), (None, "gamma eta"), (None, "eta"), (50, None), (51, ""), (52, "the x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")

    def weights(found):
        return {(r["doc_id"], r["term"]): r["weight"] for r in found.collect()}

    for n in (1, 4, 100):
        mine, joined = (weights(f(df, n, "text", "doc_id", ["the"])) for f in (fe.tfidf_rows, fe._tfidf_by_join))
        assert mine.keys() == joined.keys() and all(abs(mine[k] - joined[k]) < 1e-9 for k in mine)
    assert fe.tfidf_rows(df.limit(0)).count() == 0 and fe.tfidf_rows(df.where("doc_id = 51")).columns == ["doc_id", "term", "weight"]
    alone = fe.tfidf_rows(df.where("doc_id between 4 and 40"), 100)
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Union")[1].split("Project")[0] and plan.count("Window [") <= 1
    assert alone.count() == 26 * 4


def test_examples_of_the_tasks_asked_for(spark, tmp_path):
    """The tables of other tasks are not written; the rows of a task are the same either way."""
    docs = [(i, f"text {i} " * (1 + i % 4), "en" if i % 2 else "fr", 9) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    said = [(i // 4, i % 4, "user", f"turn {i} " * (1 + 40 * (i % 3))) for i in range(60)]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    every = examples(spark, str(tmp_path))
    for asked in (("mnli", "ax"), ("cola", "stsb")):
        some = examples(spark, str(tmp_path), asked)
        assert {r["task"] for r in some.select("task").distinct().collect()} == set(asked)
        same = every.where(F.col("task").isin(list(asked))).select(*some.columns)
        assert some.count() == same.count() > 0 and some.exceptAll(same).count() == 0


def _task_rows(spark, texts, task="cola", split=("train", "train", "validation", "test")):
    rows = [(task, split[i % len(split)], "", i, t, None, float(i // 4 % 2)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "task string, split string, variant string, idx bigint, text_a string, text_b string, label double")


def test_null_texts_are_trained_and_scored_as_empty_ones(spark, tmp_path):
    """They made every task fail, and a failed task has no row among the submissions."""
    config, cola = multitask.TrainConfig(1, 1, 10, 1, ("the",)), ta.TASKS[:1]
    found = []
    for name, none in (("null", None), ("empty", "")):
        rows = _task_rows(spark, [none if i % 7 == 3 else f"red w{i % 3} blue" for i in range(40)])
        results, _ = multitask.train_all_tasks(rows, str(tmp_path / name), config, cola)
        scored = multitask.predict_all_tasks(rows, str(tmp_path / name), cola, ta.OUTPUTS[:1])
        found.append((results.collect(), sorted(map(repr, scored.collect()))))
    assert found[0] == found[1] and found[0][0][0]["status"] == "ok" and len(found[0][1]) == 10


def test_a_failed_run_is_no_result(spark, tmp_path, monkeypatch):
    """Only what is wrong with a task's rows becomes its error row; anything else is raised."""
    config, rows = multitask.TrainConfig(1, 1, 10, 1, ("the",)), _task_rows(spark, [f"red w{i % 3}" for i in range(40)])
    results, _ = multitask.train_all_tasks(rows.withColumn("text_a", F.lit("the")), str(tmp_path / "a"), config, ta.TASKS[:1])
    assert [(r["status"], r["error"]) for r in results.collect()] == [("failed", "ValueError: no terms left to build features from")]

    def full(*_):
        raise OSError("No space left on device")

    monkeypatch.setattr(multitask, "_prepare", full)
    with pytest.raises(OSError):
        multitask.train_all_tasks(rows, str(tmp_path / "b"), config, ta.TASKS[:1])


def test_test_rows_without_a_model_are_an_error(spark, monkeypatch):
    from corpusflow.catalog import learning

    monkeypatch.setattr(learning, "TRAINING", multitask.TrainConfig(1, 1, 10, 1, ("the",)))
    cola, output = ta.TASKS[:1], ta.OUTPUTS[:1]
    rows = _task_rows(spark, [f"red w{i % 3}" for i in range(40)])
    assert learning._scored(spark, rows, cola, output).count() == 10
    unlearned = rows.where("split <> 'validation'")
    with pytest.raises(ValueError, match="CoLA .*no validation rows"):
        learning._scored(spark, unlearned, cola, output)
    assert learning._scored(spark, unlearned.where("split = 'train'"), cola, output).count() == 0


def test_a_run_stores_texts_and_numbers_once(spark, tmp_path, monkeypatch):
    """One table of texts for all single tasks and one of pairs; of a task's rows only blocks of bytes, scored like its model."""
    from corpusflow.catalog import learning
    from corpusflow.operators.descent import logits_of

    tables, write = [], learning.materialise
    monkeypatch.setattr(learning, "materialise", lambda df, name="t", by=(): (tables.append((name, sorted(df.columns))), write(df, name, by))[1])
    docs = [(i, f"text w{i % 3} " * (1 + i % 4), "en" if i % 2 else "fr", 9) for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    said = [(i // 4, i % 4, "user", f"turn w{i % 5} " * (1 + 40 * (i % 3))) for i in range(80)]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = examples(spark, str(tmp_path))
    assert tables == [("texts", ["idx", "label", "sentence", "split"]), ("pairs", ["idx", "length", "sentence1", "sentence2", "split"])]

    asked, seen, scored = tuple(t for t in ta.TASKS if t[0] in ("sst2", "stsb", "mnli")), [], multitask.logits_of
    monkeypatch.setattr(multitask, "logits_of", lambda blocks, fits, keep: (seen.append((blocks, dict(fits))), scored(blocks, fits, keep))[1])
    multitask.train_all_tasks(rows, str(tmp_path / "m"), multitask.TrainConfig(1, 2, 10, 2, ("the",)), asked)
    assert {k for _, fits in seen for k in fits} == {"sst2", "stsb", "mnli"}
    for blocks, fits in seen:
        assert {c: kind for c, kind in blocks.dtypes if kind == "binary"}.keys() == {"label", "sizes", "indices", "values"}
        mine = logits_of(blocks, fits, ("split", "variant"))
        for key in fits:
            labelled = rows.where((F.col("task") == key) & F.col("split").isin("train", "validation") & F.col("label").isNotNull())
            theirs = multitask.add_logits(labelled, stores.load_model(spark, str(tmp_path / "m" / key)), key == "stsb")
            found = [
                sorted((r["split"], r["variant"], r["label"], *[round(x, 9) + 0.0 for x in r["logits"]]) for r in table.collect())
                for table in (mine.where(F.col("model") == key), theirs)
            ]
            assert found[0] == found[1] and found[0]
