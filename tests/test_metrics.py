import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corpusflow.functions import arrays as ar
from corpusflow.operators import history as hi, metrics as me, profile as pr

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def average_rank(values):
    values = np.asarray(values, dtype=float)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def correlation(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.std() == 0 or y.std() == 0:
        return None
    return float(((x - x.mean()) * (y - y.mean())).mean() / (x.std() * y.std()))


def reference_scores(pairs):
    y, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    classes = sorted(set(y) | set(p))
    table = {}
    for c in classes:
        tp, got, sup = ((y == c) & (p == c)).sum(), (p == c).sum(), (y == c).sum()
        pre, rec = tp / got if got else 0.0, tp / sup if sup else 0.0
        table[c] = (pre, rec, 2 * pre * rec / (pre + rec) if pre + rec else 0.0, sup)
    n = len(y)
    c_all, pk, tk = (y == p).sum(), [(p == c).sum() for c in classes], [(y == c).sum() for c in classes]
    bottom = math.sqrt((n * n - sum(v * v for v in pk)) * (n * n - sum(v * v for v in tk)))
    mcc = (c_all * n - sum(a * b for a, b in zip(pk, tk))) / bottom if bottom else 0.0
    return table, (y == p).mean(), mcc


@QUICK
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), min_size=1, max_size=60))
def test_classification_scores(spark, pairs):
    rows = spark.createDataFrame(pairs, "label int, prediction int")
    table, accuracy, mcc = reference_scores(pairs)
    report = {r["class"]: tuple(r)[1:] for r in me.class_report(rows).collect()}
    assert set(report) == set(table)
    for cls, scores in table.items():
        assert report[cls] == pytest.approx(scores, abs=1e-9)
    summary = me.classification_summary(rows).first()
    supports = np.array([v[3] for v in table.values()], float)
    assert summary["accuracy"] == pytest.approx(accuracy)
    assert summary["mcc"] == pytest.approx(mcc, abs=1e-9)
    f1 = np.array([v[2] for v in table.values()])
    assert summary["f1_weighted"] == pytest.approx((f1 * supports).sum() / supports.sum())
    assert summary["f1_macro"] == pytest.approx(f1.mean())


@QUICK
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(0, 9)), min_size=2, max_size=50))
def test_correlations(spark, pairs):
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "prediction double, label double")
    x, y = zip(*pairs)
    got = me.correlation_summary(rows).first()
    for name, expected in (("pearson", correlation(x, y)), ("spearman", correlation(average_rank(x), average_rank(y)))):
        if expected is None:
            assert got[name] is None
        else:
            assert got[name] == pytest.approx(expected, abs=1e-9)


def test_average_ranks(spark):
    rows = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,)], "v double")
    assert {(r["value"], r["rank"]) for r in me.average_ranks(rows, "v").collect()} == {(10, 1), (20, 2.5), (30, 4)}


def test_average_ranks_over_many_ranges(spark):
    """A third of the rows share one value; ranges are much smaller than the data."""
    rng = np.random.default_rng(1)
    values = [0.5 if i % 3 == 0 else float(v) for i, v in enumerate(rng.random(900))]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    expected = dict(zip(values, average_rank(values)))
    assert {r["value"]: r["rank"] for r in me.average_ranks(rows, "v", bounds=16).collect()} == expected


def test_constant_input_gives_null(spark):
    rows = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1)], "prediction double, label double")
    assert me.correlation_summary(rows).first().asDict() == {"pearson": None, "spearman": None, "pearson_spearman": None}


def test_logits(one, spark):
    assert one(ar.argmax("a"), a=("array<float>", [1.0, 3.0, 3.0])) == 1
    loss = one(ar.row_cross_entropy("a", "y"), a=("array<float>", [1000.0, 0.0]), y=("int", 1))
    assert loss == pytest.approx(1000.0)
    rows = spark.createDataFrame([([0.2, 0.8, -1.0], 1), ([2.0, 0.0, 0.0], 2)], "logits array<double>, label int")
    logits = np.array([[0.2, 0.8, -1.0], [2.0, 0.0, 0.0]])
    expected = np.mean(np.log(np.exp(logits).sum(axis=1)) - logits[[0, 1], [1, 2]])
    assert me.mean_cross_entropy(rows).first()[0] == pytest.approx(expected)
    assert me.metrics_from_logits(rows).first()["accuracy"] == 0.5


def test_clip_and_round_matches_numpy(spark):
    values = np.concatenate([np.arange(-100, 600, dtype=np.float32) / np.float32(100), np.float32([2.35, 5.7, -0.2])])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x float")
    got = [r["o"] for r in rows.select("i", ar.clip_and_round("x").alias("o")).orderBy("i").collect()]
    expected = np.round(np.clip(values, 0.0, 5.0), decimals=1)
    assert np.array_equal(np.float32(got), expected)
    assert got[-3:] == [2.4, 5.0, 0.0]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 5000, 400), np.full(7, 9)
    rows = spark.createDataFrame([("a", int(v)) for v in a] + [("b", int(v)) for v in b], "source string, length int")
    got = {(r["source"], r["bin"]): r["n_rows"] for r in pr.length_histogram(rows).collect()}
    for name, values in (("a", a), ("b", b)):
        counts, _ = np.histogram(values, bins=40)
        assert [got[(name, i)] for i in range(40)] == counts.tolist()


def test_history(spark):
    rows = spark.createDataFrame(
        [("t", e, 1.0, loss, "accuracy", m, f"p{e}") for e, loss, m in ((1, 0.5, 0.7), (2, 0.3, 0.9), (3, 0.3, 0.9), (4, 0.6, 0.8))],
        "task string, epoch int, train_loss double, val_loss double, metric_name string, val_metric double, model_path string",
    )
    result = hi.run_results(rows).first()
    assert (result["best_metric"], result["best_epoch"], result["saved_epoch"], result["final_loss"]) == (0.9, 2, 4, 0.6)
    best = hi.best_checkpoint(rows).first()
    assert (best["model_path"], best["epoch"]) == ("p2", 2)
    assert hi.history_curves(rows).where(F.col("series") == "accuracy").count() == 4


def test_confusion_matrix_fills_zeros(spark):
    rows = spark.createDataFrame([(0, 1), (0, 0)], "label int, prediction int")
    got = {tuple(r) for r in me.confusion_matrix(rows, [0, 1]).collect()}
    assert got == {(0, 1, 1), (1, 0, 0)}


def test_missing_prediction_is_no_hit(spark):
    rows = spark.createDataFrame([(None, None), (1, 1), (1, None), (0, 1)], "label int, prediction int")
    assert me.accuracy(rows).first()["accuracy"] == 0.25 == me.classification_summary(rows).first()["accuracy"]


def test_confusion_counts_every_row(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 7, 1), ("b", None, 1)], "k string, label int, prediction int")
    whole = {r["label"]: r.asDict() for r in me.confusion_matrix(rows, [1]).collect()}
    assert set(whole) == {1, 2, 7, None}
    assert sum(v for r in whole.values() for c, v in r.items() if c.startswith("pred_")) == 3
    assert whole[None]["pred_1"] == 1 and whole[2]["pred_7"] == 0
    assert me.confusion_matrix(rows, keys=["k"]).count() == 8


def test_spearman_of_a_constant_is_null_at_any_size(spark):
    rows = spark.range(3_000_007).select(F.lit(5.0).alias("prediction"), F.col("id").cast("double").alias("label"))
    assert me.spearman(rows).first()["spearman"] is None
    line = spark.range(3_000_007).select((F.col("id") * 2).cast("double").alias("prediction"), F.col("id").cast("double").alias("label"))
    assert abs(me.spearman(line).first()["spearman"] - 1) < 1e-12
