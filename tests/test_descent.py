"""Fits that are stored and continued: against one long fit, against numpy and against the library's optimiser."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusflow.operators import models as mo
from corpusflow.operators import descent
from corpusflow.operators.descent import Fit, advance, blocks_of, load_fits, packed, save_fits, sparse_rows
from corpusflow.session import materialise

COLUMNS = 9


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(11)
    x = rng.standard_normal((240, COLUMNS)) * (rng.random((240, COLUMNS)) < 0.5)
    classes = (x[:, :3] + 0.4 * rng.standard_normal((240, 3))).argmax(axis=1).astype(float)
    scores = x @ rng.standard_normal(COLUMNS) + 2.0 + 0.1 * rng.standard_normal(240)
    return x, classes, scores


@pytest.fixture(scope="module")
def vectors(spark, made):
    x, classes, scores = made

    def vector(r):
        return Vectors.sparse(COLUMNS, [(int(j), float(r[j])) for j in np.flatnonzero(r)])

    rows = [("classes", float(c), vector(r)) for r, c in zip(x, classes, strict=True)]
    rows += [("scores", float(s), Vectors.dense(r)) for r, s in zip(x, scores, strict=True)]
    return materialise(spark.createDataFrame(rows, ["model", "label", "features"]).repartition(3), "fits")


def fresh():
    return {"classes": Fit("softmax", 3, COLUMNS, 240, 1e-8), "scores": Fit("squared", 1, COLUMNS, 240, 1e-8)}


def sparse(vectors):
    return sparse_rows(vectors, "features", "label", "model", label_type="double")


def test_epochs_equal_one_long_fit(spark, vectors, tmp_path):
    rows, whole, fits = sparse(vectors), fresh(), fresh()
    advance(rows, whole, 12)
    for epoch in range(4):
        if epoch:
            fits = load_fits(spark, str(tmp_path / str(epoch - 1)))
        advance(rows, fits, 3)
        save_fits(spark, fits, str(tmp_path / str(epoch)))
        assert all(f.descent.steps == 3 * epoch + 3 for f in fits.values() if not f.descent.done)
    for m, fit in load_fits(spark, str(tmp_path / "3")).items():
        assert fit.descent.steps == whole[m].descent.steps and fit.descent.done == whole[m].descent.done
        assert abs(fit.descent.loss - whole[m].descent.loss) < 1e-9
        assert np.abs(fit.descent.at - whole[m].descent.at).max() < 1e-7


def test_models_fitted_together_equal_those_fitted_alone(vectors):
    rows, both = sparse(vectors), fresh()
    advance(rows, both, 5)
    for m in both:
        alone = {m: fresh()[m]}
        advance(rows, alone, 5)
        assert np.abs(alone[m].descent.at - both[m].descent.at).max() < 1e-8


def test_squared_loss_ends_at_the_ridge_solution(spark, vectors, made):
    x, _, scores = made
    fits = {"scores": fresh()["scores"]}
    advance(sparse(vectors), fits, 200)
    assert fits["scores"].descent.done
    full = np.hstack([x, np.ones((240, 1))])
    best = np.linalg.solve(full.T @ full + np.diag([1.0] * COLUMNS + [0.0]), full.T @ scores)
    model = fits["scores"].model(spark)
    assert np.abs(np.append(model.coefficients.toArray(), model.intercept) - best).max() < 1e-5
    mine = vectors.where("model = 'scores'")
    error = model.transform(mine).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    assert abs(error - ((full @ best - scores) ** 2).mean()) < 1e-6


def test_softmax_ends_where_the_library_does(spark, vectors):
    fits = {"classes": fresh()["classes"]}
    advance(sparse(vectors), fits, 300)
    mine = vectors.where("model = 'classes'")
    other = mo.fit_classifier(mine, "lr", label="label")
    model = fits["classes"].model(spark)
    ours, theirs = (m.coefficientMatrix.toArray() for m in (model, other))
    assert np.abs(ours - theirs).max() < 1e-2  # the library ends at a looser tolerance
    same = model.transform(mine).select("label", F.col("prediction").alias("a"), "features")
    assert same.where("a <> label").count() <= other.transform(mine).where("prediction <> label").count() + 2


def test_rows_without_entries_and_no_steps(spark):
    rows = spark.createDataFrame([("m", 1.0, Vectors.sparse(4, [])), ("m", 3.0, Vectors.sparse(4, []))], ["model", "label", "features"])
    fits = {"m": Fit("squared", 1, 4, 2)}
    assert advance(sparse(rows), fits, 0) == 0 and fits["m"].descent.gradient is None
    advance(sparse(rows), fits, 50)
    assert abs(fits["m"].model(spark).intercept - 2.0) < 1e-6
    with pytest.raises(ValueError):
        advance(sparse(rows), {"m": Fit("softmax", 100, 1_000_000, 2)}, 1)


def test_blocks_hold_every_row(spark, monkeypatch):
    """A row without entries, one longer than a block, and models mixed in one batch; numbers travel as bytes."""
    monkeypatch.setattr(descent, "ENTRIES", 5)
    given = [("ab"[i % 2], float(i), list(range(n)), [i + 0.5 * k for k in range(n)]) for i, n in enumerate([0, 3, 2, 9, 0, 1, 4, 4, 0])]
    rows = spark.createDataFrame(given, "model string, label double, indices array<int>, values array<double>").coalesce(1)
    blocks = packed(rows)
    assert {kind for name, kind in blocks.dtypes if name != "model"} == {"binary"}
    found = []
    for model, label, place, at, x in blocks_of(blocks.toArrow().to_batches()):
        assert len(at) <= 5 or len(label) == 1
        found += [(model, y, at[place == i].tolist(), x[place == i].tolist()) for i, y in enumerate(label)]
    assert sorted(found) == sorted(given)
    assert packed(rows.limit(0)).count() == 0
