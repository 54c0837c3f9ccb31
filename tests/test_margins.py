"""Squared-hinge classifiers: the gradient at the weights found, computed apart with numpy."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusflow.operators import models as mo
from corpusflow.operators.margins import fit_squared_hinge
from corpusflow.sources import stores


def gradient(x, y, w, b, c=1.0):
    short = np.maximum(0, 1 - y * (x @ w + b))
    return np.append(w - 2 * c * (y * short) @ x, b - 2 * c * (y * short).sum())


@pytest.mark.parametrize("dense", [True, False])
def test_gradient_is_near_zero(spark, tmp_path, dense):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 12)) * (rng.random((300, 12)) < 0.4)
    label = (x[:, :3] + 0.3 * rng.standard_normal((300, 3))).argmax(axis=1)
    vector = (lambda r: Vectors.dense(r)) if dense else (lambda r: Vectors.sparse(12, [(int(j), float(r[j])) for j in np.flatnonzero(r)]))
    made = [(vector(r), int(c)) for r, c in zip(x, label, strict=True)] + [(None, 1), (vector(x[0]), None)]
    rows = spark.createDataFrame(made, ["features", "label_id"])
    model = fit_squared_hinge(rows, tolerance=1e-4)
    for c, m in enumerate(model.models):
        y = np.where(label == c, 1.0, -1.0)
        g = gradient(x, y, m.coefficients.toArray(), m.intercept)
        assert np.linalg.norm(g) <= 2e-4 * np.linalg.norm(gradient(x, y, np.zeros(12), 0.0))
    good = rows.dropna()
    scored = mo.predict(good, model)
    weights, bias = np.stack([m.coefficients.toArray() for m in model.models]), np.asarray([m.intercept for m in model.models])
    assert [int(r["prediction"]) for r in scored.collect()] == (x @ weights.T + bias).argmax(axis=1).tolist()
    stores.save_model(model, str(tmp_path / "svm"))
    with pytest.raises(ValueError):
        fit_squared_hinge(rows.where(F.col("label_id") > 9))


def test_gradient_norms_from_the_rows(spark):
    """Every row counts once, whatever its other columns; rows without entries too."""
    from corpusflow.catalog.checked import _gradient_norms

    rng = np.random.default_rng(5)
    x, label = rng.standard_normal((200, 9)) * (rng.random((200, 9)) < 0.3), rng.integers(0, 3, 200)
    x[:5] = 0.0
    made = [(int(c), [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r, c in zip(x, label, strict=True)]
    rows = spark.createDataFrame(made, "label int, indices array<int>, values array<double>").repartition(4)
    weights, bias = rng.standard_normal((3, 9)), rng.standard_normal(3)

    def pulls(margins, label):
        shares = np.exp(margins)
        return shares / shares.sum(axis=1, keepdims=True) - (label[:, None] == np.arange(3))

    found = _gradient_norms(rows, weights, bias, pulls)
    asked = [pulls(scale * (x @ weights.T + bias), label).T @ x + scale * weights for scale in (1, 0)]
    assert np.allclose(found, [np.linalg.norm(a, axis=1) for a in asked])


def test_vectors_from_stored_counts(spark):
    """The same vectors as the pipeline's, though the texts are cut into terms for counts only once."""
    from corpusflow.operators import features as fe

    docs = spark.createDataFrame([(1, "the red cat, the cat"), (2, "a dog"), (2, "a dog and a red cat"), (3, ""), (None, "cat")], "doc_id int, text string")
    for stops in ([], ["the", "a"], None):
        asked = fe.add_tfidf(docs, fe.fit_tfidf(docs, 6, stop_words=stops)).drop("text")
        found = fe.tfidf_vectors(docs, 6, stop_words=stops)
        assert found.columns == ["doc_id", "features"]
        assert sorted(map(str, found.collect())) == sorted(map(str, asked.collect()))
