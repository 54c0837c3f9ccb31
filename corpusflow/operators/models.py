"""Training, prediction and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusflow.functions.arrays import argmax, clip_and_round
from corpusflow.operators.margins import fit_squared_hinge

SEED = 42


def fit_kmeans(df: DataFrame, k: int = 3, seed: int = SEED, column: str = "features", out: str = "cluster", max_iter: int = 20) -> Model:
    return KMeans(k=k, seed=seed, featuresCol=column, predictionCol=out, maxIter=max_iter).fit(df)


def fit_classifier(
    train: DataFrame,
    kind: str = "svm",
    features: str = "features",
    label: str = "label_id",
    max_iter: int | None = None,
    inverse_penalty: float = 1.0,
) -> Model:
    """``"lr"``: multinomial logistic regression.  ``"svm"``: one linear classifier per class, squared hinge.

    The penalty is that of a summed loss with ``C = inverse_penalty``: Spark averages the loss, so
    the weight becomes ``1 / (C n)``.  ``train`` should be persisted; every iteration reads it.
    """
    if kind == "lr":
        penalty = 1.0 / (inverse_penalty * max(train.count(), 1))
        return LogisticRegression(
            featuresCol=features, labelCol=label, maxIter=max_iter or 1000, family="multinomial",
            regParam=penalty, elasticNetParam=0.0, standardization=False,
        ).fit(train)
    if kind == "svm":
        return fit_squared_hinge(train, features, label, inverse_penalty, max_iter or 1000)
    raise ValueError("kind must be 'lr' or 'svm'")


def fit_regressor(
    train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 100, penalty: float | None = None
) -> Model:
    weight = 1.0 / max(train.count(), 1) if penalty is None else penalty
    return LinearRegression(
        featuresCol=features, labelCol=label, maxIter=max_iter, regParam=weight, solver="l-bfgs"
    ).fit(train)


def predict(df: DataFrame, model: Model | PipelineModel) -> DataFrame:
    """Score any table, batch or streaming, that has the model's input columns."""
    return model.transform(df)


def score_with(
    df: DataFrame,
    make_predict: Callable,
    *columns: str,
    out: str = "logits",
    batch_size: int = 16,
    input_shapes: list | None = None,
) -> DataFrame:
    """Logits from the caller's own model.

    ``make_predict`` loads the model once per Python worker and returns a function from a numpy
    batch to a numpy batch; Spark does the batching.
    """
    model = predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=input_shapes
    )
    return df.withColumn(out, model(*columns))


def score_tokens(
    df: DataFrame,
    make_predict: Callable,
    column: str = "input_ids",
    out: str = "logits",
    batch_size: int = 16,
    pad_id: int = 0,
) -> DataFrame:
    """Logits from the caller's model for unpadded token arrays.

    Each batch is padded to its own longest row, so short texts do not pay for long ones.  The
    predict function gets a ``(rows, width)`` integer matrix.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict_batch = make_predict()
        for part in parts:
            rows = part.to_numpy()
            scores: list = []
            for start in range(0, len(rows), batch_size):
                batch = rows[start : start + batch_size]
                padded = np.full((len(batch), max(1, *map(len, batch))), pad_id, dtype=np.int64)
                for i, ids in enumerate(batch):
                    padded[i, : len(ids)] = ids
                scores.extend(np.asarray(predict_batch(padded), dtype=np.float32))
            yield pd.Series(scores, dtype=object)

    return df.withColumn(out, run(column))


def finish_predictions(df: DataFrame, logits: str = "logits", out: str = "prediction") -> DataFrame:
    """Class index for classification rows, clipped and rounded score for regression rows.

    Reads the task's ``is_regression`` flag from the row.
    """
    score = clip_and_round(F.get(F.col(logits), F.lit(0)))
    return df.withColumn(out, F.when(F.col("is_regression"), score).otherwise(argmax(logits).cast("double")))
