"""The sentence and sentence-pair benchmark: task table, inputs, evaluation, submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.functions.arrays import argmax, clip_and_round, row_cross_entropy, row_squared_error
from corpusflow.operators.metrics import classification_summary, correlation_summary

# Task, display name, reported metric, pair?, regression?, number of labels.
TASKS = (
    ("cola", "CoLA", "matthews_correlation", False, False, 2),
    ("sst2", "SST-2", "accuracy", False, False, 2),
    ("mrpc", "MRPC", "f1", True, False, 2),
    ("stsb", "STS-B", "pearson_spearman", True, True, 1),
    ("qqp", "QQP", "f1", True, False, 2),
    ("mnli", "MNLI", "accuracy", True, False, 3),
    ("qnli", "QNLI", "accuracy", True, False, 2),
    ("rte", "RTE", "accuracy", True, False, 2),
    ("wnli", "WNLI", "accuracy", True, False, 2),
)
# Test set (task, variant), its output file, and the task whose model scores it.
OUTPUTS = (
    ("cola", "", "CoLA", "cola"),
    ("sst2", "", "SST-2", "sst2"),
    ("mrpc", "", "MRPC", "mrpc"),
    ("stsb", "", "STS-B", "stsb"),
    ("qqp", "", "QQP", "qqp"),
    ("mnli", "matched", "MNLI-m", "mnli"),
    ("mnli", "mismatched", "MNLI-mm", "mnli"),
    ("qnli", "", "QNLI", "qnli"),
    ("rte", "", "RTE", "rte"),
    ("wnli", "", "WNLI", "wnli"),
    ("ax", "", "AX", "mnli"),
)
# Accepted column pairs, first match wins.
PAIR_COLUMNS = (
    ("sentence1", "sentence2"),
    ("premise", "hypothesis"),
    ("question", "sentence"),
    ("question1", "question2"),
)
SINGLE_COLUMNS = ("sentence", "text")


def _values(spark: SparkSession, rows: Sequence[tuple], names: str) -> DataFrame:
    listed = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({names})")


def task_dim(spark: SparkSession) -> DataFrame:
    """One row per task."""
    return _values(spark, TASKS, "task, name, metric, is_pair, is_regression, num_labels")


def output_dim(spark: SparkSession) -> DataFrame:
    """One row per prediction file."""
    return _values(spark, OUTPUTS, "task, variant, output_name, model_task")


def text_columns(columns: Sequence[str], is_pair: bool) -> tuple[str, ...]:
    """Which columns hold the text, decided from the schema."""
    if is_pair:
        for pair in PAIR_COLUMNS:
            if set(pair) <= set(columns):
                return pair
    else:
        for name in SINGLE_COLUMNS:
            if name in columns:
                return (name,)
    raise ValueError(f"no known text columns among {sorted(columns)}")


def to_examples(df: DataFrame, task: str, is_pair: bool, is_regression: bool = False) -> DataFrame:
    """Any task's table as ``(task, split, variant, idx, text_a, text_b, label)``.

    Labels of classification tasks are whole numbers, those of regression tasks are not rounded.
    """
    names = text_columns(df.columns, is_pair)
    label = F.col("label") if "label" in df.columns else F.lit(None)
    label = label.cast("double") if is_regression else label.cast("int").cast("double")
    return df.select(
        F.lit(task).alias("task"),
        (F.col("split") if "split" in df.columns else F.lit("train")).alias("split"),
        (F.col("variant") if "variant" in df.columns else F.lit("")).alias("variant"),
        F.col("idx").cast("bigint").alias("idx"),
        F.col(names[0]).alias("text_a"),
        (F.col(names[1]) if is_pair else F.lit(None).cast("string")).alias("text_b"),
        label.alias("label"),
    )


def with_task(df: DataFrame, dim: DataFrame, *columns: str) -> DataFrame:
    """Attach columns of the task table (one row per task definition)."""
    return df.join(F.broadcast(dim.select("task", *columns)), "task")


def evaluate_classes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long metric table of classification rows ``(keys, logits, label)``; one pass over them."""
    classed = rows.select(
        *keys,
        F.col("label").cast("int").alias("label"),
        argmax("logits").alias("prediction"),
        row_cross_entropy("logits", "label").alias("_row_loss"),
    )
    summary = classification_summary(classed, keys, loss="_row_loss").select(
        *keys, "accuracy", F.col("f1_weighted").alias("f1"), F.col("mcc").alias("matthews_correlation"), "loss"
    )
    return summary.unpivot(list(keys), ["accuracy", "f1", "matthews_correlation", "loss"], "metric", "value")


def evaluate_scores(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long metric table of regression rows ``(keys, logits, label)``."""
    scored = rows.select(*keys, "label", F.get("logits", F.lit(0)).cast("double").alias("prediction"))
    loss = F.avg(row_squared_error("prediction", "label")).alias("loss")
    summary = correlation_summary(scored, keys, more=[loss])
    return summary.unpivot(list(keys), ["pearson", "spearman", "pearson_spearman", "loss"], "metric", "value")


def evaluate_predictions(predictions: DataFrame, dim: DataFrame, keys: Sequence[str] = ("task", "variant")) -> DataFrame:
    """Long metric table ``(keys, metric, value)`` for all tasks at once.

    ``predictions`` holds ``logits`` (one score for regression) and ``label``; losses are row means.
    """
    rows = with_task(predictions.select(*keys, "logits", "label"), dim, "is_regression")
    return evaluate_classes(rows.where(~F.col("is_regression")), keys).union(
        evaluate_scores(rows.where("is_regression"), keys)
    )


def reported_metric(metrics: DataFrame, dim: DataFrame) -> DataFrame:
    """Of all metrics the one each task reports."""
    return metrics.join(F.broadcast(dim.select("task", "metric")), ["task", "metric"], "left_semi")


def available_tasks(dim: DataFrame, models: DataFrame) -> DataFrame:
    """Tasks that have a model."""
    return dim.join(models.select("task").distinct(), "task", "left_semi")


def missing_outputs(required: DataFrame, produced: DataFrame) -> DataFrame:
    """Required outputs nobody produced."""
    return required.join(produced.select("output_name").distinct(), "output_name", "left_anti")


def submission_rows(predictions: DataFrame, dim: DataFrame, outputs: DataFrame) -> DataFrame:
    """``(output_name, index, prediction)`` for every scored test row.

    The task whose model scored the row decides between class index and rounded score.
    """
    flags = outputs.join(
        dim.select(F.col("task").alias("model_task"), "is_regression"), "model_task"
    ).select("task", "variant", "output_name", "is_regression")
    # eleven outputs
    rows = predictions.join(F.broadcast(flags), ["task", "variant"])
    score = clip_and_round(F.get("logits", F.lit(0)))
    value = F.when(F.col("is_regression"), score.cast("string")).otherwise(argmax("logits").cast("string"))
    return rows.select("output_name", F.col("idx").alias("index"), value.alias("prediction"))
