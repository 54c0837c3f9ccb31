"""Training history and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def run_results(history: DataFrame) -> DataFrame:
    """Per task: best metric and its epoch, the last epoch (whose model is the one saved) and its loss."""
    return history.groupBy("task").agg(
        F.first("metric_name").alias("metric_name"),
        F.max("val_metric").alias("best_metric"),
        # earliest epoch among equal best values
        F.max_by(F.col("epoch"), F.struct("val_metric", -F.col("epoch"))).alias("best_epoch"),
        F.max("epoch").alias("saved_epoch"),
        F.max_by("val_loss", "epoch").alias("final_loss"),
    )


def best_checkpoint(history: DataFrame, path: str = "model_path", loss: str = "val_loss") -> DataFrame:
    """Per task the checkpoint with the lowest loss; the earliest epoch wins a tie."""
    order = F.struct(F.col(loss), F.col("epoch"))
    return history.groupBy("task").agg(
        F.min_by(F.col(path), order).alias(path), F.min_by(F.col("epoch"), order).alias("epoch"), F.min(loss).alias(loss)
    )


def history_curves(history: DataFrame) -> DataFrame:
    """``(task, epoch, series, value)``: the lines a training chart would draw."""
    return history.unpivot(
        ["task", "epoch", "metric_name"], ["train_loss", "val_loss", "val_metric"], "series", "value"
    ).select(
        "task",
        "epoch",
        F.when(F.col("series") == "val_metric", F.col("metric_name")).otherwise(F.col("series")).alias("series"),
        "value",
    )


def results_summary(results: DataFrame, task_dim: DataFrame) -> DataFrame:
    """Display name, metric and best score per task.  ``task_dim`` has one row per task definition."""
    return results.join(F.broadcast(task_dim.select("task", "name")), "task").select(
        "name", "metric_name", "best_metric"
    )


def variant_accuracy(metrics: DataFrame, variants=("matched", "mismatched")) -> DataFrame:
    """Accuracy of both evaluation variants side by side."""
    columns = [F.max(F.when(F.col("variant") == v, F.col("accuracy"))).alias(f"val_acc_{v}") for v in variants]
    return metrics.groupBy("task").agg(*columns)
