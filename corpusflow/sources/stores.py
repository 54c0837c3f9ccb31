"""Vocabulary and model storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token_id", "token").write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token_id int, token string").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def model_exists(spark: SparkSession, path: str) -> bool:
    """Looks on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/metadata")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The fitted pipeline, or ``None`` when there is none at that path."""
    return PipelineModel.load(path) if model_exists(spark, path) else None
