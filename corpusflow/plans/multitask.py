"""Train, evaluate and predict all benchmark tasks."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.operators.corpus import concat_sources
from corpusflow.operators.descent import Fit, advance, in_blocks, load_fits, logits_of, save_fits, sparse_rows
from corpusflow.operators.features import MAX_TERMS, NoTermsError, fit_tfidf, vocabulary_size
from corpusflow.operators.history import run_results
from corpusflow.operators.tasks import OUTPUTS, TASKS, evaluate_classes, evaluate_scores
from corpusflow.session import scratch_path
from corpusflow.sources.stores import load_model, save_model

HISTORY_SCHEMA = "task string, epoch int, train_loss double, val_loss double, metric_name string, val_metric double"
RESULT_SCHEMA = (
    "task string, metric_name string, best_metric double, best_epoch int, saved_epoch int, final_loss double, "
    "val_acc_matched double, val_acc_mismatched double, status string, error string"
)


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 3
    iterations_per_epoch: int = 10
    max_terms: int = MAX_TERMS
    parallel_tasks: int = 3
    stop_words: tuple[str, ...] | None = None


def _with_texts(examples: DataFrame) -> DataFrame:
    """A null text is an empty one: the tokenizer of the features fails on nulls."""
    return examples.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("text_a", "text_b")})


def _featurise(train: DataFrame, is_pair: bool, config: TrainConfig) -> PipelineModel:
    stops = None if config.stop_words is None else list(config.stop_words)
    first = fit_tfidf(train, config.max_terms, "text_a", "features_a" if is_pair else "features", stops)
    if not is_pair:
        return first
    second = fit_tfidf(train, config.max_terms, "text_b", "features_b", stops)
    both = VectorAssembler(inputCols=["features_a", "features_b"], outputCol="features")
    return PipelineModel([first, second, both])


def add_logits(df: DataFrame, model, is_regression: bool) -> DataFrame:
    """Scores as ``ARRAY<DOUBLE>``: one entry per class, or the single regression value."""
    scored = model.transform(df)
    logits = F.array("prediction") if is_regression else vector_to_array("rawPrediction")
    return scored.withColumn("logits", logits)


def _prepare(examples: DataFrame, task: tuple, base: str, config: TrainConfig) -> PipelineModel:
    """Features of one task, learned on its training rows; its labelled rows are stored once, as blocks of numbers."""
    key, _, _, is_pair, is_regression, _ = task
    rows = examples.where((F.col("task") == key) & F.col("label").isNotNull())
    features = _featurise(rows.where(F.col("split") == "train"), is_pair, config)
    vectors = features.transform(rows.where(F.col("split").isin("train", "validation")))
    part = F.to_json(F.struct("split", "variant")).alias("model")
    blocks = in_blocks(sparse_rows(vectors.select(part, "label", "features"), "features", "label", "model", label_type="double"))
    part = F.from_json("model", "split string, variant string")
    blocks.select(part["split"].alias("split"), part["variant"].alias("variant"), *blocks.columns[1:]).write.parquet(f"{base}/task={key}")
    return features


def _width(features: PipelineModel) -> int:
    """Columns of a task's vectors: the terms of its one or two texts."""
    inner = [stage for stage in features.stages if isinstance(stage, PipelineModel)]
    return sum(map(_width, inner)) if inner else vocabulary_size(features)


def _new_fits(examples: DataFrame, tasks: dict[str, tuple], features: dict[str, PipelineModel]) -> tuple[dict[str, Fit], dict[str, str]]:
    """(fits at zero, errors) from one count of the labels of every task."""
    rows = examples.where(F.col("task").isin(list(tasks)) & F.col("split").isin("train", "validation") & F.col("label").isNotNull())
    rows = rows.select("task", "split", F.col("label").cast("double").alias("label"))
    whole = F.col("label") == F.floor("label")
    training = F.col("split") == "train"
    counts = rows.groupBy("task").agg(
        F.count_if(training).alias("train"), F.count_if(~training).alias("validation"), F.min("label").alias("low"),
        F.max("label").alias("high"), F.count_if(~whole).alias("broken"), F.count_if(F.isnan("label")).alias("odd"),
    )
    found, fits, errors = {r["task"]: r for r in counts.collect()}, {}, {}
    for key, task in tasks.items():
        r, is_regression = found.get(key), task[4]
        if r is None or not r["train"]:
            errors[key] = f"ValueError: no training rows for {key}"
        elif not r["validation"]:
            errors[key] = f"ValueError: no validation rows for {key}"
        elif r["odd"] or not is_regression and (r["broken"] or r["low"] < 0):
            errors[key] = f"ValueError: labels of {key} are not {'numbers' if is_regression else 'classes'}"
        else:
            outputs = 1 if is_regression else max(task[5], int(r["high"]) + 1)
            fits[key] = Fit("squared" if is_regression else "softmax", outputs, _width(features[key]), r["train"])
    return fits, errors


def _evaluate(blocks: DataFrame, fits: dict[str, Fit], measure: Callable | None) -> dict[str, dict]:
    """{task: {(split, variant, metric): value}}: a handful of numbers per task; the rows of all tasks of a kind in one job."""
    keys, parts = ("task", "split", "variant"), []
    for kind, evaluate in (("softmax", evaluate_classes), ("squared", evaluate_scores)):
        own = {key: fit for key, fit in fits.items() if fit.kind == kind}
        if own:
            rows = logits_of(blocks, own, keys[1:]).withColumnRenamed("model", "task")
            parts.append(evaluate(rows, keys))
            if measure is not None:
                parts.append(measure(rows, keys).select(*keys, "metric", F.col("value").cast("double").alias("value")))
    values: dict[str, dict] = {key: {} for key in fits}
    for r in concat_sources(parts).collect():
        values[r["task"]][r["split"], r["variant"], r["metric"]] = r["value"]
    return values


def train_all_tasks(
    examples: DataFrame, model_path: str, config: TrainConfig | None = None, tasks: tuple = TASKS, measure: Callable | None = None
) -> tuple[DataFrame, DataFrame]:
    """Train every task; a task whose rows cannot be trained on becomes a row with its error and the others go on.

    Returns ``(results, history)``.  Features are learned a few tasks at a time; then all tasks are fitted in the same
    passes.  An epoch is ``iterations_per_epoch`` steps of every task: it reads the states that the epoch before
    stored below ``model_path/epochs`` and stores its own.  Models of the last epoch are saved.

    ``measure(rows, keys)`` adds metrics of the caller's own: from rows of ``keys``, ``logits`` and ``label`` it returns rows of
    ``keys``, ``metric`` and ``value``.  A task may report one of them as its metric.

    * Rows without label take no part.  Labels of a classification are 0, 1, ...; others are the task's error.
    * A task without training or validation rows, or without any term, is an error row.  Null texts count as empty ones.
    * Every other failure (a lost executor, a full disk, ...) is raised: it says nothing about the task.
    """
    spark = examples.sparkSession
    config, examples = config or TrainConfig(), _with_texts(examples)
    base, errors, features = scratch_path(spark, "blocks"), {}, {}

    def attempt(task: tuple):
        try:
            return _prepare(examples, task, base, config)
        except NoTermsError as problem:  # the task's rows are at fault; anything else fails the run
            return f"ValueError: {problem}"

    with ThreadPoolExecutor(max_workers=config.parallel_tasks) as pool:
        for task, made in zip(tasks, pool.map(attempt, tasks), strict=True):
            (errors if isinstance(made, str) else features)[task[0]] = made
    by_key = {task[0]: task for task in tasks if task[0] in features}
    history, variants = [], {}
    if by_key:
        blocks = spark.read.option("basePath", base).parquet(*[f"{base}/task={key}" for key in by_key]).withColumnRenamed("task", "model")
        fits, wrong = _new_fits(examples, by_key, features)
        errors.update(wrong)
        rows = blocks.where(F.col("split") == "train")
        for epoch in range(1, config.epochs + 1) if fits else ():
            if epoch > 1:
                fits = load_fits(spark, f"{model_path}/epochs/{epoch - 1}")
            advance(rows, fits, config.iterations_per_epoch)
            save_fits(spark, fits, f"{model_path}/epochs/{epoch}")
            for key, values in _evaluate(blocks, fits, measure).items():
                metric = by_key[key][2]
                seen = sorted({variant for split, variant, _ in values if split == "validation"})
                first = seen[0]  # "matched" where there are variants
                history.append(
                    (key, epoch, values.get(("train", "", "loss")), values.get(("validation", first, "loss")), metric,
                     values.get(("validation", first, metric)))
                )
                variants[key] = {v: values.get(("validation", v, "accuracy")) for v in seen if v}
        with ThreadPoolExecutor(max_workers=config.parallel_tasks) as pool:
            list(pool.map(lambda key: save_model(PipelineModel([features[key], fits[key].model(spark)]), f"{model_path}/{key}"), fits))
    history = spark.createDataFrame(history, HISTORY_SCHEMA)
    status = spark.createDataFrame(
        [
            (task[0], variants.get(task[0], {}).get("matched"), variants.get(task[0], {}).get("mismatched"),
             "failed" if task[0] in errors else "ok", errors.get(task[0]))
            for task in tasks
        ],
        "task string, val_acc_matched double, val_acc_mismatched double, status string, error string",
    )
    results = status.join(run_results(history), "task", "left").select(
        *[part.split(" ")[0] for part in RESULT_SCHEMA.split(", ")]
    )
    return results, history


def predict_all_tasks(examples: DataFrame, model_path: str, tasks: tuple = TASKS, outputs: tuple = OUTPUTS) -> DataFrame:
    """Scored test rows ``(task, variant, idx, logits)`` of every output whose model exists."""
    spark, examples = examples.sparkSession, _with_texts(examples)
    regression = {task[0]: task[4] for task in tasks}
    parts = []
    for key in dict.fromkeys(output[3] for output in outputs):
        model = load_model(spark, f"{model_path}/{key}")
        if model is None:
            continue
        scope = [(task, variant) for task, variant, _, model_task in outputs if model_task == key]
        mine = F.lit(False)
        for task, variant in scope:
            mine = mine | ((F.col("task") == task) & (F.col("variant") == variant))
        rows = examples.where((F.col("split") == "test") & mine)
        parts.append(add_logits(rows, model, regression[key]).select("task", "variant", "idx", "logits"))
    if not parts:
        return spark.createDataFrame([], "task string, variant string, idx bigint, logits array<double>")
    return concat_sources(parts)
