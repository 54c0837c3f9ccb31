"""Evaluation of predictions.

Classification metrics need one pass: predictions are counted per (label, prediction), the counts
become one row per class, and every score is arithmetic on that small table.  ``keys`` (for
example task and variant) evaluates many models in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.functions.arrays import argmax, row_cross_entropy, row_squared_error
from corpusflow.session import materialise

RANK_BOUNDS = 256


def _ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, 0 where the bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion_counts(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def confusion_matrix(
    df: DataFrame,
    classes: Sequence = (),
    keys: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """One row per true class, one column ``pred_<class>`` per predicted class, zeros filled in.

    The classes are those listed and all others that occur as label or prediction, so every row
    counts; a missing one is the class ``None``.  Every class gets its row for every key.
    """
    counts = materialise(confusion_counts(df, keys, label, prediction), "confusion")
    # one value per class
    held = counts.select(F.explode(F.array("label", "prediction")).alias("c")).distinct().collect()
    extra = {row["c"] for row in held} - set(classes)
    known = [*classes, *sorted(extra - {None}), *([None] if None in extra else [])]
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction").eqNullSafe(F.lit(c)), F.col("n_rows"))), F.lit(0)).alias(f"pred_{c}")
        for c in known
    ]
    rows = counts.select(*keys, "label", "prediction", "n_rows")
    if known:
        kind = df.schema[label].dataType
        every = F.explode(F.array(*[F.lit(c).cast(kind) for c in known])).alias("label")
        base = counts.select(*keys).distinct() if keys else df.sparkSession.range(1)
        rows = rows.unionByName(base.select(*keys, every), allowMissingColumns=True)
    return rows.groupBy(*keys, "label").agg(*cells)


def class_table(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
    loss: str | None = None,
) -> DataFrame:
    """Per class: true positives, support (rows with that label), predicted (rows given that class).

    A row loss is summed per label in the same pass.
    """
    counts = df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.sum(loss) if loss else F.lit(0.0)).alias("_loss")
    )
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n_rows")).otherwise(F.lit(0))
    as_label = F.struct(
        F.col("label").alias("cls"), hit.alias("tp"), F.col("n_rows").alias("sup"), none.alias("got"),
        F.col("_loss").alias("los"),
    )
    as_prediction = F.struct(
        F.col("prediction").alias("cls"), none.alias("tp"), none.alias("sup"), F.col("n_rows").alias("got"),
        F.lit(0.0).alias("los"),
    )
    table = (
        counts.select(*keys, F.inline(F.array(as_label, as_prediction)))
        .groupBy(*keys, F.col("cls").alias("class"))
        .agg(
            F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("got").alias("predicted"),
            F.sum("los").alias("loss_sum"),
        )
    )
    return table if loss else table.drop("loss_sum")


def class_report(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a denominator is 0."""
    return _with_scores(class_table(df, keys, label, prediction)).select(
        *keys, "class", "precision", "recall", "f1", "support"
    )


def _with_scores(table: DataFrame) -> DataFrame:
    return (
        table.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(F.col("tp") * 2, F.col("predicted") + F.col("support")))
    )


def classification_summary(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
    loss: str | None = None,
) -> DataFrame:
    """Accuracy, weighted and macro precision / recall / F1, Matthews correlation; with ``loss`` its row mean."""
    scored = _with_scores(class_table(df, keys, label, prediction, loss))
    support, predicted = F.col("support").cast("double"), F.col("predicted").cast("double")

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * support), F.sum(support)).alias(f"{name}_weighted")

    rows, hits = F.sum(support), F.sum(F.col("tp").cast("double"))
    cross, p2, t2 = F.sum(predicted * support), F.sum(predicted * predicted), F.sum(support * support)
    spread = F.sqrt((rows * rows - p2) * (rows * rows - t2))
    return scored.groupBy(*keys).agg(
        F.sum("support").alias("n_rows"),
        _ratio(hits, rows).alias("accuracy"),
        *[weighted(name) for name in ("precision", "recall", "f1")],
        *[F.avg(name).alias(f"{name}_macro") for name in ("precision", "recall", "f1")],
        _ratio(hits * rows - cross, spread).alias("mcc"),
        *([_ratio(F.sum("loss_sum"), rows).alias("loss")] if loss else []),
    )


def report_long(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-class report as ``(class, metric, value)`` rows, the table behind a bar chart."""
    return report.unpivot([*keys, "class"], ["precision", "recall", "f1"], "metric", "value")


def accuracy(df: DataFrame, keys: Sequence[str] = (), label: str = "label", prediction: str = "prediction") -> DataFrame:
    # as in the summary, a missing label or prediction is never a hit
    same = F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("double")
    return df.groupBy(*keys).agg(F.avg(same).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


def mean_cross_entropy(df: DataFrame, keys: Sequence[str] = (), logits: str = "logits", label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(row_cross_entropy(logits, label)).alias("cross_entropy"))


def mean_squared_error(
    df: DataFrame, keys: Sequence[str] = (), prediction: str = "prediction", label: str = "label"
) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(row_squared_error(prediction, label)).alias("mse"))


def pearson(
    df: DataFrame, keys: Sequence[str] = (), x: str = "prediction", y: str = "label", more: Sequence[Column] = ()
) -> DataFrame:
    """Pearson correlation, NULL when either side is constant; ``more`` aggregates share the pass."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(a.isNotNull() & b.isNotNull())
    return both.groupBy(*keys).agg(
        F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("pearson"), *more
    )


def average_ranks(
    df: DataFrame, value: str, keys: Sequence[str] = (), bounds: int = RANK_BOUNDS, centred: bool = False
) -> DataFrame:
    """``(keys, value, n, rank)``: the mean 1-based rank of every distinct value, or its distance
    from the mean rank.

    Equal values are counted first, so a value held by a third of the rows is one row here.  The
    distinct values are then cut into ranges at approximate quantiles (which only steer the
    balance, not the result), ranked inside each range and shifted by the rows below it.
    """
    spark = df.sparkSession
    kept = df.where(F.col(value).isNotNull())
    distinct = kept.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    steps = [i / bounds for i in range(1, bounds)]
    # at most `bounds` numbers per key; fixed here so that both uses below see the same ranges
    cuts = distinct.groupBy(*keys).agg(F.percentile_approx("value", steps, 10 * bounds).alias("_cuts")).collect()
    key_types = [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
    table = spark.createDataFrame(
        [(*[row[k] for k in keys], sorted(set(row["_cuts"]))) for row in cuts],
        ", ".join([*key_types, "_cuts array<double>"]),
    )
    if keys:
        ranged = distinct.join(F.broadcast(table), list(keys))
    else:
        only = cuts[0]["_cuts"] if cuts and cuts[0]["_cuts"] else []
        ranged = distinct.withColumn("_cuts", F.array(*[F.lit(c) for c in sorted(set(only))]).cast("array<double>"))
    ranged = ranged.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("value")))).drop("_cuts")
    # up to `bounds` rows per key
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_rows")).withColumn("_all", F.lit(1))
    upto = Window.partitionBy("_all", *keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("_rows").over(Window.partitionBy("_all", *keys))
    middle = (whole + 1) / 2 if centred else F.lit(0)
    offsets = totals.select(
        *keys, "_range", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_below"), middle.alias("_middle")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_upto", F.sum("n").over(inside))
        .join(F.broadcast(offsets), [*keys, "_range"])
        .select(*keys, "value", "n", (F.col("_below") + F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2 - F.col("_middle")).alias("rank"))
    )


def spearman(df: DataFrame, keys: Sequence[str] = (), x: str = "prediction", y: str = "label") -> DataFrame:
    """Spearman correlation: Pearson over average ranks; NULL when either side is constant.

    Rows are counted per (x, y) pair before the rank tables are joined.
    """
    pairs = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = pairs.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    rank_x = average_ranks(pairs, "_x", keys, centred=True).select(*keys, F.col("value").alias("_x"), F.col("rank").alias("_rx"))
    rank_y = average_ranks(pairs, "_y", keys, centred=True).select(*keys, F.col("value").alias("_y"), F.col("rank").alias("_ry"))
    joint = pairs.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    # a side with few distinct values is broadcast by AQE; a hot value of a long rank table is split by
    # its skew join
    ranked = joint.join(rank_x, [*keys, "_x"]).join(rank_y, [*keys, "_y"])
    n, rx, ry = F.col("_n"), F.col("_rx"), F.col("_ry")
    spread = F.sqrt(F.sum(n * rx * rx)) * F.sqrt(F.sum(n * ry * ry))
    vary = (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return ranked.groupBy(*keys).agg(F.when(vary, F.try_divide(F.sum(n * rx * ry), spread)).alias("spearman"))


def correlation_summary(
    df: DataFrame, keys: Sequence[str] = (), x: str = "prediction", y: str = "label", more: Sequence[Column] = ()
) -> DataFrame:
    """Pearson, Spearman and their mean."""
    both = pearson(df, keys, x, y, more)
    ranks = spearman(df, keys, x, y)
    if keys:
        both = both.join(ranks, list(keys))
    else:
        # two one-row results side by side
        both = both.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("pearson_spearman", (F.col("pearson") + F.col("spearman")) / 2)


def metrics_from_logits(df: DataFrame, keys: Sequence[str] = (), logits: str = "logits", label: str = "label") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 of the argmax class."""
    classed = df.select(*keys, F.col(label).alias("label"), argmax(logits).alias("prediction"))
    return classification_summary(classed, keys).select(
        *keys,
        "accuracy",
        F.col("precision_weighted").alias("precision"),
        F.col("recall_weighted").alias("recall"),
        F.col("f1_weighted").alias("f1"),
    )
