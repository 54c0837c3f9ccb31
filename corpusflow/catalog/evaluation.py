"""Metrics, histories, result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog.base import CORPUS, corpus, query, round6, table
from corpusflow.functions import arrays as ar
from corpusflow.operators import corpus as co, history as hi, metrics as me, profile as pr, tasks as ta
from corpusflow.session import scratch_path
from corpusflow.sources import readers, writers

# Quality labels against a length rule.
_LABELED = """labeled AS (
  SELECT l.doc_id, d.lang, l.quality AS label, (d.n_chars >= 750 AND d.n_chars % 7 > 0)::INTEGER AS prediction
  FROM labels l JOIN documents d USING (doc_id))"""

# Sources as three classes against a guess that depends on the text length.
_GUESSED = f"""{CORPUS}, guessed AS (
  SELECT doc_id, lang, CASE source WHEN 'true' THEN 0 WHEN 'fake' THEN 1 ELSE 2 END AS label,
         CASE WHEN n_chars % 5 < 3 THEN CASE source WHEN 'true' THEN 0 WHEN 'fake' THEN 1 ELSE 2 END
              ELSE n_chars % 3 END::INTEGER AS prediction FROM corpus)"""


def _class_sql(keys: str = "") -> str:
    """Per-class scores of ``guessed`` as CTE ``scored``."""
    k = f"{keys}, " if keys else ""
    return f"""sides AS (
      SELECT {k}label AS class, (label = prediction)::INTEGER AS tp, 1 AS sup, 0 AS got FROM guessed
      UNION ALL SELECT {k}prediction, 0, 0, 1 FROM guessed),
    scored AS (
      SELECT {k}class, sum(tp)::DOUBLE AS tp, sum(sup)::DOUBLE AS sup, sum(got)::DOUBLE AS got,
        CASE WHEN sum(got) = 0 THEN 0 ELSE sum(tp)::DOUBLE / sum(got) END AS precision,
        CASE WHEN sum(sup) = 0 THEN 0 ELSE sum(tp)::DOUBLE / sum(sup) END AS recall,
        CASE WHEN sum(sup) + sum(got) = 0 THEN 0 ELSE 2.0 * sum(tp)::DOUBLE / (sum(sup) + sum(got)) END AS f1
      FROM sides GROUP BY {k}class)"""


_MCC = """CASE WHEN (sum(sup)*sum(sup) - sum(got*got)) * (sum(sup)*sum(sup) - sum(sup*sup)) = 0 THEN 0 ELSE
  (sum(tp)*sum(sup) - sum(got*sup)) / sqrt((sum(sup)*sum(sup) - sum(got*got)) * (sum(sup)*sum(sup) - sum(sup*sup))) END"""


def labeled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rule = (F.col("n_chars") >= 750) & (F.col("n_chars") % 7 > 0)
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", F.col("quality").alias("label"), rule.cast("int").alias("prediction")
    )


def guessed(spark, sf):
    number = F.when(F.col("source") == "true", 0).when(F.col("source") == "fake", 1).otherwise(2)
    guess = F.when(F.col("n_chars") % 5 < 3, number).otherwise(F.col("n_chars") % 3).cast("int")
    return corpus(spark, sf).select("doc_id", "lang", number.alias("label"), guess.alias("prediction"))


@query(
    "accuracy",
    f"""WITH {_LABELED} SELECT lang, round(avg((label = prediction)::INTEGER), 6) AS accuracy, count(*) AS n_rows
    FROM labeled GROUP BY lang""",
)
def accuracy(spark, sf):
    return me.accuracy(labeled(spark, sf), ["lang"]).withColumns({"accuracy": F.round("accuracy", 6)})


@query(
    "confusion",
    f"WITH {_LABELED} SELECT label, prediction, count(*) AS n_rows FROM labeled GROUP BY label, prediction",
)
def confusion(spark, sf):
    return me.confusion_counts(labeled(spark, sf))


@query(
    "confusion_matrix",
    f"""WITH {_GUESSED} SELECT c AS label, count(*) FILTER (WHERE prediction = 0) AS pred_0,
      count(*) FILTER (WHERE prediction = 1) AS pred_1, count(*) FILTER (WHERE prediction = 2) AS pred_2,
      count(*) FILTER (WHERE prediction = 3) AS pred_3
    FROM (VALUES (0), (1), (2), (3)) v(c) LEFT JOIN guessed ON label = c GROUP BY c""",
)
def confusion_matrix(spark, sf):
    return me.confusion_matrix(guessed(spark, sf), [0, 1, 2, 3])


@query(
    "class_report",
    f"""WITH {_GUESSED}, {_class_sql('lang')} SELECT lang, class, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1, 6) AS f1, sup::BIGINT AS support FROM scored""",
)
def class_report(spark, sf):
    return me.class_report(guessed(spark, sf), ["lang"]).select(
        "lang", "class", *round6("precision", "recall", "f1"), "support"
    )


@query(
    "class_report_long",
    f"""WITH {_GUESSED}, {_class_sql()} SELECT class, 'precision' AS metric, round(precision, 6) AS value FROM scored
    UNION ALL SELECT class, 'recall', round(recall, 6) FROM scored
    UNION ALL SELECT class, 'f1', round(f1, 6) FROM scored""",
)
def class_report_long(spark, sf):
    long = me.report_long(me.class_report(guessed(spark, sf)))
    return long.select("class", "metric", *round6("value"))


@query(
    "weighted_f1",
    f"""WITH {_GUESSED}, {_class_sql('lang')} SELECT lang, round(sum(precision * sup) / sum(sup), 6) AS precision_weighted,
      round(sum(recall * sup) / sum(sup), 6) AS recall_weighted, round(sum(f1 * sup) / sum(sup), 6) AS f1_weighted
    FROM scored GROUP BY lang""",
)
def weighted_f1(spark, sf):
    return me.classification_summary(guessed(spark, sf), ["lang"]).select(
        "lang", *round6("precision_weighted", "recall_weighted", "f1_weighted")
    )


@query(
    "macro_f1",
    f"""WITH {_GUESSED}, {_class_sql('lang')} SELECT lang, round(avg(precision), 6) AS precision_macro,
      round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM scored GROUP BY lang""",
)
def macro_f1(spark, sf):
    return me.classification_summary(guessed(spark, sf), ["lang"]).select(
        "lang", *round6("precision_macro", "recall_macro", "f1_macro")
    )


@query("mcc", f"WITH {_GUESSED}, {_class_sql('lang')} SELECT lang, round({_MCC}, 6) AS mcc FROM scored GROUP BY lang")
def mcc(spark, sf):
    return me.classification_summary(guessed(spark, sf), ["lang"]).select("lang", *round6("mcc"))


_SIZES = "sizes AS (SELECT lang, n_chars::DOUBLE AS x, length(text) - length(replace(text, ' ', ''))::DOUBLE AS y FROM documents)"


def sizes(spark, sf):
    """Text length against the number of blanks."""
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return table(spark, sf, "documents").select("lang", F.col("n_chars").alias("x"), blanks.alias("y"))


@query("pearson", f"WITH {_SIZES} SELECT lang, round(corr(x, y), 6) AS pearson FROM sizes GROUP BY lang")
def pearson(spark, sf):
    return me.pearson(sizes(spark, sf), ["lang"], "x", "y").select("lang", *round6("pearson"))


_RANKS = f"""{_SIZES}, ranks AS (
      SELECT lang, x, y,
        rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS ry
      FROM sizes)"""


@query("average_ranks", f"WITH {_RANKS} SELECT DISTINCT lang, x AS value, rx::DOUBLE AS rank FROM ranks")
def average_ranks(spark, sf):
    return me.average_ranks(sizes(spark, sf), "x", ["lang"]).select("lang", "value", "rank")


@query("spearman", f"WITH {_RANKS} SELECT lang, round(corr(rx, ry), 6) AS spearman FROM ranks GROUP BY lang")
def spearman(spark, sf):
    return me.spearman(sizes(spark, sf), ["lang"], "x", "y").select("lang", *round6("spearman"))


@query(
    "pearson_spearman",
    f"""WITH {_RANKS} SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman,
      round((corr(x, y) + corr(rx, ry)) / 2, 6) AS pearson_spearman
    FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM sizes)""",
)
def pearson_spearman(spark, sf):
    return me.correlation_summary(sizes(spark, sf), [], "x", "y").select(
        *round6("pearson", "spearman", "pearson_spearman")
    )


# The first ten numbers of an embedding as scores for its ten classes.
_XENT = """avg(ln(list_sum(list_transform(embedding[1:10], lambda v: exp(v::DOUBLE)))) - embedding[label + 1]::DOUBLE)"""


@query("cross_entropy", f"SELECT round({_XENT}, 6) AS cross_entropy FROM embeddings")
def cross_entropy(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.slice("embedding", 1, 10).alias("logits"), "label")
    return me.mean_cross_entropy(rows).select(*round6("cross_entropy"))


@query("mse", "SELECT label, round(avg(pow(embedding[1]::DOUBLE - label, 2)), 6) AS mse FROM embeddings GROUP BY label")
def mse(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.get("embedding", F.lit(0)).alias("prediction"), "label")
    scored = rows.withColumn("class", F.col("label"))
    return me.mean_squared_error(scored, ["class"]).select(F.col("class").alias("label"), *round6("mse"))


@query(
    "argmax_class",
    "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS prediction FROM embeddings",
)
def argmax_class(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", ar.argmax("embedding").alias("prediction"))


@query(
    "round_scores",
    """SELECT vec_id, round_even(greatest(0::FLOAT, least(5::FLOAT, s)) * 10::FLOAT, 0)::DOUBLE / 10 AS prediction
    FROM (SELECT vec_id, embedding[1] * 20::FLOAT AS s FROM embeddings)""",
)
def round_scores(spark, sf):
    score = F.get("embedding", F.lit(0)) * F.lit(20.0).cast("float")
    return table(spark, sf, "embeddings").select("vec_id", ar.clip_and_round(score).alias("prediction"))


@query(
    "logit_metrics",
    """WITH guessed AS (
      SELECT label, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INTEGER AS prediction FROM embeddings), """
    + _class_sql()
    + """ SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(sum(precision * sup) / sum(sup), 6) AS precision,
      round(sum(recall * sup) / sum(sup), 6) AS recall, round(sum(f1 * sup) / sum(sup), 6) AS f1 FROM scored""",
)
def logit_metrics(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.slice("embedding", 1, 10).alias("logits"), "label")
    return me.metrics_from_logits(rows).select(*round6("accuracy", "precision", "recall", "f1"))


# Length statistics of the documents in the shape of a training history.
_TASK_LIST = [task[0] for task in ta.TASKS]
_TASK_SQL = "list_value(" + ", ".join(f"'{t}'" for t in _TASK_LIST) + ")"
_METRIC_SQL = "CASE task " + " ".join(f"WHEN '{t[0]}' THEN '{t[2]}'" for t in ta.TASKS) + " END"
_HISTORY = f"""history AS (
      SELECT task, epoch, {_METRIC_SQL} AS metric_name, 'run/' || task || '/' || epoch AS model_path,
        avg(n_chars % 211) / 100.0 AS train_loss, avg(n_chars % 97) / 100.0 AS val_loss,
        avg(n_chars % 101) / 100.0 AS val_metric
      FROM (SELECT {_TASK_SQL}[doc_id % 9 + 1] AS task, (doc_id // 9 % 3 + 1)::INTEGER AS epoch, n_chars FROM documents)
      GROUP BY task, epoch),
    finals AS (
      SELECT task, any_value(metric_name) AS metric_name, max(val_metric) AS best_metric, max(epoch) AS saved_epoch,
        arg_max(val_loss, epoch) AS final_loss FROM history GROUP BY task),
    bests AS (SELECT task, min(epoch) AS best_epoch FROM history JOIN finals USING (task)
      WHERE val_metric = best_metric GROUP BY task)"""


def history(spark, sf):
    task = F.element_at(F.array(*[F.lit(t) for t in _TASK_LIST]), (F.col("doc_id") % 9 + 1).cast("int"))
    epoch = (F.floor(F.col("doc_id") / 9) % 3 + 1).cast("int")
    n = F.col("n_chars")
    rows = table(spark, sf, "documents").select(task.alias("task"), epoch.alias("epoch"), "n_chars")
    per_epoch = rows.groupBy("task", "epoch").agg(
        *[
            (F.avg(n % m) / 100.0).alias(name)
            for name, m in (("train_loss", 211), ("val_loss", 97), ("val_metric", 101))
        ]
    )
    named = ta.with_task(per_epoch, ta.task_dim(spark), "metric").withColumnRenamed("metric", "metric_name")
    return named.withColumn("model_path", F.concat_ws("/", F.lit("run"), "task", "epoch"))


@query(
    "best_epoch",
    f"""WITH {_HISTORY} SELECT task, metric_name, best_metric, best_epoch, saved_epoch, final_loss
    FROM finals JOIN bests USING (task)""",
)
def best_epoch(spark, sf):
    return hi.run_results(history(spark, sf))


@query(
    "best_checkpoint",
    f"""WITH {_HISTORY}, low AS (SELECT task, min(val_loss) AS val_loss FROM history GROUP BY task)
    SELECT task, min(model_path) AS model_path, min(epoch) AS epoch, val_loss
    FROM history JOIN low USING (task, val_loss) GROUP BY task, val_loss""",
)
def best_checkpoint(spark, sf):
    return hi.best_checkpoint(history(spark, sf))


@query(
    "history_curves",
    f"""WITH {_HISTORY} SELECT task, epoch, 'train_loss' AS series, train_loss AS value FROM history
    UNION ALL SELECT task, epoch, 'val_loss', val_loss FROM history
    UNION ALL SELECT task, epoch, metric_name, val_metric FROM history""",
)
def history_curves(spark, sf):
    return hi.history_curves(history(spark, sf))


_NAMES = "names(task, name) AS (VALUES " + ", ".join(f"('{t[0]}', '{t[1]}')" for t in ta.TASKS) + ")"


@query(
    "results_summary",
    f"WITH {_NAMES}, {_HISTORY} SELECT name, metric_name, best_metric FROM finals JOIN names USING (task)",
)
def results_summary(spark, sf):
    return hi.results_summary(hi.run_results(history(spark, sf)), ta.task_dim(spark))


@query(
    "results_json",
    f"""WITH {_HISTORY} SELECT task, metric_name, best_metric, final_loss FROM finals""",
)
def results_json(spark, sf):
    path = scratch_path(spark, "results")
    results = hi.run_results(history(spark, sf)).select("task", "metric_name", "best_metric", "final_loss")
    writers.write_results(results, path)
    return readers.read_results(spark, path, results.schema)


@query(
    "length_histogram",
    f"""WITH {CORPUS}, ends AS (
      SELECT source, min(length(text)) AS lo, max(length(text)) AS hi FROM corpus GROUP BY source),
    bins AS (SELECT source, lo, hi, unnest(range(40)) AS bin FROM ends),
    filled AS (SELECT c.source, least((length(text) - lo) * 40 // (hi - lo), 39) AS bin, count(*) AS n
      FROM corpus c JOIN ends USING (source) GROUP BY ALL)
    SELECT source, bin::INTEGER AS bin, round(lo + (hi - lo) / 40.0 * bin, 6)::DOUBLE AS bin_start, coalesce(n, 0) AS n_rows
    FROM bins LEFT JOIN filled USING (source, bin)""",
)
def length_histogram(spark, sf):
    rows = pr.length_histogram(co.add_length(corpus(spark, sf)))
    return rows.select("source", "bin", *round6("bin_start"), "n_rows")


# ---- the nine tasks -------------------------------------------------------------------------

# Documents as scored examples of the benchmark tasks; scores and labels come from their lengths.
_EXAMPLE_OUTPUTS = [out for out in ta.OUTPUTS if out[0] != "ax"]
_N_LABELS = {task[0]: task[5] for task in ta.TASKS}
_SCORE = "((n_chars * (7 + {i}) + doc_id * (3 + 5 * {i})) % 1009) / 250.0 - 2.0"
_SCORES3 = [f"({_SCORE.format(i=i)})::DOUBLE" for i in range(3)]
_PREDICTIONS = f"""predictions AS (
      SELECT task, variant, doc_id AS idx, n_labels = 1 AS is_regression,
        CASE WHEN n_labels = 1 THEN (n_chars % 51) / 10.0 ELSE n_chars % n_labels END::DOUBLE AS label,
        [{', '.join(_SCORES3)}][1:n_labels] AS logits
      FROM (SELECT doc_id, n_chars,
              list_value({', '.join(repr(o[0]) for o in _EXAMPLE_OUTPUTS)})[doc_id % 10 + 1] AS task,
              list_value({', '.join(repr(o[1]) for o in _EXAMPLE_OUTPUTS)})[doc_id % 10 + 1] AS variant,
              list_value({', '.join(str(_N_LABELS[o[0]]) for o in _EXAMPLE_OUTPUTS)})[doc_id % 10 + 1] AS n_labels
            FROM documents)),
    classed AS (
      SELECT task, variant, label::INTEGER AS label, (list_position(logits, list_max(logits)) - 1)::INTEGER AS prediction
      FROM predictions WHERE NOT is_regression),
    guessed AS (SELECT * FROM classed)"""


def predictions(spark, sf):
    place = (F.col("doc_id") % 10 + 1).cast("int")

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), place)

    rows = table(spark, sf, "documents").select(
        "doc_id",
        "n_chars",
        pick([o[0] for o in _EXAMPLE_OUTPUTS]).alias("task"),
        pick([o[1] for o in _EXAMPLE_OUTPUTS]).alias("variant"),
        pick([_N_LABELS[o[0]] for o in _EXAMPLE_OUTPUTS]).alias("n_labels"),
    )
    n = F.col("n_chars")
    scores = F.array(
        *[((n * (7 + i) + F.col("doc_id") * (3 + 5 * i)) % 1009).cast("double") / 250.0 - 2.0 for i in range(3)]
    )
    label = F.when(F.col("n_labels") == 1, (n % 51) / 10.0).otherwise((n % F.col("n_labels")).cast("double"))
    return rows.select(
        "task", "variant", F.col("doc_id").alias("idx"), label.alias("label"),
        F.slice(scores, F.lit(1), F.col("n_labels")).alias("logits"),
    )


_METRICS = f"""{_PREDICTIONS}, {_class_sql('task, variant')},
    summary AS (
      SELECT task, variant, sum(tp) / sum(sup) AS accuracy, sum(f1 * sup) / sum(sup) AS f1, {_MCC} AS mcc
      FROM scored GROUP BY task, variant),
    regress AS (
      SELECT task, variant, label, logits[1] AS p,
        rank() OVER (PARTITION BY task, variant ORDER BY label) + (count(*) OVER (PARTITION BY task, variant, label) - 1) / 2.0 AS rl,
        rank() OVER (PARTITION BY task, variant ORDER BY logits[1]) + (count(*) OVER (PARTITION BY task, variant, logits[1]) - 1) / 2.0 AS rp
      FROM predictions WHERE is_regression),
    corrs AS (SELECT task, variant, corr(label, p) AS pe, corr(rl, rp) AS sp FROM regress GROUP BY task, variant),
    losses AS (
      SELECT task, variant, avg(CASE WHEN is_regression THEN pow(logits[1] - label, 2) ELSE
        ln(list_sum(list_transform(logits, lambda v: exp(v)))) - logits[label::INTEGER + 1] END) AS loss
      FROM predictions GROUP BY task, variant),
    metrics AS (
      SELECT task, variant, 'accuracy' AS metric, accuracy AS value FROM summary
      UNION ALL SELECT task, variant, 'f1', f1 FROM summary
      UNION ALL SELECT task, variant, 'matthews_correlation', mcc FROM summary
      UNION ALL SELECT task, variant, 'pearson', pe FROM corrs
      UNION ALL SELECT task, variant, 'spearman', sp FROM corrs
      UNION ALL SELECT task, variant, 'pearson_spearman', (pe + sp) / 2 FROM corrs
      UNION ALL SELECT task, variant, 'loss', loss FROM losses)"""


@query("task_metrics", f"WITH {_METRICS} SELECT task, variant, metric, round(value, 6) AS value FROM metrics")
def task_metrics(spark, sf):
    rows = ta.evaluate_predictions(predictions(spark, sf), ta.task_dim(spark))
    return rows.select("task", "variant", "metric", *round6("value"))


@query(
    "reported_metric",
    f"""WITH {_METRICS} SELECT task, variant, metric, round(value, 6) AS value FROM metrics
    WHERE metric = {_METRIC_SQL}""",
)
def reported_metric(spark, sf):
    dim = ta.task_dim(spark)
    rows = ta.reported_metric(ta.evaluate_predictions(predictions(spark, sf), dim), dim)
    return rows.select("task", "variant", "metric", *round6("value"))


@query(
    "matched_mismatched",
    f"""WITH {_METRICS} SELECT task, round(max(accuracy) FILTER (WHERE variant = 'matched'), 6) AS val_acc_matched,
      round(max(accuracy) FILTER (WHERE variant = 'mismatched'), 6) AS val_acc_mismatched
    FROM summary WHERE task = 'mnli' GROUP BY task""",
)
def matched_mismatched(spark, sf):
    rows = predictions(spark, sf).where("task = 'mnli'").select(
        "task", "variant", "label", ar.argmax("logits").alias("prediction")
    )
    sides = hi.variant_accuracy(me.accuracy(rows, ["task", "variant"]))
    return sides.select("task", *round6("val_acc_matched", "val_acc_mismatched"))


_OUTPUT_SQL = "outputs(task, variant, output_name, model_task) AS (VALUES " + ", ".join(repr(o) for o in ta.OUTPUTS) + ")"
_SUBMISSIONS = f"""{_OUTPUT_SQL}, {_PREDICTIONS}, submissions AS (
      SELECT output_name, idx AS index, CASE WHEN is_regression
        THEN (round_even(greatest(0::FLOAT, least(5::FLOAT, logits[1]::FLOAT)) * 10::FLOAT, 0)::DOUBLE / 10)::VARCHAR
        ELSE (list_position(logits, list_max(logits)) - 1)::VARCHAR END AS prediction
      FROM predictions JOIN outputs USING (task, variant))"""


@query("submission_rows", f"WITH {_SUBMISSIONS} SELECT output_name, index, prediction FROM submissions")
def submission_rows(spark, sf):
    return ta.submission_rows(predictions(spark, sf), ta.task_dim(spark), ta.output_dim(spark))


@query("submission_files", f"WITH {_SUBMISSIONS} SELECT output_name, index, prediction FROM submissions")
def submission_files(spark, sf):
    path = scratch_path(spark, "submissions")
    writers.write_submissions(submission_rows(spark, sf), path)
    return spark.read.schema("index bigint, prediction string, output_name string").option("sep", "\t").option(
        "header", True
    ).csv(path)


@query(
    "missing_outputs",
    f"""WITH {_SUBMISSIONS} SELECT output_name, task, variant, model_task FROM outputs
    WHERE output_name NOT IN (SELECT output_name FROM submissions)""",
)
def missing_outputs(spark, sf):
    outputs = ta.output_dim(spark)
    return ta.missing_outputs(outputs, ta.submission_rows(predictions(spark, sf), ta.task_dim(spark), outputs))


@query(
    "available_tasks",
    f"WITH {_NAMES}, {_HISTORY} SELECT task, name FROM names WHERE task IN (SELECT task FROM history WHERE val_metric > 0.5)",
)
def available_tasks(spark, sf):
    """Tasks that have a checkpoint with a metric above one half."""
    good = history(spark, sf).where("val_metric > 0.5")
    return ta.available_tasks(ta.task_dim(spark), good).select("task", "name")


_TURNS = """turns AS (
      SELECT u.conv_id * 1000 + u.turn AS idx, u.text AS first_text, a.text AS second_text
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user')"""


def turns(spark, sf):
    """Each user turn with the next turn of its conversation."""
    said = table(spark, sf, "conversations")
    user = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("first_text"))
    answer = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second_text"))
    return user.join(answer, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "first_text", "second_text"
    )


@query(
    "pair_columns",
    f"""WITH {_TURNS} SELECT t.task, '' AS variant, idx, md5(first_text) AS digest_a, md5(second_text) AS digest_b,
      CASE WHEN t.task = 'stsb' THEN (idx % 51) / 10.0 ELSE idx % 2 END::DOUBLE AS label
    FROM turns, (VALUES ('stsb'), ('mnli'), ('qnli'), ('qqp')) t(task)""",
)
def pair_columns(spark, sf):
    """The four column layouts of pair tasks brought to one shape."""
    base = turns(spark, sf)
    layouts = {
        "stsb": ("sentence1", "sentence2"),
        "mnli": ("premise", "hypothesis"),
        "qnli": ("question", "sentence"),
        "qqp": ("question1", "question2"),
    }
    parts = []
    for task, (a, b) in layouts.items():
        label = (F.col("idx") % 51) / 10.0 if task == "stsb" else F.col("idx") % 2
        rows = base.select("idx", F.col("first_text").alias(a), F.col("second_text").alias(b), label.alias("label"))
        parts.append(ta.to_examples(rows, task, True, task == "stsb"))
    return co.concat_sources(parts).select(
        "task", "variant", "idx", F.md5("text_a").alias("digest_a"), F.md5("text_b").alias("digest_b"), "label"
    )


@query(
    "single_text_column",
    """SELECT 'cola' AS task, doc_id AS idx, md5(text) AS digest, (n_chars % 2)::DOUBLE AS label FROM documents
    UNION ALL SELECT 'sst2', item_id, md5(text), NULL FROM benchmark""",
)
def single_text_column(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("sentence"), (F.col("n_chars") % 2).alias("label")
    )
    items = table(spark, sf, "benchmark").withColumnRenamed("item_id", "idx")
    rows = co.concat_sources([ta.to_examples(docs, "cola", False), ta.to_examples(items, "sst2", False)])
    return rows.select("task", "idx", F.md5("text_a").alias("digest"), "label")
