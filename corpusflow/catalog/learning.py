"""Features, clusters, classifiers, task runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusflow.catalog.base import corpus, query, round6, table
from corpusflow.catalog.evaluation import turns
from corpusflow.functions import tokens as tk
from corpusflow.operators import corpus as co, dedup, features as fe, metrics as me, models as mo, profile as pr, tasks as ta
from corpusflow.operators.sampling import SEED, stratified_split
from corpusflow.operators.vocab import top_terms as most_frequent
from corpusflow.plans import classify, explore, multitask
from corpusflow.session import materialise, scratch_path
from corpusflow.sources import stores

STOP_WORDS = ["the", "and", "of", "in", "to", "is", "for", "der", "die", "und", "la", "le", "de", "el", "en"]
N_TERMS = 500  # of the models; the reports below have as many as the operators' default
TOP_TERMS = fe.MAX_TERMS

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = rf"""listed AS (
      SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
    kept AS (SELECT doc_id, term FROM listed WHERE term NOT IN ({_STOPS})),
    tops AS (SELECT term, count(*) AS n FROM kept GROUP BY term ORDER BY n DESC, term LIMIT {TOP_TERMS})"""


@query(
    "split_terms",
    f"""WITH {_TERMS} SELECT doc_id, count(*)::INTEGER AS n_terms, count(DISTINCT term)::INTEGER AS n_distinct
    FROM kept GROUP BY doc_id""",
)
def split_terms(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tk.terms("text", STOP_WORDS).alias("t"))
    found = rows.select("doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"))
    return found.where("n_terms > 0")


@query("top_terms", f"WITH {_TERMS} SELECT term, n FROM tops")
def top_terms(spark, sf):
    return most_frequent(table(spark, sf, "documents"), TOP_TERMS, stop_words=STOP_WORDS)


@query(
    "tfidf_weights",
    f"""WITH {_TERMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM kept JOIN tops USING (term) GROUP BY doc_id, term),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY term),
    weighted AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted""",
)
def tfidf_weights(spark, sf):
    rows = fe.tfidf_rows(table(spark, sf, "documents"), TOP_TERMS, stop_words=STOP_WORDS)
    return rows.select("doc_id", "term", *round6("weight"))


@query(
    "embedding_features",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 6) AS squared_norm FROM embeddings",
)
def embedding_features(spark, sf):
    """Stored embeddings as ML vectors, read back as arrays."""
    from pyspark.ml.functions import vector_to_array

    rows = fe.embedding_column(table(spark, sf, "embeddings")).select("vec_id", vector_to_array("features").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    return rows.select("vec_id", norm.alias("squared_norm")).select("vec_id", *round6("squared_norm"))


def _make_letter_profile():
    """A stand-in for a sentence model: normalised counts of the letters a to z."""

    def run(texts):
        letters = np.array([[str(t).lower().count(chr(97 + i)) for i in range(26)] for t in texts], dtype=np.float64)
        return (letters / np.maximum(np.linalg.norm(letters, axis=1, keepdims=True), 1.0)).astype(np.float32)

    return run


@query(
    "custom_embedding",
    """SELECT item_id, round(letters[5] / greatest(sqrt(list_sum(list_transform(letters, lambda v: v * v))), 1), 4) AS e_share
    FROM (SELECT item_id, list_transform(range(26), lambda i: (length(text) - length(replace(lower(text), chr(97 + i::INTEGER), '')))::DOUBLE) AS letters
          FROM benchmark)""",
)
def custom_embedding(spark, sf):
    rows = fe.embed_with(table(spark, sf, "benchmark"), _make_letter_profile)
    return rows.select("item_id", F.round(F.get("embedding", F.lit(4)).cast("double"), 4).alias("e_share"))


def _make_linear(width: int, classes: int):
    def make():
        weights = (np.arange(width)[:, None] * (np.arange(classes)[None, :] + 1)) % 7 - 3

        def run(vectors):
            return (np.asarray(vectors, dtype=np.float64) @ weights).astype(np.float32)

        return run

    return make


@query(
    "custom_model_scores",
    """SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * (i % 7 - 3))), 4) AS first_logit
    FROM embeddings""",
)
def custom_model_scores(spark, sf):
    """A caller's own scoring function, run in batches on the embedding column."""
    rows = mo.score_with(table(spark, sf, "embeddings"), _make_linear(64, 3), "embedding", batch_size=256, input_shapes=[[64]])
    return rows.select("vec_id", F.round(F.get("logits", F.lit(0)).cast("double"), 4).alias("first_logit"))


@query("kmeans_embeddings")
def kmeans_embeddings(spark, sf):
    vectors = fe.embedding_column(table(spark, sf, "embeddings")).select("vec_id", "features").persist()
    return explore.cluster_vectors(vectors).groupBy("cluster").agg(F.count(F.lit(1)).alias("n_rows"))


@query("pca_embeddings")
def pca_embeddings(spark, sf):
    vectors = fe.embedding_column(table(spark, sf, "embeddings")).select("vec_id", "features").persist()
    return fe.principal_components(vectors, 64, keep=("vec_id",))


def _layout(spark, sf):
    return explore.cluster_layout(corpus(spark, sf), max_terms=N_TERMS, stop_words=STOP_WORDS)


@query("cluster_layout")
def cluster_layout(spark, sf):
    return _layout(spark, sf).select("doc_id", "source", "cluster", *round6("x", "y"))


@query("cluster_source_counts")
def cluster_source_counts(spark, sf):
    rows = corpus(spark, sf)
    model = fe.fit_tfidf(rows, N_TERMS, stop_words=STOP_WORDS)
    vectors = fe.store_vectors(fe.add_tfidf(rows.select("doc_id", "source", "text"), model).drop("text"))
    return pr.cluster_source_counts(explore.cluster_vectors(vectors))


@query("pca_wide_tfidf")
def pca_wide_tfidf(spark, sf):
    """Two components of a wide TF-IDF matrix, without a covariance matrix."""
    rows = table(spark, sf, "documents")
    model = fe.fit_tfidf(rows, 5_000, stop_words=STOP_WORDS)
    vectors = fe.store_vectors(model.transform(rows).select("doc_id", "features")).persist()
    placed = fe.principal_components(vectors, fe.vocabulary_size(model))
    return placed.select("doc_id", *round6("x", "y"))


def _language_corpus(spark, sf):
    """Distinct texts with their language, the target the classifiers learn; stored, as training reads it often."""
    return materialise(dedup.drop_duplicate_texts(table(spark, sf, "documents").select("doc_id", "text", "lang")))


@query("lr_report")
def lr_report(spark, sf):
    run = classify.classify_corpus(_language_corpus(spark, sf), "lang", "lr", max_terms=TOP_TERMS, stop_words=STOP_WORDS)
    return run.report


@query("svm_report")
def svm_report(spark, sf):
    run = classify.classify_corpus(_language_corpus(spark, sf), "lang", "svm", max_terms=TOP_TERMS, stop_words=STOP_WORDS)
    return run.report


@query("model_reload")
def model_reload(spark, sf):
    """Features and classifier fitted, saved, loaded, and applied to another table."""
    rows = _language_corpus(spark, sf).withColumn("label_id", (F.col("lang") != "en").cast("int"))
    features = fe.fit_tfidf(rows, N_TERMS, stop_words=STOP_WORDS)
    vectors = fe.store_vectors(features.transform(rows).select("label_id", "features"))
    model = mo.fit_classifier(vectors, "lr", max_iter=10)
    path = scratch_path(spark, "model")
    stores.save_model(fe.PipelineModel([features, model]), path)
    loaded = stores.load_model(spark, path)
    return mo.predict(table(spark, sf, "benchmark"), loaded).select("item_id", F.col("prediction").cast("int").alias("prediction"))


EVERY = (*(task[0] for task in ta.TASKS), "ax")


def _single_texts(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("sentence"), F.col("lang"), "n_chars"
    )
    docs = stratified_split(docs, "lang", 0.2, 0.25, SEED, "idx").withColumn(
        "split", F.when(F.col("split") == "valid", "validation").otherwise(F.col("split"))
    )
    return docs.withColumn("label", (F.col("lang") != "en").cast("int"))


def examples(spark, sf, asked=EVERY):
    """Documents and conversation turns as examples of the tasks asked for: all nine and the diagnostic set, if not said otherwise.

    Texts are stored once; what tasks have of their own, labels and variants, is made from them when it is read.
    """
    tasks = [task for task in ta.TASKS if task[0] in asked]
    docs = None if all(task[3] for task in tasks) else materialise(_single_texts(spark, sf).select("idx", "sentence", "label", "split"), "texts")
    pairs = turns(spark, sf).withColumnsRenamed({"first_text": "sentence1", "second_text": "sentence2"})
    place = F.col("idx") % 5
    split = F.when(place == 0, "test").when(place == 1, "validation").otherwise("train")
    variant = F.when((F.col("split") == "train"), "").when(F.col("idx") % 2 == 0, "matched").otherwise("mismatched")
    pairs = materialise(pairs.withColumns({"split": split, "length": F.length("sentence2")}), "pairs")
    length = F.col("length")
    parts = []
    for key, _, _, is_pair, is_regression, n_labels in tasks:
        if is_pair:
            label = F.least(length / 400.0, F.lit(5.0)) if is_regression else F.floor(length / 300) % n_labels
            rows = pairs.withColumn("label", label)
            rows = rows.withColumn("variant", variant) if key == "mnli" else rows
        else:
            rows = docs
        parts.append(ta.to_examples(rows, key, is_pair, is_regression))
    if "ax" in asked:
        parts.append(ta.to_examples(pairs.where("split = 'test'").drop("label"), "ax", True))
    return co.concat_sources(parts)


TRAINING = multitask.TrainConfig(stop_words=tuple(STOP_WORDS))


@query("task_results")
def task_results(spark, sf):
    results, _ = multitask.train_all_tasks(examples(spark, sf), scratch_path(spark, "models"), TRAINING)
    return results


def _scored(spark, rows, tasks=ta.TASKS, outputs=ta.OUTPUTS):
    """The test rows of all outputs, scored by models trained here; rows that are left without a model are an error."""
    path = scratch_path(spark, "models")
    results, _ = multitask.train_all_tasks(rows, path, TRAINING, tasks)
    failed = {r["task"]: r["error"] for r in results.where("status = 'failed'").collect()}
    left = [
        f"{name} ({failed[key]})" for task, variant, name, key in outputs
        if key in failed and not rows.where((F.col("split") == "test") & (F.col("task") == task) & (F.col("variant") == variant)).isEmpty()
    ]
    if left:
        raise ValueError(f"test rows without a model: {', '.join(left)}")
    return multitask.predict_all_tasks(rows, path, tasks, outputs)


@query("task_submissions")
def task_submissions(spark, sf):
    """Every task trained and its test rows scored; the diagnostic set uses the model of another task."""
    scored = _scored(spark, examples(spark, sf))
    return ta.submission_rows(scored, ta.task_dim(spark), ta.output_dim(spark))


@query("borrowed_model_scores")
def borrowed_model_scores(spark, sf):
    """The diagnostic pairs scored by the model of the inference task."""
    mnli = tuple(task for task in ta.TASKS if task[0] == "mnli")
    ax = tuple(output for output in ta.OUTPUTS if output[0] == "ax")
    scored = _scored(spark, examples(spark, sf, ("mnli", "ax")), mnli, ax)
    return ta.submission_rows(scored, ta.task_dim(spark), ta.output_dim(spark))


@query("score_new_text")
def score_new_text(spark, sf):
    """The language classifier applied to texts it has never seen."""
    run = classify.classify_corpus(_language_corpus(spark, sf), "lang", "lr", max_terms=N_TERMS, max_iter=20, stop_words=STOP_WORDS)
    scored = mo.predict(mo.predict(table(spark, sf, "benchmark"), run.features), run.model)
    scored = scored.select("item_id", F.col("prediction").cast("int").alias("label_id"))
    return scored.join(run.labels.select("label_id", "label"), "label_id").select("item_id", "label")


@query("classifier_summary")
def classifier_summary(spark, sf):
    run = classify.classify_corpus(_language_corpus(spark, sf), "lang", "lr", max_terms=N_TERMS, max_iter=20, stop_words=STOP_WORDS)
    return me.classification_summary(run.predictions)
