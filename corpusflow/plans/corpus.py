"""From raw inputs to the labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.operators import corpus as co
from corpusflow.operators.dedup import drop_duplicate_texts
from corpusflow.operators.labels import add_label_id, label_dim
from corpusflow.operators.sampling import SEED, balance


def prepare_neural_news(df: DataFrame, language: str = "en") -> DataFrame:
    """Rows with a body in one language as ``(doc_id, label, text)``; label 0 is real, 1 neural."""
    kept = co.keep_language(df, language, "language", body="body")
    named = add_label_id(kept, label_dim(df.sparkSession), "neural_news", "label", "_id")
    rows = named.select("doc_id", F.col("_id").alias("label"), F.col("body").alias("text"))
    return co.clean_column(rows)


def prepare_corpus(
    fake: DataFrame,
    true: DataFrame,
    neural_news: DataFrame,
    min_length: int = co.MIN_LENGTH,
    max_length: int = co.MAX_LENGTH,
    enforce_length: bool = True,
    dedup_scope: str = "class",
    balance_mode: str = "none",
    max_prefix_chars: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The corpus ``(doc_id, text, source, length, ...)`` with sources true, fake and neural.

    ``doc_id`` must be unique over the three inputs.  Real rows of ``neural_news`` join the true
    class.  The length filter looks at the text alone, so equal texts share its verdict; it runs
    before duplicate removal and fewer rows reach the one shuffle.  ``dedup_scope`` is ``"class"``
    or ``"global"``.
    """
    if dedup_scope not in ("class", "global"):
        raise ValueError("dedup_scope must be 'class' or 'global'")
    news = prepare_neural_news(neural_news)
    rows = co.concat_sources(
        [
            co.tag_source(co.cut_dateline(true, "text", max_prefix_chars), "true"),
            co.tag_source(co.clean_column(fake), "fake"),
            news.select("doc_id", "text", F.when(F.col("label") == 1, "neural").otherwise("true").alias("source")),
        ]
    )
    rows = co.add_length(rows)
    if enforce_length:
        rows = co.keep_lengths(rows, min_length, max_length)
    rows = drop_duplicate_texts(rows, ("source",) if dedup_scope == "class" else ())
    return balance(rows, balance_mode, seed=seed)
