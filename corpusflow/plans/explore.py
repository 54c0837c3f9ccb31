"""Cluster a corpus and lay it out in two dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusflow.operators.features import MAX_TERMS, fit_tfidf, store_vectors, principal_components, vocabulary_size
from corpusflow.operators.models import fit_kmeans, predict


def cluster_layout(
    df: DataFrame, source: str = "source", k: int = 3, max_terms: int = MAX_TERMS, stop_words: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """``(doc_id, source, cluster, x, y)`` for every row.  Sample the result for display."""
    features = fit_tfidf(df, max_terms, stop_words=stop_words)
    vectors = store_vectors(features.transform(df).select("doc_id", source, "features")).persist()
    clusters = predict(vectors, fit_kmeans(vectors, k, seed))
    placed = principal_components(clusters, vocabulary_size(features), keep=("doc_id", source, "cluster"))
    # `vectors` stays persisted: the returned table still reads it
    return placed


def cluster_vectors(df: DataFrame, column: str = "features", k: int = 3, seed: int = 42) -> DataFrame:
    return predict(df, fit_kmeans(df, k, seed, column))
