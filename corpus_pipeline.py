"""A training corpus in five stages, each written as Parquet and read again.

Every stage works on all that the one before kept, and returns the columns of ``documents``; the last adds
the number of ids and digests of ids and decoded text.  Null and empty texts pass every stage; repeated
rows (same id, same text) are one document from the third stage on.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.llm.catalog import piece_model
from corpusflow.llm.common import table
from corpusflow.llm.decontaminate import without_contaminated
from corpusflow.llm.jaccard_join import keep_first_of_class
from corpusflow.llm.line_dedup import dedup_lines
from corpusflow.llm.pieces import decode_ids, encode_texts
from corpusflow.llm.toxicity import score_toxicity
from corpusflow.session import materialise


def _free(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id"), F.col("text"), row.alias("whole"))
    scored = score_toxicity(rows, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("whole.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three-line passages stay at their first place alone; documents left without any line go."""
    count = _free("lines_removed", docs)
    kept = dedup_lines(docs, count_col=count).where((F.col(count) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more, the first stays."""
    return keep_first_of_class(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other names and numbers, go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the number and digest of its ids, and the digest of the text they decode to."""
    model = piece_model()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ids = encode_texts(docs.select(row.alias("row"), "text"), model, begin=True, end=True).drop("text")
    both = decode_ids(ids, model)
    names = {"n_tokens", "ids_sha256", "decoded_sha256"}
    return both.select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c not in names],
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_benchmark),
    ("piece_ids", encode),
]

# a trained model and the library's segmentation have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
