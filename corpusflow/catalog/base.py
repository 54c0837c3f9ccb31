"""Registry of named queries, each with its SQL twin where one exists, and the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.sources.readers import read_corpus

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# tables with long texts, and their ids
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_corpus(spark, path, _TEXTS[name]) if name in _TEXTS else spark.read.parquet(path)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a three-class source: half true, three tenths fake, the rest neural."""
    digit = F.col("doc_id") % 10
    source = F.when(digit < 5, "true").when(digit < 8, "fake").otherwise("neural")
    return table(spark, sf_dir, "documents").withColumn("source", source)


CORPUS = """corpus AS (
  SELECT doc_id, text, lang, n_chars,
         CASE WHEN doc_id % 10 < 5 THEN 'true' WHEN doc_id % 10 < 8 THEN 'fake' ELSE 'neural' END AS source
  FROM documents)"""

# the whitespace class of functions.text in RE2 notation
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def clean_sql(text: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({text}, ''), '&nbsp;', ' '), '{WS}+', ' ', 'g'), ' ')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def cut_sql(text: str) -> str:
    """Prefix cut and strip."""
    whole = f"coalesce({text}, '')"
    return strip_sql(f"substr({whole}, instr({whole}, '-') + 1)")


def round6(*names: str):
    return [F.round(name, 6).alias(name) for name in names]
