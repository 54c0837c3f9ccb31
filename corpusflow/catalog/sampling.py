"""Shuffles, samples, balancing and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog.base import CORPUS, corpus, query
from corpusflow.operators import sampling as sa

_RANKED = f"""{CORPUS}, ranked AS (
      SELECT doc_id, source,
             row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS place,
             count(*) OVER (PARTITION BY source) AS n
      FROM corpus),
    sizes AS (SELECT source, count(*) AS n FROM corpus GROUP BY source)"""
_DRAWS = """draws AS (
      SELECT ('0x' || substr(md5('42:' || j), 1, 15))::BIGINT % (SELECT n FROM sizes WHERE source = 'neural') AS i
      FROM (SELECT unnest(range((SELECT n FROM sizes WHERE source = 'true'))) AS j)),
    drawn AS (
      SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id) AS copy
      FROM draws JOIN ranked ON source = 'neural' AND place - 1 = i)"""


def _slim(spark, sf):
    return corpus(spark, sf).select("doc_id", "text", "source")


@query("shuffle_key", "SELECT doc_id, md5('42:' || doc_id) AS shuffle_key FROM documents")
def shuffle_key(spark, sf):
    return sa.with_shuffle_key(_slim(spark, sf)).select("doc_id", "shuffle_key")


@query("shuffled", "SELECT doc_id, length(text)::INTEGER AS length FROM documents ORDER BY md5('42:' || doc_id), doc_id")
def shuffled(spark, sf):
    return sa.shuffled(_slim(spark, sf)).select("doc_id", F.length("text").alias("length"))


@query("dense_index", f"WITH {_RANKED} SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS index FROM corpus")
def dense_index(spark, sf):
    rows = _slim(spark, sf)
    return sa.dense_index(rows, rows.count())


@query(
    "upsample",
    f"WITH {_RANKED}, {_DRAWS} SELECT doc_id, copy::INTEGER AS copy FROM drawn",
)
def upsample(spark, sf):
    rows = _slim(spark, sf)
    n = sa.class_size(rows, "source", "true")
    return sa.sample_with_replacement(rows.where("source = 'neural'"), n).select("doc_id", "copy")


@query(
    "downsample",
    f"""WITH {_RANKED} SELECT doc_id, source FROM ranked
    WHERE source <> 'neural' AND place <= (SELECT n FROM sizes WHERE source = 'neural')""",
)
def downsample(spark, sf):
    rows = _slim(spark, sf)
    n = sa.class_size(rows, "source", "neural")
    return sa.sample_exact(rows, {"true": n, "fake": n}, "source").select("doc_id", "source")


@query(
    "balanced_up",
    f"""WITH {_RANKED}, {_DRAWS}
    SELECT source, doc_id, copy::INTEGER AS copy FROM drawn
    UNION ALL SELECT source, doc_id, 1 FROM corpus WHERE source <> 'neural'""",
)
def balanced_up(spark, sf):
    return sa.balance(_slim(spark, sf), "up").select("source", "doc_id", "copy")


@query(
    "balanced_down",
    f"""WITH {_RANKED} SELECT source, doc_id FROM ranked
    WHERE place <= (SELECT n FROM sizes WHERE source = 'neural')""",
)
def balanced_down(spark, sf):
    return sa.balance(_slim(spark, sf), "down").select("source", "doc_id")


def _quota(name: str, sizes: str, total: str) -> str:
    """SQL for the largest-remainder shares of ``total`` over the classes in ``sizes``."""
    return f"""{name} AS (
      SELECT source, n, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, source)
               <= want - sum(base) OVER () THEN 1 ELSE 0 END AS quota
      FROM (SELECT source, n, want, want * n // everything AS base, want * n % everything AS rem
            FROM (SELECT source, n, sum(n) OVER ()::BIGINT AS everything,
                         ceil(round({total} * sum(n) OVER (), 9))::BIGINT AS want FROM {sizes})))"""


@query(
    "split_80_20",
    f"""WITH {_RANKED}, {_quota('test_quota', 'sizes', '0.2')}
    SELECT doc_id, source, CASE WHEN place <= quota THEN 'test' ELSE 'train' END AS split
    FROM ranked JOIN test_quota USING (source)""",
)
def split_80_20(spark, sf):
    return sa.stratified_split(_slim(spark, sf)).select("doc_id", "source", "split")


@query(
    "split_70_10_20",
    f"""WITH {_RANKED}, {_quota('test_quota', 'sizes', '0.2')},
    rest AS (SELECT source, n - quota AS n FROM test_quota), {_quota('valid_quota', 'rest', '0.125')}
    SELECT doc_id, source, CASE WHEN place <= t.quota THEN 'test'
      WHEN place <= t.quota + v.quota THEN 'valid' ELSE 'train' END AS split
    FROM ranked JOIN test_quota t USING (source) JOIN valid_quota v USING (source)""",
)
def split_70_10_20(spark, sf):
    rows = sa.stratified_split(_slim(spark, sf), valid_of_rest=0.125)
    return rows.select("doc_id", "source", "split")
