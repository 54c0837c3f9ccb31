"""What the operators of this subpackage share: row keys, joins that stand a hot key, text measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A key is hot when it holds more than one row in HOT_SHARE.  There are fewer than HOT_SHARE such keys,
# whatever the size of the data: that bounds every broadcast of hot keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str | Column, text_col: str | Column) -> Column:
    """16 bytes that name a row by its id and text; repeated rows share one key."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    parts = [F.coalesce(ident.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """All of a row in the struct ``row``, beside an operator's own columns: no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in own.items()])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The packed rows' columns again, in their order; ``changed`` replaces columns or adds new ones."""
    out = [(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns]
    return rows.select(*out, *[v.alias(k) for k, v in changed.items() if k not in columns])


def skew_join(rows: DataFrame, keyed: DataFrame, key: list[str], count_col: str) -> DataFrame:
    """Inner join of ``rows`` with a table of unique keys that says how many rows each key has.

    Rows of hot keys meet a broadcast of at most HOT_SHARE keys and never move; the others are
    shuffled, and no key among them has more than 1 / HOT_SHARE of the rows.  ``rows`` should be a
    stored table: it is read twice.
    """
    total = rows.count()
    is_hot = F.col(count_col) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(keyed.where(is_hot))
    warm = rows.join(hot, key)
    cold = rows.join(hot.select(*key), key, "left_anti").join(keyed.where(~is_hot), key)
    return warm.unionByName(cold)


def blocks_for(docs: DataFrame, text_col: str, chars: int, least: int = 64) -> int:
    """How many hash blocks of about ``chars`` characters the texts fill."""
    total = docs.select(F.sum(F.length(text_col))).first()[0] or 0
    return max(least, -(-total // chars))
