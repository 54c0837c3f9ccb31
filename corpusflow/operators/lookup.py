"""Joins against small tables, broadcast only when they are proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 100_000
# A key is hot when it holds more than one row in HOT_SHARE: there are fewer than HOT_SHARE such keys at any size.
HOT_SHARE = 1000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; stops reading one row past the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    df: DataFrame, table: DataFrame, on: str | list[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Many-to-one join.

    A lookup table within ``max_rows`` is broadcast.  A larger one takes a shuffle join, where
    AQE splits the partitions of hot keys.
    """
    return df.join(F.broadcast(table) if is_small(table, max_rows) else table, on, how)


def counted_join(df: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join with a table of unique keys that says in ``count`` how many of the ``total`` rows each key has.

    Rows of hot keys meet a broadcast of fewer than ``HOT_SHARE`` keys and stay where they are; the others are
    shuffled, and none of their keys has more than a thousandth of the rows.  ``df`` is read twice.
    """
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(table.where(is_hot).drop(count))
    cold = df.join(hot.select(key), key, "left_anti").join(table.where(~is_hot).drop(count), key)
    return df.join(hot, key).unionByName(cold)
