"""Packed training rows: best-fit-decreasing packing of token ids into rows of a fixed length.

Documents are dealt by hash to shards of about equal size, and each shard is packed on its own, so that
no task holds more than a shard.  An overlong document is split into pieces of the row length and a rest;
pieces go in falling length to the fullest row that still has room, found by walking down a segment tree
over the free lengths.  Each row carries its ids (padded), cumulative segment lengths, positions that
start again at every segment, and of each segment the document and its offset in it: joining a document's
segments by offset gives its ids back.

* A null text counts as empty; with ``end`` an empty document is its end id alone, without it it has no
  segment.  Repeated rows are packed as often as they occur.  A null id stays a null in ``doc_ids``.
* Ties in length are broken by (id, digest of id and text, offset), a null id first: the result does not depend
  on the order of rows.  Extra columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusflow.llm.common import row_key
from corpusflow.llm.pieces import encode_texts

PACKED = (
    "shard int, bin int, n_tokens int, ids binary, positions binary, cu_seqlens array<int>,"
    " doc_ids array<bigint>, offsets array<bigint>"
)


class FreeLengths:
    """Open rows by free length, with a segment tree that says below which nodes a row is open."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, free: int, change: int) -> None:
        node = free + self.leaves
        while node:
            self.open[node] += change
            node >>= 1

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least free length of at least ``size``; it is taken out."""
        node = size + self.leaves
        if not self.open[node]:
            # up until a right sibling holds an open row, then down its leftmost path
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        free = node - self.leaves
        row = self.rows[free].pop()
        self._count(free, -1)
        return free, row


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths``, which must fall and be at most ``capacity``."""
    tree, rows = FreeLengths(capacity), []
    for i, size in enumerate(lengths):
        free, row = tree.take(size) or (capacity, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if free > size:
            tree.add(free - size, row)
    return rows


def _pack_shard(row_length: int, width: int, pad_id: int):
    kind = f"<u{width}"

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        pieces = []
        for ident, key, data in zip(shard["id"], shard["key"], shard["ids"], strict=True):
            ids = np.frombuffer(data, kind)
            order = (not pd.isna(ident), 0 if pd.isna(ident) else int(ident), key)
            pieces += [(-min(row_length, len(ids) - at), order, at, ids) for at in range(0, len(ids), row_length)]
        pieces.sort(key=lambda p: p[:3])
        out = []
        for number, row in enumerate(best_fit([-p[0] for p in pieces], row_length)):
            parts = [pieces[i] for i in row]
            ids = np.full(row_length, pad_id, kind)
            positions = np.zeros(row_length, kind)
            ends = np.cumsum([0, *(-p[0] for p in parts)])
            for (size, _, at, doc), begin in zip(parts, ends[:-1], strict=True):
                ids[begin : begin - size] = doc[at : at - size]
                positions[begin : begin - size] = np.arange(-size)
            doc_ids = [p[1][1] if p[1][0] else None for p in parts]
            out.append((int(shard["shard"].iloc[0]), number, int(ends[-1]), ids.tobytes(), positions.tobytes(), ends.tolist(), doc_ids, [p[2] for p in parts]))
        return pd.DataFrame(out, columns=["shard", "bin", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "offsets"])

    return pack


def pack_documents(
    docs: DataFrame, model: bytes, row_length: int = 2048, shards: int = 64, width: int = 2, pad_id: int = 0, end: bool = True,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a packed row of ``row_length`` ids; ids and positions are little-endian, ``width`` bytes each."""
    if not 0 < row_length <= 256**width:
        raise ValueError("positions must fit the width of the ids")
    key = row_key(id_col, text_col)
    rows = docs.select(
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).cast("bigint").alias("id"), key.alias("key"),
        F.col(text_col).alias("text"),
    )
    rows = encode_texts(rows, model, width=width, end=end).drop("text")
    return rows.groupBy("shard").applyInPandas(_pack_shard(row_length, width, pad_id), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """The id matrix, its positions and segment tables as Parquet: a row of the matrix a row of the table."""
    packed.write.parquet(path)
