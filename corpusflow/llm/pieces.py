"""SentencePiece encoding and decoding through a table of distinct chunks.

In a model whose pieces never run from text into a whitespace marker, a text can be cut before each
run of markers, and every chunk (markers, then one word) is segmented on its own.  A task keeps a table
from distinct chunk to ids: the new chunks of a slice of rows are segmented once, together; the texts are then
joined from the table by position.  The table holds at most ``TABLE_CHUNKS`` chunks; a full one is
started anew, which costs time and changes no result.

* A null text counts as empty.  An empty text has no ids besides the begin and end ids asked for.
* Texts of any length are processed whole.  Repeated rows and ties need no rule: rows are independent.
* Ids are binary: little-endian integers of the width asked for (2 or 4 bytes).
* An existing column with the name of the output is replaced; all others pass through.
* A model that does not fit the method (pieces across markers, other normalisation) is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusflow.session import bound_batches

MARK = "▁"
TABLE_CHUNKS = 300_000
SLICE_ROWS = 100
GROUP = 64  # chunks that the library segments as one text


def load_model(path: str) -> bytes:
    """The model file's bytes (fixed size, it travels with the tasks), checked to fit the method."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    with open(path, "rb") as file:
        data = file.read()
    model = model_pb2.ModelProto()
    model.ParseFromString(data)
    spec = model.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
    normal = [p.piece for p in model.pieces if p.type in (1, 4)]
    if not plain or model.trainer_spec.treat_whitespace_as_suffix or any(MARK in p.lstrip(MARK) for p in normal):
        raise ValueError("pieces of this model can cross a whitespace marker, or it normalises texts")
    return data


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class ChunkTable:
    """Distinct chunk -> its ids as bytes."""

    def __init__(self, model: bytes, width: int) -> None:
        self.sp = _processor(model)
        self.kind = f"<u{width}"
        if self.sp.get_piece_size() > 256**width:
            raise ValueError(f"{self.sp.get_piece_size()} ids do not fit {width} bytes")
        self.starts = np.asarray([self.sp.id_to_piece(i).startswith(MARK) for i in range(self.sp.get_piece_size())])
        self.cut = re.compile(f"{MARK}+[^{MARK}]*")
        self.known: dict[str, bytes] = {}

    def _segment(self, chunks: list[str]) -> None:
        """Add chunks to the table.  Those with one marker go through the library some GROUP at a time as one text (its work
        on a text grows faster than the text): each has one piece that starts with the marker, its first, so the ids
        come apart again there."""
        plain = [c for c in chunks if len(c) > 1 and c[1] != MARK]
        found: list[int] = []
        for at in range(0, len(plain), GROUP):
            found += self.sp.encode("".join(plain[at : at + GROUP])[1:])  # the library puts the first marker back
        ids = np.asarray(found, np.int64)
        data, width = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        ends = [*(np.flatnonzero(self.starts[ids]) * width).tolist(), len(data)]
        if len(ends) != len(plain) + 1:
            raise ValueError("the ids do not come apart at the chunks")
        self.known.update(zip(plain, map(data.__getitem__, map(slice, ends[:-1], ends[1:])), strict=True))
        for chunk in (c for c in chunks if len(c) == 1 or c[1] == MARK):
            # a marker alone is one piece in a text, but nothing when encoded alone
            ids = [self.sp.piece_to_id(MARK)] if chunk == MARK else self.sp.encode(chunk[1:])
            self.known[chunk] = np.asarray(ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > TABLE_CHUNKS:
            self.known, new = {}, set().union(*cut)
        self._segment(list(new))
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]


def _with_column(df: DataFrame, name: str, kind: str, source: str, start: Callable[[], Callable[[list], Iterable]]) -> DataFrame:
    """``df`` with a column made from ``source`` in slices of SLICE_ROWS rows, which bounds a task's memory.

    Only ``source`` goes to the Python workers and only the new column comes back.
    """

    def add(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make, arrow_kind = start(), pa.binary() if kind == "binary" else pa.string()
        for part in parts:
            for at in range(0, max(len(part), 1), SLICE_ROWS):
                yield pa.array(make(part.slice(at, SLICE_ROWS).to_pylist()), arrow_kind)

    bound_batches(df.sparkSession)
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    made = F.arrow_udf(add, kind).asNondeterministic()  # made once, whatever is done with the column
    return df.select(*kept, made(F.col(f"`{source}`")).alias(name))


def encode_texts(
    docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", width: int = 4, begin: bool = False, end: bool = False
) -> DataFrame:
    """``docs`` with the ids of each text as binary."""

    def start():
        table = ChunkTable(model, width)
        first = np.asarray([table.sp.bos_id()], table.kind).tobytes() if begin else b""
        last = np.asarray([table.sp.eos_id()], table.kind).tobytes() if end else b""
        return lambda texts: [first + ids + last for ids in table.encode([t or "" for t in texts])]

    return _with_column(docs, ids_col, "binary", text_col, start)


def decode_ids(rows: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "decoded", width: int = 4) -> DataFrame:
    """``rows`` with the text of each row's ids, as the library decodes them; null ids give null."""

    def start():
        sp = _processor(model)
        return lambda all_ids: [None if x is None else sp.decode(np.frombuffer(x, f"<u{width}").tolist()) for x in all_ids]

    return _with_column(rows, text_col, "string", ids_col, start)
