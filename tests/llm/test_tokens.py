"""Encoding, token files and packing against the library, round trips and plain re-implementations."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusflow.llm import pieces
from corpusflow.llm.catalog import QUERIES, piece_model
from corpusflow.llm.packing import best_fit, pack_documents
from corpusflow.llm.token_files import file_number, placed_ids, scan_token_files, write_token_files
from corpusflow.session import scratch_path

SCHEMA = "doc_id bigint, text string, ids string, key string, part int, row int"
ROWS = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces "), (5, "a▁b"), (6, "word " * 5000), (6, "word " * 5000),
    (None, "no id"), (7, "same"), (8, "same"), (9, "x" * 30000), (None, None), (10, "é😀\n\t\x00 end"), (7, "other text"),
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in ROWS], SCHEMA)


def numbers(data, kind="<u4"):
    return np.frombuffer(data, kind).tolist()


def test_chunks_equal_whole_texts(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 500)  # the table starts anew now and then
    rng = random.Random(3)
    texts = ["".join(rng.choice(" ▁ab\n\té😀  .1<s>'\x00") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    table = pieces.ChunkTable(piece_model(), 4)
    found = [x for at in range(0, 5000, 100) for x in table.encode(texts[at : at + 100])]
    assert [numbers(x) for x in found] == [library.encode(t) for t in texts]


def test_chunks_reach_the_library_in_short_texts(library):
    """Its work on a text grows faster than the text."""
    table, lengths = pieces.ChunkTable(piece_model(), 4), []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode(self, text):
            lengths.append(len(text))
            return library.encode(text)

    table.sp = Counted()
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(100)]
    assert [numbers(x) for x in table.encode(texts)] == [library.encode(t) for t in texts]
    assert max(lengths) < 2_000


def test_batches_of_texts_are_bounded(spark, odd):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name)
    try:
        for given, bound in (("67108864b", "8m"), ("64m", "8m"), ("512k", "512k"), ("1000", "1000")):
            spark.conf.set(name, given)
            pieces.encode_texts(odd, piece_model())
            assert spark.conf.get(name) == bound
    finally:
        spark.conf.set(name, kept)


def test_odd_rows(odd, library):
    model = piece_model()
    both = pieces.decode_ids(pieces.encode_texts(odd, model, begin=True, end=True), model)
    rows = both.collect()
    assert len(rows) == len(ROWS) and set(both.columns) == {*odd.columns, "decoded"}
    for row in rows:
        ids = library.encode(row["text"] or "", add_bos=True, add_eos=True)
        assert numbers(row["ids"]) == ids and row["decoded"] == library.decode(ids)


def test_query_equals_library(spark, sf_dir, library):
    found = {r["doc_id"]: r for r in QUERIES["op4_piece_ids"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        ids = library.encode(doc["text"] or "", add_bos=True, add_eos=True)
        row = found[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [4, 1000, 1 << 20])
def test_token_counts(spark, odd, library, block_bytes):
    path = scratch_path(spark, "tokens")
    write_token_files(odd.repartition(3), path, piece_model())
    counts = scan_token_files(spark, path, block_bytes=block_bytes, within="/kind=tokens/").withColumn("number", file_number(F.col("path")))
    rows = counts.join(placed_ids(spark, path), ["number", "doc"]).collect()
    assert sorted((r["id"] or 0, r["n_tokens"]) for r in rows) == sorted((i or 0, len(library.encode(t or ""))) for i, t in ROWS)
    by_file = {}
    for r in sorted(rows, key=lambda r: (r["number"], r["doc"])):
        assert r["ended"] and r["start"] == by_file.get(r["number"], 0)
        by_file[r["number"]] = r["start"] + r["n_tokens"] + 1


def test_unended_and_odd_files(spark, tmp_path):
    np.asarray([5, 6, 2, 2, 7], "<u2").tofile(tmp_path / "a.bin")
    np.asarray([9, 9], "<u2").tofile(tmp_path / "b.bin")
    (tmp_path / "c.bin").write_bytes(b"")
    rows = scan_token_files(spark, str(tmp_path), block_bytes=2).collect()
    found = sorted((r["path"][-5:], r["doc"], r["start"], r["n_tokens"], r["ended"]) for r in rows)
    assert found == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 1, False), ("b.bin", 0, 0, 2, False)]
    (tmp_path / "d.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole tokens"):
        scan_token_files(spark, str(tmp_path)).collect()


def test_count_query(spark, sf_dir, library):
    found = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert found == {d["doc_id"]: len(library.encode(d["text"] or "")) for d in docs}


def test_best_fit_is_best_fit():
    rng = random.Random(5)
    for capacity in (1, 7, 64, 100):
        sizes = sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True)
        free = []
        for size in sizes:
            room = min((f for f in free if f >= size), default=None)
            if room is not None:
                free.remove(room)
            free.append((capacity if room is None else room) - size)
        rows = best_fit(sizes, capacity)
        assert sorted(capacity - sum(sizes[i] for i in row) for row in rows) == sorted(free)
        assert sorted(i for row in rows for i in row) == list(range(len(sizes)))


def test_packing_is_lossless(spark, odd, library):
    rows = pack_documents(odd, piece_model(), row_length=64, shards=2).collect()
    whole = {}
    for row in rows:
        ids, positions, ends = numbers(row["ids"], "<u2"), numbers(row["positions"], "<u2"), row["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and ends[0] == 0 and ends[-1] == row["n_tokens"] <= 64
        assert ids[ends[-1] :] == [0] * (64 - ends[-1])
        for a, b, doc, at in zip(ends[:-1], ends[1:], row["doc_ids"], row["offsets"], strict=True):
            assert positions[a:b] == list(range(b - a))
            whole.setdefault((doc or 0, at), []).append(ids[a:b])
    got = sorted(tuple(x) for at, xs in whole.items() for x in xs)
    pieces_of = [library.encode(t or "") + [2] for _, t in ROWS]
    assert got == sorted(tuple(p[i : i + 64]) for p in pieces_of for i in range(0, len(p), 64))
    assert {d for d, _ in whole} == {i or 0 for i, _ in ROWS}


def test_empty_table(spark, odd):
    none = odd.limit(0)
    assert pack_documents(none, piece_model()).count() == 0
    path = scratch_path(spark, "tokens")
    write_token_files(none, path, piece_model())
    assert scan_token_files(spark, path).count() == 0 and placed_ids(spark, path).count() == 0
    assert pieces.encode_texts(none, piece_model()).count() == 0


def test_packed_query_holds_every_document(spark, sf_dir, library):
    rows = QUERIES["op1_packed_rows"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(library.encode(d["text"] or "")) + 1 for d in docs)
    assert {i for r in rows for i in r["doc_ids"]} == {d["doc_id"] for d in docs}
