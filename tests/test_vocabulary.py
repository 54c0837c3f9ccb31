import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.functions.arrays import pad_mask
from corpusflow.operators import encode as en, vocab as vo, wordpiece as wp
from corpusflow.sources import stores

tokenizers = pytest.importorskip("tokenizers")


def greedy(word_counts, size, special=vo.SPECIAL_TOKENS):
    """One merge at a time, straight from the definition."""
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in word_counts}
    seen = {p for pieces in words.values() for p in pieces}
    plain = {p[2:] if p.startswith("##") and len(p) > 2 else p for p in seen}
    tokens = [*special, *sorted(plain), *sorted(p for p in seen if p not in plain)]
    while len(tokens) < size:
        pairs = Counter()
        for w, pieces in words.items():
            for a, b in zip(pieces, pieces[1:]):
                pairs[(a, b)] += word_counts[w]
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        merged = a + b.removeprefix("##")
        for w, pieces in words.items():
            out, i = [], 0
            while i < len(pieces):
                if pieces[i : i + 2] == [a, b]:
                    out.append(merged)
                    i += 2
                else:
                    out.append(pieces[i])
                    i += 1
            words[w] = out
        if merged not in tokens:
            tokens.append(merged)
    return tokens[:size]


TEXTS = [
    "the cat sat on the mat, the other cat ran to the theatre",
    "banana bananas anagram nanan aaaa aaaaa aaa within thin things",
    "he said: 'no!' again and again -- nothing. éclair élan 東京 東北",
]


@pytest.fixture(scope="module")
def counts(spark):
    return vo.word_counts(spark.createDataFrame([(t,) for t in TEXTS], "text string"))


@pytest.mark.parametrize("max_words, max_pairs", [(1_000, 1_000), (4, 1_000), (10, 30)])
def test_training_equals_single_merges(counts, max_words, max_pairs):
    """All words in one round, and rounds over stretches of hot pairs."""
    by_word = {r["word"]: r["n"] for r in counts.collect()}
    got = [r["token"] for r in wp.train_wordpiece(counts, 95, max_words=max_words, max_pairs=max_pairs).orderBy("token_id").collect()]
    assert got == greedy(by_word, 95)
    assert got[:5] == list(vo.SPECIAL_TOKENS)


def test_training_on_many_words(spark, sf_dir):
    """Pieces made twice, overlapping pairs, ties; every merge there is, and rounds that end at pieces made twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12)
    counts = vo.word_counts(docs).union(spark.createDataFrame([("aaaaaaa", 9), ("abababab", 8), ("a", 5), ("##", 3), ("#", 2)], "word string, n bigint"))
    counts = counts.groupBy("word").agg(F.sum("n").alias("n")).where("crc32(word) % 3 = 0 OR word LIKE 'a%'").cache()
    by_word = {r["word"]: r["n"] for r in counts.collect()}
    expected = greedy(by_word, 450)
    for options in ({}, {"max_words": 60}):
        assert [r["token"] for r in wp.train_wordpiece(counts, 450, **options).orderBy("token_id").collect()] == expected
    every = [r["token"] for r in wp.train_wordpiece(counts, 10**6).orderBy("token_id").collect()]
    assert every[:450] == expected and set(by_word) <= set(every)


def test_training_sends_few_bytes(spark, monkeypatch):
    """Words and stretches reach the driver compressed, and the most frequent pairs alone."""
    counts = spark.range(20_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 6).alias("word")).groupBy("word").agg(F.count("*").alias("n")).cache()
    plain, frame, sent = counts.toArrow(), type(counts), []
    assert sorted(wp.collected(counts).to_pylist(), key=str) == sorted(plain.to_pylist(), key=str)
    assert wp.collected(counts.limit(0)).num_rows == 0
    whole, listed = frame.toArrow, frame.collect
    monkeypatch.setattr(frame, "toArrow", lambda self: (sent.append(table := whole(self)), table)[1])
    monkeypatch.setattr(frame, "collect", lambda self: (sent.append(rows := listed(self)), rows)[1])
    for options in ({}, {"max_words": 5_000, "max_pairs": 40}):
        sent.clear()
        wp.train_wordpiece(counts, 45, **options)
        assert sum(x.nbytes for x in sent if not isinstance(x, list)) < 0.5 * plain.nbytes
        rows = [x for x in sent if isinstance(x, list)]
        assert not any("a" in x[0].asDict() for x in rows if x)


def test_the_most_frequent_pairs(spark):
    """All pairs of a count or none; of the first count as many as are asked for and one."""
    pairs = spark.createDataFrame([("a", "b", 5), ("c", "b", 5), ("b", "b", 5), ("d", "e", 3), ("d", "f", 3), ("e", "e", 1)], "a string, b string, n bigint")
    for most, names, floor in ((1, "ab", 4), (2, "abc", 4), (3, "abc", 3), (4, "abc", 3), (5, "abcdd", 1), (6, "abcdde", 0), (9, "abcdde", 0)):
        found, bound = wp.most_frequent(pairs, most)
        assert ("".join(row["a"] for row in found), bound) == (names, floor)
    assert wp.most_frequent(pairs.limit(0), 3) == ([], 0)


def test_training_leaves_rare_pairs(counts):
    tokens = [r["token"] for r in wp.train_wordpiece(counts, 10_000, min_pair_count=3).collect()]
    assert "the" in tokens and "theatre" not in tokens


def test_training_reaches_the_size(counts):
    tokens = [r["token"] for r in wp.train_wordpiece(counts, 100).collect()]
    assert len(tokens) == len(set(tokens)) == 100


@pytest.fixture(scope="module")
def vocab(spark, counts):
    tokens = greedy({r["word"]: r["n"] for r in counts.collect()}, 110)
    return tokens, vo.vocabulary_from_tokens(spark, tokens)


def library(tokens):
    model = tokenizers.models.WordPiece({t: i for i, t in enumerate(tokens)}, unk_token="[UNK]")
    out = tokenizers.Tokenizer(model)
    out.normalizer = tokenizers.normalizers.NFKC()
    out.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    out.decoder = tokenizers.decoders.WordPiece()
    out.add_special_tokens(list(vo.SPECIAL_TOKENS))
    return out


SAMPLES = [
    *TEXTS,
    "",
    "   ",
    "unknown ☃ letters Zebra",
    "x" * 101 + " cat",
    "a" * 100,
    "cat, mat. the! on? it's 'm ... .,",
    "ﬁne ① the\xa0cat",
    "the cat " * 90,
    "[MASK] it [CLS]the([SEP]) [sep] ..[PAD]",
]


@pytest.mark.parametrize("limit", [500_000, 10])
def test_encode_and_decode_match_the_library(spark, vocab, limit):
    """Both the broadcast and the joined vocabulary."""
    tokens, table = vocab
    lib = library(tokens)
    rows = spark.createDataFrame([*enumerate(SAMPLES), (99, None)], "doc_id bigint, text string")
    encoded = en.encode(rows, table, max_broadcast=limit)
    got = {r["doc_id"]: r["tokens"] for r in encoded.collect()}
    assert got.pop(99) == []
    expected = {i: lib.encode(t).ids for i, t in enumerate(SAMPLES)}
    assert got == expected
    texts = en.decode(encoded, table, "tokens", max_broadcast=limit)
    decoded = {r["doc_id"]: r["decoded"] for r in texts.collect()}
    assert decoded.pop(99) == ""
    assert decoded == {i: lib.decode(ids) for i, ids in expected.items()}


def test_single_and_pair_inputs(spark):
    longest_first = tokenizers.Tokenizer(
        tokenizers.models.WordLevel({**{t: i for i, t in enumerate(vo.SPECIAL_TOKENS)}, "a": 5, "b": 6}, unk_token="[UNK]")
    )
    longest_first.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    longest_first.post_processor = tokenizers.processors.TemplateProcessing(
        single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1", special_tokens=[("[CLS]", 1), ("[SEP]", 2)]
    )
    longest_first.enable_truncation(20)
    longest_first.enable_padding(length=20, pad_id=0)
    cases = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in range(0, 26, 1) for b in range(0, 26, 3))]
    rows = spark.createDataFrame([(i, [5] * a, [6] * b) for i, a, b in cases], "i int, a array<int>, b array<int>")
    pairs = {r["i"]: r for r in en.model_input(rows, "a", "b", 20).collect()}
    singles = {r["i"]: r for r in en.model_input(rows, "a", max_len=20).withColumn("mask", pad_mask("input_ids")).collect()}
    for i, a, b in cases:
        expected = longest_first.encode("a " * a, "b " * b)
        assert (pairs[i]["input_ids"], pairs[i]["token_type_ids"]) == (expected.ids, expected.type_ids), (a, b)
        alone = longest_first.encode("a " * a)
        assert singles[i]["input_ids"] == alone.ids
        assert singles[i]["mask"] == [m == 0 for m in alone.attention_mask]
    unpadded = en.model_input(rows.where("i = 0"), "a", max_len=20, pad=False).first()
    assert unpadded["input_ids"] == [1, 2] and unpadded["token_type_ids"] == [0, 0]


def test_vocabulary_files_and_uneven_batches(spark, vocab, tmp_path):
    tokens, table = vocab
    stores.save_vocabulary(table, str(tmp_path / "v"))
    back = stores.load_vocabulary(spark, str(tmp_path / "v"))
    assert [r["token"] for r in back.orderBy("token_id").collect()] == tokens
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["cat", "the", "banana", "☃", ""], 7)) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r["doc_id"]: r["tokens"] for r in en.encode(rows, back).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    lib = library(tokens)
    assert got == {i: lib.encode(t).ids for i, t in enumerate(texts)}


def test_encoding_moves_no_text(spark, vocab):
    plan = en.encode(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), vocab[1])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and json.dumps(text).count("BatchEvalPython") == 0


def test_word_vocabulary_has_every_character(counts):
    tokens = {r["token"] for r in vo.word_vocabulary(counts, 3).collect()}
    letters = {c for t in TEXTS for c in t if not c.isspace()}
    assert letters <= tokens and {f"##{c}" for c in letters} <= tokens and {"the", "again"} <= tokens
    assert counts.agg(F.sum("n")).first()[0] == sum(len(tokenizers.pre_tokenizers.Whitespace().pre_tokenize_str(t)) for t in TEXTS)


def test_both_paths_agree_on_odd_input(spark):
    vocab = vo.vocabulary_from_tokens(spark, [*vo.SPECIAL_TOKENS, "<unk>", "x", "##y"])
    texts = spark.createDataFrame([(1, "x xy q"), (2, None), (3, "")], "doc_id bigint, text string")
    ids = spark.createDataFrame([(1, [1, 6, 99, 7, -1, None]), (2, None), (3, []), (4, [88, 6])], "doc_id bigint, input_ids array<int>")
    coded, read = [], []
    for limit in (1000, 1):
        rows = en.encode(texts, vocab, unknown="<unk>", max_broadcast=limit).collect()
        coded.append(sorted((r["doc_id"], r["tokens"]) for r in rows))
        read.append(sorted((r["doc_id"], r["decoded"]) for r in en.decode(ids, vocab, max_broadcast=limit).collect()))
    assert coded[0] == coded[1] == [(1, [6, 6, 7, 5]), (2, []), (3, [])]
    assert read[0] == read[1] == [(1, "xy"), (2, ""), (3, ""), (4, "x")]


def test_a_small_vocabulary_keeps_the_alphabet(spark):
    words = spark.createDataFrame([("abcdef", 3), ("xyz", 2)], "word string, n bigint")
    tokens = {r["token"] for r in wp.train_wordpiece(words, vocab_size=9).collect()}
    assert set("abcdefxyz") <= tokens


def test_batches_are_cut_by_size(spark, monkeypatch):
    """Rows of a batch are worked on a bounded number of words at a time, whatever a batch holds."""
    import pyarrow as pa

    from corpusflow.functions.tokens import slices

    words = pa.array([["a"] * n if n is not None else None for n in (3, 0, None, 4, 9, 2, 2, 2)])
    cut = list(slices(words, 5))
    assert [len(s) for s in cut] == [3, 1, 1, 2, 1] and pa.concat_arrays(cut).equals(words)
    texts = pa.array(["éa", None, "", "abcdef", "b"])
    assert [s.to_pylist() for s in slices(texts, 4)] == [["éa", None, ""], ["abcdef"], ["b"]]
    assert not list(slices(texts.slice(0, 0), 4)) and [len(s) for s in slices(texts.slice(3), 7)] == [2]
