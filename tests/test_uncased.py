"""Uncased text, words and ids against the tokenizers library."""

import sys
import unicodedata

import pytest
import tokenizers
from pyspark.sql import functions as F

from corpusflow.functions import tokens as tk
from corpusflow.operators import encode as en, vocab as vo

WORDS = "the quick brown fox naive cafe strasse 我 们 ##s ##ing ##x un ##want ##ed ii σας i oslo ✓ , . ! ? ' - $ ` ( ) [ ] mask".split()
SAMPLES = [
    "The QUICK brown fox!?", "Naïve CAFÉ, straße — “Oslo”…", "我们abc我 们", "unwanted unwanteds running", "", "   ", "\tThe\r\nfox\x00\x0b\x85x​x�",
    "ΣΑΣ ΣΑΣ. σας İI ıi", "áȩ ́", "[CLS] the [MASK]fox[SEP] [mask] [UNK]é[PAD]", "$5.00 `x` (a)b", "x" * 101 + " the", "the fox　fox fox", "✓the✓",
    "가각 ﬁ ① Å", "the " * 200, "don't stop-it_now", "\U0001d165́a", "豈 the 丽",
]


def library():
    ids = dict(vo.UNCASED_SPECIAL_IDS)
    for token in [*WORDS, *"abcdefghijklmnopqrstuvwxyz0123456789", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789")]:
        ids.setdefault(token, max(ids.values()) + 1)
    out = tokenizers.Tokenizer(tokenizers.models.WordPiece(ids, unk_token="[UNK]"))
    out.normalizer = tokenizers.normalizers.BertNormalizer()
    out.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    out.post_processor = tokenizers.processors.BertProcessing(("[SEP]", ids["[SEP]"]), ("[CLS]", ids["[CLS]"]))
    out.decoder = tokenizers.decoders.WordPiece()
    out.add_special_tokens(list(vo.SPECIAL_TOKENS))
    return ids, out


@pytest.fixture(scope="module")
def lib():
    return library()


@pytest.fixture(scope="module")
def vocab(spark, lib):
    return spark.createDataFrame([(i, t) for t, i in lib[0].items()], "token_id int, token string")


def test_every_character_as_the_library_has_it():
    """Apart from characters that later Unicode versions have added or changed."""
    normalizer, splitter = tokenizers.normalizers.BertNormalizer(), tokenizers.pre_tokenizers.BertPreTokenizer()
    other = []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if normalizer.normalize_str(f"a{c}b") != "a" + tk.uncased_character(c) + "b":
            other.append(c)
            continue
        spaced = ("a" + tk.uncased_character(c, True) + "b").split()
        if spaced != [t for t, _ in splitter.pre_tokenize_str("a" + tk.uncased_character(c) + "b")]:
            other.append(c)
    old = [c for c in other if unicodedata.ucd_3_2_0.category(c) != "Cn"]
    assert len(other) < 700 and len(old) <= 4, [hex(ord(c)) for c in old]


def test_text_and_words(spark):
    rows = spark.createDataFrame([*enumerate(SAMPLES), (99, None)], "i int, text string")
    got = {r["i"]: r for r in rows.select("i", tk.uncased("text").alias("t"), tk.uncased_words("text").alias("w")).collect()}
    assert got.pop(99)[1:] == (None, None)
    normalizer, splitter = tokenizers.normalizers.BertNormalizer(), tokenizers.pre_tokenizers.BertPreTokenizer()
    for i, text in enumerate(SAMPLES):
        expected = normalizer.normalize_str(text)
        assert got[i]["t"] == expected, text
        assert got[i]["w"] == [t for t, _ in splitter.pre_tokenize_str(expected)], text


@pytest.mark.parametrize("limit", [500_000, 10])
def test_ids_and_decoded_text(spark, lib, vocab, limit):
    rows = spark.createDataFrame([*enumerate(SAMPLES), (99, None)], "doc_id bigint, text string")
    special = vo.special_ids(vocab)
    assert special == vo.UNCASED_SPECIAL_IDS
    encoded = en.model_input(en.encode_uncased(rows, vocab, max_broadcast=limit), "tokens", max_len=32, special_tokens=special)
    got = {r["doc_id"]: r for r in en.decode(encoded, vocab, "input_ids", max_broadcast=limit).collect()}
    library_ = lib[1]
    library_.enable_truncation(32)
    library_.enable_padding(length=32, pad_id=0)
    for i, text in enumerate(SAMPLES):
        expected = library_.encode(text)
        assert got[i]["input_ids"] == expected.ids, text
        assert got[i]["decoded"] == library_.decode(expected.ids), text
    library_.no_truncation()
    library_.no_padding()
    assert got[99]["input_ids"][:3] == [101, 102, 0] and got[99]["decoded"] == ""


def test_pairs(spark, lib, vocab):
    cases = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in SAMPLES[:10] for b in ("", "the fox " * 30, SAMPLES[1]))]
    rows = en.encode_uncased(spark.createDataFrame(cases, "doc_id int, l string, r string"), vocab, (("l", "a"), ("r", "b")))
    got = {r["doc_id"]: r for r in en.model_input(rows, "a", "b", 24, special_tokens=vo.special_ids(vocab)).collect()}
    library_ = lib[1]
    library_.enable_truncation(24)
    library_.enable_padding(length=24, pad_id=0)
    for i, a, b in cases:
        expected = library_.encode(a, b)
        assert (got[i]["input_ids"], got[i]["token_type_ids"]) == (expected.ids, expected.type_ids), (a, b)
    library_.no_truncation()
    library_.no_padding()


def test_decode_paths_agree_where_the_vocabulary_has_gaps(spark):
    vocab = spark.createDataFrame([(0, "[PAD]"), (9, "[CLS]"), (2, "##b"), (5, "a"), (7, "b")], "token_id int, token string")
    rows = spark.createDataFrame([(1, [5, 6, 7]), (2, [6, 5]), (3, [9, 1, 2, 0]), (4, [99, -3, None]), (5, None), (6, [])], "doc_id bigint, input_ids array<int>")
    read = [sorted((r["doc_id"], r["decoded"]) for r in en.decode(rows, vocab, max_broadcast=m).collect()) for m in (100, 1)]
    assert read[0] == read[1] == [(1, "a b"), (2, "a"), (3, "##b"), (4, ""), (5, ""), (6, "")]


def test_special_ids_of_a_vocabulary(spark):
    vocab = vo.word_vocabulary(spark.createDataFrame([("ab", 3), ("c", 1)], "word string, n bigint"), 5, vo.UNCASED_SPECIAL_IDS)
    rows = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert {t: rows[t] for t in vo.SPECIAL_TOKENS} == vo.UNCASED_SPECIAL_IDS
    assert sorted(set(rows.values()) - set(vo.UNCASED_SPECIAL_IDS.values())) == list(range(104, 104 + 7))


def test_a_hot_word_is_not_shuffled(spark, vocab):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("the fox " * 50).alias("text"))
    rows = rows.union(spark.createDataFrame([(100, " ".join(f"w{i}" for i in range(2000)))], "doc_id bigint, text string"))
    plan = en.encode_uncased(rows, vocab, max_broadcast=3)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin [word" in plan or "hint=(strategy=broadcast)" in plan
