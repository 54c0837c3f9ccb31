import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corpusflow.functions import text as tx, tokens as tk
from corpusflow.operators import corpus as co

SPACES = [chr(c) for c in range(0x3001) if re.match(r"\s", chr(c))]
QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def expected_clean(text):
    return re.sub(r"\s+", " ", text.replace("\xa0", " ").replace("&nbsp;", " ")).strip()


def run(spark, texts, build):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["out"] for r in rows.select("i", build("text").alias("out")).orderBy("i").collect()]


def test_whitespace_class_is_complete(spark):
    assert len(SPACES) == 29
    texts = [f"{s}a{s}{s}b{s}" for s in SPACES]
    assert run(spark, texts, tx.clean_text) == ["a b"] * 29
    assert run(spark, texts, tx.strip) == [f"a{s}{s}b" for s in SPACES]


def test_clean_examples(spark):
    assert run(spark, [None, "a\xa0&nbsp;\t \x1cb", "", "a😀b"], tx.clean_text) == ["", "a b", "", "a😀b"]


@pytest.mark.parametrize(
    "text, cut, limited",
    [
        (None, "", ""),
        ("WASHINGTON (Reuters) - a-b", "a-b", "a-b"),
        ("no hyphen ", "no hyphen", "no hyphen"),
        ("well-known fact", "known fact", "known fact"),
        ("a long start without any dateline at all, well-known", "known", "a long start without any dateline at all, well-known"),
        ("-", "", ""),
    ],
)
def test_delete_prefix(spark, text, cut, limited):
    assert run(spark, [text], tx.delete_prefix) == [cut]
    assert run(spark, [text], lambda c: tx.delete_prefix(c, 30)) == [limited]


@QUICK
@given(st.lists(st.lists(st.sampled_from(SPACES + list("ab-é😀") + ["&nbsp;"])).map("".join), min_size=1, max_size=20))
def test_clean_matches_python_and_is_idempotent(spark, texts):
    once = run(spark, texts, tx.clean_text)
    assert once == [expected_clean(t) for t in texts]
    assert run(spark, once, tx.clean_text) == once


@QUICK
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_nfkc_matches_python(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert run(spark, texts, tk.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_nfkc_on_every_candidate_range(spark):
    texts = [chr(c) for c in range(1, 0x600)]
    assert run(spark, texts, tk.nfkc) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_words_and_terms(spark):
    texts = ["Hello, world!! it's_1 x", "a bb CCC"]
    assert run(spark, texts, tk.words)[0] == ["Hello", ",", "world", "!!", "it", "'", "s_1", "x"]
    assert run(spark, texts, lambda c: tk.terms(c, ["bb"])) == [["hello", "world", "it", "s_1"], ["ccc"]]


def test_length_filter_keeps_both_ends(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (749, 750, 5000, 5001)], "text string")
    kept = co.keep_lengths(co.add_length(rows))
    assert sorted(r["length"] for r in kept.collect()) == [750, 5000]
    assert run(spark, ["a😀b"], tx.text_length) == [3]


def test_corpus_lines(spark):
    rows = spark.createDataFrame([(" = Title = ",), ("  ",), ("",), (" text ",), ("a = b",)], "value string")
    assert sorted(r["text"] for r in co.corpus_lines(rows).collect()) == ["a = b", "text"]


def test_row_steps_work_on_a_stream(spark, tmp_path):
    """Cleaning and filtering take a streaming table unchanged."""
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "WIRE - a\xa0b"), (2, "c")], "doc_id bigint, text string").write.parquet(folder)
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(folder)
    cleaned = co.add_length(co.cut_dateline(stream))
    run_ = cleaned.writeStream.format("memory").queryName("cleaned").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start()
    run_.awaitTermination()
    assert sorted((r["doc_id"], r["text"]) for r in spark.table("cleaned").collect()) == [(1, "a b"), (2, "c")]


def test_no_python_in_cleaning_plans(spark):
    rows = spark.createDataFrame([(1, "a", "en")], "doc_id bigint, text string, lang string")
    plan = co.keep_lengths(co.add_length(co.cut_dateline(co.keep_language(rows))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text
    # the cleaning expression occurs once, although the filter needs its length
    assert text.count("regexp_replace(regexp_replace") + text.count("replace(coalesce(regexp_replace") <= 2


def test_null_and_empty_texts_are_counted(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "text string")
    assert tuple(co.count_empty_texts(rows).first()) == (2, 1)
    assert [r["text"] for r in co.drop_empty_texts(rows).collect()] == ["a"]


def test_concat_fills_missing_columns(spark):
    a = spark.createDataFrame([("x", 1)], "text string, n int")
    b = spark.createDataFrame([("y",)], "text string")
    assert sorted((r["text"], r["n"]) for r in co.concat_sources([a, b]).collect()) == [("x", 1), ("y", None)]
    assert co.concat_sources([b]).select(F.col("text")).count() == 1
