import hashlib
import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from corpusflow.operators import dedup, labels, sampling as sa

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def table(spark, classes):
    return spark.createDataFrame([(i, c, f"text {i}") for i, c in enumerate(classes)], "doc_id bigint, source string, text string")


@QUICK
@given(st.lists(st.sampled_from(["a", "a", "a", "b", "c"]), min_size=3, max_size=120))
def test_split_has_exact_quotas_and_is_complete(spark, classes):
    rows = table(spark, classes)
    split = sa.stratified_split(rows, valid_of_rest=0.125)
    got = {r["doc_id"]: (r["source"], r["split"]) for r in split.collect()}
    assert set(got) == set(range(len(classes)))
    n = len(classes)
    sizes = Counter(s for _, s in got.values())
    assert sizes["test"] == math.ceil(round(0.2 * n, 9))
    assert sizes["valid"] == math.ceil(round(0.125 * (n - sizes["test"]), 9))
    per_class = Counter(got.values())
    for cls, count in Counter(classes).items():
        assert abs(per_class[(cls, "test")] - 0.2 * count) < 1.5
        # the test rows of a class are those with the smallest hashes
        order = sorted((i for i, c in enumerate(classes) if c == cls), key=key)
        assert all(got[i][1] == "test" for i in order[: per_class[(cls, "test")]])


def test_split_ignores_partitioning(spark):
    rows = table(spark, ["a", "b", "b", "c"] * 50)
    one = {tuple(r) for r in sa.stratified_split(rows.coalesce(1)).select("doc_id", "split").collect()}
    many = {tuple(r) for r in sa.stratified_split(rows.repartition(13)).select("doc_id", "split").collect()}
    assert one == many


def test_rank_lookup_with_many_prefixes(spark, monkeypatch):
    """Small prefixes force the histogram path to be used for real."""
    monkeypatch.setattr(sa, "ROWS_PER_PREFIX", 2)
    rows = table(spark, ["a"] * 700 + ["b"] * 100)
    order = {c: sorted((key(i) for i in r)) for c, r in (("a", range(700)), ("b", range(700, 800)))}
    asked = spark.createDataFrame([("=a", 0, 1), ("=a", 1, 350), ("=a", 2, 700), ("=b", 0, 100)], "_class string, _cut int, _rank bigint")
    found = {(r["_class"], r["_cut"]): r["_h"] for r in sa.hash_cuts(rows, "source", asked, 700).collect()}
    assert found == {("=a", 0): order["a"][0], ("=a", 1): order["a"][349], ("=a", 2): order["a"][699], ("=b", 0): order["b"][99]}
    index = {r["doc_id"]: r["index"] for r in sa.dense_index(rows, 800).collect()}
    assert [i for i, _ in sorted(index.items(), key=lambda kv: kv[1])] == sorted(range(800), key=key)


def test_one_hot_class(spark):
    """A third of the rows in one class, the rest in many: quotas still exact."""
    rows = table(spark, ["hot"] * 100 + [f"c{i % 20}" for i in range(200)])
    split = sa.stratified_split(rows)
    assert split.where("split = 'test'").count() == 60
    assert split.where("split = 'test' and source = 'hot'").count() == 20


def plain_quotas(sizes, total):
    whole = sum(sizes.values())
    quotas = {c: total * n // whole for c, n in sizes.items()}
    for c in sorted(sizes, key=lambda c: (-(total * sizes[c] % whole), c))[: total - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 50])
def test_a_hundred_thousand_classes(spark, monkeypatch, broadcast_rows):
    """Exact quotas of every class; one class holds a third of all rows, some rows have none."""
    monkeypatch.setattr(sa, "BROADCAST_ROWS", broadcast_rows)
    label = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 100_003).cast("string")))
    rows = spark.range(400_000).select(F.col("id").alias("doc_id"), label.alias("source"), F.lit("t").alias("text"))
    split = sa.stratified_split(rows, valid_of_rest=0.125)
    found = {(r["source"], r["split"]): r["n"] for r in split.groupBy("source", "split").agg(F.count("*").alias("n")).collect()}
    sizes = Counter()
    for (c, _), n in found.items():
        sizes["" if c is None else f"={c}"] += n
    assert len(sizes) > 100_000 and sum(sizes.values()) == 400_000
    tests = plain_quotas(sizes, 80_000)
    valids = plain_quotas({c: n - tests[c] for c, n in sizes.items()}, 40_000)
    for c, n in sizes.items():
        name = c[1:] if c else None
        parts = [found.get((name, part), 0) for part in ("test", "valid", "train")]
        assert parts == [tests[c], valids[c], n - tests[c] - valids[c]]


def test_sample_of_many_classes(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 15_000).alias("source"), F.lit("t").alias("text"))
    sizes = sa.class_counts(rows, "source").select("_class", F.lit(2).cast("bigint").alias("size"))
    drawn = sa.sample_exact(rows, sizes, "source")
    assert drawn.count() == 30_000 and drawn.groupBy("source").count().where("count <> 2").count() == 0
    down = sa.balance(rows.withColumn("source", F.when(F.col("doc_id") < 3, "neural").otherwise((F.col("doc_id") % 15_000).cast("string"))), "down")
    assert down.count() == 3 * 15_001


def test_ranks_over_ranges(spark):
    rows = spark.range(5_000).select((F.col("id") % 700).alias("a"), "id").repartition(7)
    found = sa.global_rank(rows, F.desc("a"), F.col("id")).collect()
    expected = sorted(((i % 700, i) for i in range(5_000)), key=lambda r: (-r[0], r[1]))
    assert {(r["a"], r["id"]): r["_rank"] for r in found} == {r: k for k, r in enumerate(expected)}


def test_splits_of_nothing(spark):
    rows = table(spark, ["a"]).limit(0)
    assert sa.stratified_split(rows).collect() == [] and sa.sample_exact(rows, {}, "source").collect() == []


def test_sample_without_replacement(spark):
    rows = table(spark, ["a"] * 30 + ["b"] * 10)
    drawn = sa.sample_exact(rows, {"a": 10, "b": 10}, "source").collect()
    assert len({r["doc_id"] for r in drawn}) == 20
    assert {r["doc_id"] for r in drawn if r["source"] == "a"} == set(sorted(range(30), key=key)[:10])
    with pytest.raises(ValueError, match="without replacement"):
        sa.sample_exact(rows, {"b": 11}, "source")


def test_balance(spark):
    rows = table(spark, ["true"] * 50 + ["fake"] * 30 + ["neural"] * 20)
    up = sa.balance(rows, "up")
    assert {r["source"]: r["count"] for r in up.groupBy("source").count().collect()} == {"true": 50, "fake": 30, "neural": 50}
    assert up.where("source = 'neural'").select("doc_id", "copy").distinct().count() == 50
    down = sa.balance(rows, "down")
    assert {r["source"]: r["count"] for r in down.groupBy("source").count().collect()} == {"true": 20, "fake": 20, "neural": 20}
    assert sa.balance(rows).count() == 100
    with pytest.raises(ValueError):
        sa.balance(rows, "sideways")
    with pytest.raises(ValueError):
        sa.balance(table(spark, ["true"] * 2 + ["fake"] + ["neural"] * 2), "down")


def test_split_moves_no_text(spark):
    """The split is a filter against broadcast cut points: no exchange in its plan."""
    plan = sa.stratified_split(table(spark, ["a", "b"] * 20))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@QUICK
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from(["p", "q", "r", None])), min_size=1, max_size=30))
def test_dedup_keeps_the_first(spark, pairs):
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(pairs)], "doc_id bigint, source string, text string")
    first, first_in_class = {}, {}
    for i, (s, t) in enumerate(pairs):
        first.setdefault(t, i)
        first_in_class.setdefault((s, t), i)
    assert {r["doc_id"] for r in dedup.drop_duplicate_texts(rows).collect()} == set(first.values())
    got = dedup.drop_duplicate_texts(rows, ("source",)).collect()
    assert {r["doc_id"] for r in got} == set(first_in_class.values()) and len(got) == len(first_in_class)


def test_dedup_of_one_text_held_by_a_third(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text", "'s' as source")
    assert dedup.drop_duplicate_texts(rows).count() == 2001
    assert dedup.class_conflicts(rows).count() == 0


def test_labels(spark):
    rows = spark.createDataFrame([("true",), ("other",), (None,)], "source string")
    dim = labels.label_dim(spark)
    got = labels.add_label_id(rows, dim, "source", on_unknown="null").collect()
    assert {(r["source"], r["label_id"]) for r in got} == {("true", 0), ("other", None), (None, None)}
    with pytest.raises(Exception, match="unknown label: other"):
        labels.add_label_id(rows.where("source = 'other'"), dim, "source").collect()
    ordered = labels.alphabetical_scheme(spark.createDataFrame([("b",), ("a",), ("b",)], "x string"), "x")
    assert {(r["label"], r["label_id"]) for r in ordered.collect()} == {("a", 0), ("b", 1)}


def test_rows_without_a_class_are_refused(spark):
    rows = spark.createDataFrame([(1, "true"), (2, "neural"), (3, None)], "doc_id bigint, source string")
    for mode in ("up", "down"):
        with pytest.raises(ValueError, match="have no source"):
            sa.balance(rows, mode)


def test_any_number_of_labels(spark):
    rows = spark.range(30_000).select(F.format_string("l%06d", (F.col("id") * 7919) % 20_011).alias("label"))
    dim = labels.alphabetical_scheme(rows, "label")
    found = sorted((r["label_id"], r["label"]) for r in dim.collect())
    assert [i for i, _ in found] == list(range(20_011)) and [x for _, x in found] == sorted(x for _, x in found)
    assert labels.alphabetical_scheme(rows.limit(0), "label").count() == 0


def test_dedup_moves_no_text(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 500).alias("text"), F.lit("a").alias("source"))
    kept = dedup.drop_duplicate_texts(docs.withColumn("text", F.concat("text", (F.col("doc_id") % 1999).cast("string"))))
    assert kept.count() == 1999
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "left_anti" in plan.lower() or "LeftAnti" in plan
