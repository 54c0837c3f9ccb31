"""Source audit and ranked search against plain re-implementations, and odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import lexical_search as ls, source_audit as sa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD_TEXTS = [None, "", "  \t\n", "ÉCOLE école 东京 a😀b É", "\x00\x01 zz\x7fzz", "A1B2 a1b2 __x__ [q]`w{e}", "the " * 50_000, "İ ı ſ K ß"]


def plain_audit(rows, min_docs=3, top=200):
    docs = [(g or "", s or "", [t.translate(LOWER) for t in TERM.findall(x or "")]) for g, s, x in rows]
    df, per = defaultdict(Counter), defaultdict(Counter)
    for lang, source, found in docs:
        df[lang].update(set(found))
        per[lang, source].update(found)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        sources = sorted(s for g, s in per if g == lang)

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // total for t in kept}

        shares = {s: share(per[lang, s]) for s in sources}
        whole = share(sum((per[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum((shares[s][t] - q) ** 2 // q for t, q in shares[o].items())) for o in sources if o != s]
            over = [(t, (shares[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if per[lang, s][t] and shares[s][t] > whole[t]]
            for part, entries, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                entries = sorted(entries, key=lambda e: (-e[1], e[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(entries)]
    return sorted(out)


def corpus(seed, n=120):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["über", "ÜBER", "東京", "The", "the"]
    rows = []
    for _ in range(n):
        k = draw.choice([0, 1, 5, 40])
        text = draw.choice([" ", ", ", "7", "\n"]).join(draw.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=k))
        rows.append((draw.choice(["en", "fr", None]), draw.choice(["s0"] * 6 + [f"s{i}" for i in range(9)] + [None, ""]), text))
    rows += [("en", "odd", t) for t in ODD_TEXTS] + [("xx", "alone", "one two three")] * 3 + [("yy", "a", "rare"), ("yy", "b", None)] + rows[:7]
    return rows


@pytest.mark.parametrize("batch", [1, 7, 2000])
def test_audit_equals_plain_python(spark, batch):
    rows = corpus(batch)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, head int").repartition(4)
        found = sorted(tuple(r) for r in sa.audit_sources(df, top_terms=5).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == plain_audit(rows, top=5)


def test_audit_of_nothing(spark):
    assert sa.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    found = sa.audit_sources(spark.createDataFrame([(None, None, None)] * 2, "lang string, source string, text string"))
    assert found.collect() == []


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(10**10, 3 * 10**10, 17), (9 * 10**9, 9 * 10**9, 1), (0, 0, 0), (0, 10**12, 10**6), (2**62, 2**62, 5)]
    df = spark.createDataFrame(rows, "c bigint, n bigint, v bigint").select("c", "n", "v", sa.share("c", "n", "v").alias("p"))
    for c, n, v, p in df.collect():
        assert p == (1 + 1_000_000_000 * (c + 1) // (n + v) if v else 1)


def test_pair_sums_do_not_depend_on_what_a_task_holds(monkeypatch):
    draw = random.Random(5)
    rows = sorted((g, t, s, draw.randint(1, 10**9), draw.randint(1, 1000)) for g in "ab" for t in "pqrstu" for s in draw.sample("vwxyz", draw.randint(1, 5)))
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "term", "source", "p", "p0"])

    def total(batches, **options):
        sums = Counter()
        for out in sa._both(iter(batches), **options):
            for g, s, t, v in zip(*out.to_pydict().values(), strict=True):
                sums[g, s, t] += v
        return {k: v for k, v in sums.items() if v}

    expected = total([whole])
    assert total([whole.slice(i, 3) for i in range(0, len(rows), 3)], held=1) == expected
    monkeypatch.setattr(sa, "DENSE", 0)
    assert total([whole]) == expected and len(expected) > 20


def plain_search(docs, items, top=10):
    found = [(i, [t.translate(LOWER) for t in WORD.findall(x or "")]) for i, x in docs]
    n_docs, n_terms = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    asked = defaultdict(set)
    for i, x in items:
        asked[i] |= {t.translate(LOWER) for t in WORD.findall(x or "")}
    out = []
    for item, terms in asked.items():
        scored = []
        for i, words in found:
            tf = Counter(words)
            m = 100 - 90 + (90 * len(words) * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t]
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, e[3], -e[0]) for k, e in enumerate(sorted(scored, key=lambda e: e[:3])[:top])]
    return sorted(out, key=repr)


def search_rows(seed):
    draw = random.Random(seed)
    words = [f"v{i}" for i in range(300)] + ["The", "the", "über", "42"]
    text = lambda k: " ".join(draw.choices(words, weights=[1 / (1 + i) for i in range(len(words))], k=k))
    docs = [(i, text(draw.choice([1, 3, 20, 200]))) for i in draw.sample(range(-500, 5000), 400)]
    docs += [(6000 + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1])] * 3 + [(i, t) for i, t in enumerate(ODD_TEXTS, 7000)] + docs[:20]
    items = [(i, text(draw.randint(1, 30))) for i in range(25)] + [(30, docs[3][1]), (31, "no such wrd"), (32, None), (33, ""), (None, "v1 v2"), (1, "v7 v9"), (1, "v7 v9")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"run_docs": 9}, {"run_postings": 40}, {"block_terms": 30}, {"top": 3}])
def test_search_equals_plain_python(spark, options):
    docs, items = search_rows(len(str(options)))
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], "doc_id bigint, text string, terms string, n int, item_id int").repartition(3)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id int, text string, term string")
    found = sorted((tuple(r) for r in ls.search_documents(d, b, **options).collect()), key=repr)
    assert found == plain_search(docs, items, options.get("top", 10))


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert [tuple(r)[:3] for r in ls.search_documents(docs, items).collect()] == [("1", 1, 1)]
    for d, b in ((docs, items.limit(0)), (docs.limit(0), items), (docs.selectExpr("doc_id", "'' AS text"), items)):
        assert ls.search_documents(d, b).collect() == []


def test_range_maxima_are_those_of_every_range():
    draw = np.random.default_rng(3)
    docs, terms = 60, 4
    has = draw.random((docs, terms)) < 0.4
    ends = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
    run = ls.Run(np.arange(docs), np.zeros(docs, bool), np.full(docs, 9), ends, np.nonzero(has)[1].astype(np.int64), draw.integers(1, 9, ends[-1]), np.asarray([5, 7, 1, 900]), docs, docs * 9)
    lists = np.searchsorted(run.keys, np.arange(terms + 1) * docs)
    for t in range(terms):
        for a in range(lists[t], lists[t + 1]):
            for b in range(a + 1, lists[t + 1] + 1):
                bound, doc = run.maxima(np.asarray([[a]]), np.asarray([[b]]))
                best = a + int(run.impact[a:b].argmax())
                assert bound[0] == run.impact[best] and doc[0] == run.keys[best] % docs


def test_search_reads_few_documents_of_a_run():
    """Documents without a rare term are left out by their bounds."""
    n, seen = 20_000, []
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(12, np.int64)])
    order = np.argsort(np.concatenate([np.arange(n), np.arange(12) * 1500]), kind="stable")
    sizes = np.bincount(np.concatenate([np.arange(n), np.arange(12) * 1500]), minlength=n)
    run = ls.Run(np.arange(n), np.zeros(n, bool), np.full(n, 50), np.concatenate([[0], np.cumsum(sizes)]), terms[order], np.ones(n + 12, np.int64), np.asarray([1, 9000]), n, 50 * n)
    maxima = run.maxima
    run.maxima = lambda a, b: (seen.append(len(a)), maxima(a, b))[1]
    found = run.search(np.asarray([0, 1]), [], 10)
    assert [e[2] for e in found] == [i * 1500 for i in range(10)] and sum(seen) < 500
