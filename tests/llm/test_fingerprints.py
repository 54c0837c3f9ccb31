"""Fingerprints against a plain re-implementation, the order of documents, and odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import fingerprints as fp

SCHEMA = "doc_id bigint, text string, tree string, fingerprint string, key int, stretch string, again string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "w") for i, t in rows], SCHEMA)


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain_tree(text):
    out = []
    for line in text.split("\n"):
        out.append((md5(line), len(line)))
    return out


def plain_fingerprint(text):
    parts, section = [], []
    branches = plain_tree(text)
    for i, (digest, n) in enumerate(branches):
        section.append(f"{digest}:{n}")
        if digest.startswith("0") or digest == fp.BLANK or i == len(branches) - 1:
            parts.append(md5(",".join(section)))
            section = []
    pieces = re.findall(fp.SHORT_PIECE if len(text) < fp.SHORT else fp.PIECE, text)
    return hashlib.sha256("".join(parts).encode()).hexdigest() + ":" + "".join(sorted({md5(x)[:8] for x in pieces}))


def plain_likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = [set(re.findall(".{8}", f[65:])) for f in (a, b)]
    return 2 * len(x & y) / max(len(x) + len(y), 1)


def plain_start(a, b):
    if a == b:
        return None
    x, y, at = plain_tree(a), plain_tree(b), 0
    while at < min(len(x), len(y)) and x[at] == y[at]:
        at += 1
    return sum(n + 1 for _, n in x[:at])


def expected(rows):
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, md5(f"{'null' if r[0] is None else r[0]}\x1f{r[1]}")))
    out = []
    for at, (i, text) in enumerate(ordered):
        other = ordered[(at + 1) % len(ordered)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        mine, theirs = plain_fingerprint(text), plain_fingerprint(edited)
        out.append((i, len(text), edited, mine, theirs, plain_likeness(mine, theirs), plain_likeness(mine, plain_fingerprint(other)), plain_start(text, edited)))
    return sorted(map(repr, out))


def texts(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["über", "東京都", "a😀b", "…"]
    out = []
    for _ in range(n):
        lines = [" ".join(draw.choices(words, k=draw.randint(0, 25))) + draw.choice([".", "!?", "", ". "]) for _ in range(draw.randint(1, 40))]
        out.append("\n".join(lines))
    return out


ODD = [(None, "no id"), (None, None), (3, None), (4, ""), (5, "a"), (5, "a"), (5, "b\n"), (5, "\n"), (7, "x y. z! " * 40_000), (-2, "\r\n\r\n"), (9, "a😀b" * 9)]


@pytest.mark.parametrize("stretch_chars, cells", [(2_000_000, 65_536), (300, 7), (1, 1_000)])
def test_equals_plain_python(spark, monkeypatch, stretch_chars, cells):
    rows = ODD + [(i * 1_000 + 11, t) for i, t in enumerate(texts(60, 1))]
    stretches = fp.in_stretches
    monkeypatch.setattr(fp, "in_stretches", lambda d, i, t: stretches(d, i, t, stretch_chars, cells))
    found = [tuple(r) for r in fp.fingerprint_edits(frame(spark, rows).repartition(5)).collect()]
    assert sorted(map(repr, found)) == expected(rows)


def test_single_row_and_no_rows(spark):
    rows = [(1, "One line of text.\nAnd another, of some length, that goes on for a while and is not cut short.")]
    found = [tuple(r) for r in fp.fingerprint_edits(frame(spark, rows)).collect()]
    assert list(map(repr, found)) == expected(rows) and found[0][6] == 1.0
    assert fp.fingerprint_edits(frame(spark, [])).collect() == []


def test_far_apart_ids(spark):
    rows = [(-(2**63), "first of all"), (0, "middle"), (1, "middle"), (2**63 - 1, "last of all")]
    found = {r["id"]: r["edited"] for r in fp.fingerprint_edits(frame(spark, rows)).collect()}
    assert found[-(2**63)] == "first of mid" and found[2**63 - 1] == "last of afi"


def test_roots_likeness_and_place_of_an_edit(spark):
    base = "\n".join(f"Paragraph {i} says something of its own, number {i * i}." for i in range(400))
    changed = base.replace("Paragraph 250 says", "Paragraph 250 said")
    grown = base.replace("Paragraph 100", "A new line.\nParagraph 100")
    cut = "\n".join(base.split("\n")[:-5])
    rows = fp.fingerprint_documents(frame(spark, [(0, base), (1, changed), (2, grown), (3, cut), (4, base), (5, "\n".join(texts(30, 5)))]))
    one = rows.where("doc_id = 0").select(F.col("tree").alias("t"), F.col("fingerprint").alias("f"))
    found = rows.crossJoin(one).select(
        "doc_id", fp.likeness(F.col("f"), F.col("fingerprint")).alias("near"), fp.edit_start(F.col("t"), F.col("tree")).alias("start"),
        (F.substring("f", 1, 64) == F.substring("fingerprint", 1, 64)).alias("equal"),
    )
    found = {r["doc_id"]: r for r in found.collect()}
    assert [found[i]["equal"] for i in range(6)] == [True, False, False, False, True, False]
    assert found[1]["start"] == base.index("Paragraph 250 ") and found[2]["start"] == base.index("Paragraph 100 ")
    assert found[3]["start"] == len(cut) + 1 and found[4]["start"] is None
    assert found[0]["near"] == 1.0 and all(0.95 < found[i]["near"] < 1 for i in (1, 2, 3)) and found[5]["near"] < 0.05


def test_extra_columns_stay(spark):
    rows = fp.fingerprint_documents(frame(spark, ODD))
    assert rows.columns == SCHEMA.replace(",", "").split()[::2] and rows.count() == len(ODD)


def test_plan_is_native(spark):
    plan = fp.fingerprint_edits(frame(spark, ODD))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
