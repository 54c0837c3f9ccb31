"""Line and sentence dedup, decontamination and the Jaccard join: SQL twins, brute force, odd rows."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import jaccard_join
from corpusflow.llm.catalog import QUERIES, SQL
from corpusflow.llm.decontaminate import contaminated, without_contaminated
from corpusflow.llm.jaccard_join import jaccard_classes, keep_first_of_class, prefix_depth, shingles, words_of
from corpusflow.llm.line_dedup import dedup_lines
from corpusflow.llm.sentence_dedup import dedup_passages, dedup_sentences

SCHEMA = "doc_id bigint, text string, key string, row int, starts string, id string, pos int"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "s", "x", 2) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    found = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    asked = sorted(repr(tuple(row[names.index(c)] for c in sorted(names))) for row in cursor.fetchall())
    assert found == asked


def brute_cut(rows, width, cut, glue, counts):
    """First place of every span in order of id, then cut what later ones cover."""
    seen, out = set(), []
    for ident, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out.append((ident, None))
            continue
        parts = cut(text)
        covered = set()
        for at in range(len(parts) - width + 1):
            run = tuple(p.strip() if glue == "" else p for p in parts[at : at + width])
            if not counts(run):
                continue
            if run in seen:
                covered |= set(range(at, at + width))
            seen.add(run)
        out.append((ident, glue.join(p for i, p in enumerate(parts) if i not in covered)))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_lines_brute_force(spark):
    rng = random.Random(4)
    lines = ["a", "b", "c", "d", "", " "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(None, "a\nb\nc\nd"), (900, None), (901, ""), (902, "a\nb\nc\n" * 300)]
    found = dedup_lines(frame(spark, rows))
    assert found.columns == [*SCHEMA.replace(",", "").split()[::2], "lines_removed"]
    got = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert key(got) == key(brute_cut(rows, 3, lambda t: t.split("\n"), "\n", lambda run: any(x.strip(" ") for x in run)))


def test_sentences_brute_force(spark):
    rng = random.Random(8)
    pool = ["One two three. ", "Four five! ", "Six seven eight nine? ", "Ten.\n", "Eleven twelve thirteen\n", "Rest"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 10)))) for i in range(150)]
    rows += [(None, "Four five! One two three. "), (900, None), (901, ""), (902, "Four five! Ten.\n" * 300)]

    def cut(text):
        out, at = [], 0
        for i in range(1, len(text)):
            line = text[i - 1] == "\n" and text[i] != "\n"
            end = text[i - 1] in " \t" and text[i] not in " \t\n" and text[:i].rstrip(" \t")[-1:] in (".", "!", "?")
            if line or end:
                out.append(text[at:i])
                at = i
        return [*out, text[at:]]

    found = dedup_sentences(frame(spark, rows), min_words=5)
    got = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert key(got) == key(brute_cut(rows, 2, cut, "", lambda run: sum(len(s.split(" ")) for s in run) >= 5))


def test_passages_of_short_sentences_and_of_one(spark):
    short = "We went out. It was late. No one came. The rain fell on. We sat there. He said no. "
    long = "One sentence of many words stands here between other neighbours each time and is still the very same sentence. "
    rows = [
        (1, f"First in line. {short}End of one."), (2, f"Second in line. {short}End of two."), (3, f"A start. {long}A stop."),
        (4, f"Other start. {long}Other stop."), (5, long.strip()), (6, "It was late. No one came."), (7, None), (8, ""), (None, "Nothing."),
        (9, f"{short}Odd. " * 50), (2, f"Second in line. {short}End of two."),
    ]
    found = sorted(((r["doc_id"], r["text"], r["sentences_removed"]) for r in dedup_passages(frame(spark, rows)).collect()), key=repr)
    two = (2, "Second in line. End of two.", 6)
    asked = [(*rows[0], 0), two, two, (*rows[2], 0), (4, "Other start. Other stop.", 1), (5, "", 1), (*rows[5], 0), (7, None, 0), (8, "", 0)]
    assert found == sorted([*asked, (9, "Odd. ", 349), (None, "Nothing.", 0)], key=repr)
    assert dedup_passages(frame(spark, []).limit(0)).count() == 0


def test_repeated_rows_are_one_occurrence(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text), (1, text), (2, text), (1, "x\na\nb\nc")]
    got = [(r["doc_id"], r["text"]) for r in dedup_lines(frame(spark, rows)).collect()]
    # the two rows with id 1 are ordered by digest: one of them keeps the passage, the repeated rows stay alike
    assert sorted(got)[3] == (2, "") and got.count((1, text)) in (0, 2)
    assert sum("a\nb\nc" in t for _, t in got) in (1, 2)


@pytest.mark.parametrize("operator", [dedup_lines, dedup_sentences, keep_first_of_class])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, []).limit(0)).count() == 0


ITEM = "Anna Smith walks 12 km to the market and buys 30 red apples. Anna Smith then gives 5 of the apples to Tom."
OTHER = "Zoe walks 7 miles to the market and buys 99 red apples. Zoe then gives 3 of the apples to Mark."
MIXED = "Zoe walks 7 miles to the market and buys 99 red apples. Paul then gives 3 of the apples to Mark."
PROSE = "In the old town a river runs by the mill where children play all day and no one counts the hours that pass."


def test_templates_catch_new_numbers_and_names(spark):
    docs = frame(spark, [
        (1, f"{PROSE} {ITEM} {PROSE}"), (2, f"{PROSE}\n{OTHER}\n{PROSE}"), (3, PROSE), (4, None), (5, ""), (6, ITEM.lower()), (None, ITEM),
        (7, MIXED), (8, f"{PROSE} " * 500 + ITEM), (8, f"{PROSE} " * 500 + ITEM),
    ])
    bench = spark.createDataFrame([(1, ITEM, 1), (1, ITEM, 1), (2, None, 1), (3, "", 1), (4, "Too short.", 1)], "item_id int, text string, key int")
    for limit in (200_000, 0):  # broadcast, and joined by a shuffle
        rows = contaminated(docs, bench, broadcast_windows=limit).collect()
        found = {(r["id"], r["item"]): r for r in rows}
        assert set(found) == {(1, 1), (2, 1), (None, 1), (8, 1)} | ({(6, 1)} & set(found)) and len(rows) == len(found)
        assert found[1, 1]["changed_slots"] == 0 and found[1, 1]["coverage"] == 1.0 and found[2, 1]["changed_slots"] >= 5
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {3, 4, 5, 7} <= {r["doc_id"] for r in kept.collect()} and not {1, 2, 8, None} & {r["doc_id"] for r in kept.collect()}


REPEATS = (
    "A train leaves the old station at 9 and covers the long way in 4 hours. A bus leaves the old station at 7 and covers "
    "the long way in 6 hours. A tram leaves the old station at 5 and covers the long way in 8 hours."
)


def test_each_occurrence_of_a_template_counts_alone(spark):
    unsteady = REPEATS.replace("A bus", "The bus").replace("A tram", "One tram").replace("6 hours", "6 days").replace("8 hours", "8 weeks")
    for old, new in zip("945678", ["21", "31", "41", "51", "61", "71"]):
        unsteady = unsteady.replace(f" {old} ", f" {new} ")
    edited = REPEATS.replace("A bus", "Then at long last a rather slow bus")
    docs = frame(spark, [
        (1, f"{ITEM} {OTHER}"), (2, f"{PROSE} {OTHER}\n{ITEM} {PROSE}"), (3, REPEATS), (4, f"{PROSE} {REPEATS} {REPEATS.replace('9', '11')}"),
        (5, edited), (6, unsteady), (7, PROSE), (8, f"{ITEM} {OTHER} " * 40), (1, f"{ITEM} {OTHER}"), (None, REPEATS),
    ])
    bench = spark.createDataFrame([(1, ITEM), (2, REPEATS)], "item_id int, text string")
    rows = contaminated(docs, bench).collect()
    found = {(r["id"], r["item"]): r for r in rows}
    assert set(found) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (8, 1), (None, 2)} and len(rows) == len(found)
    assert all(found[p]["changed_slots"] == 0 and found[p]["coverage"] == 1.0 for p in [(1, 1), (2, 1), (3, 2), (4, 2), (8, 1)])
    assert sorted(r["doc_id"] for r in without_contaminated(docs, bench).collect()) == [6, 7]


def test_copies_in_other_case_other_lines_and_short_items(spark):
    def wrapped(text, n):
        words = text.split()
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    docs = frame(spark, [
        (1, ITEM), (2, ITEM.lower()), (3, ITEM.upper()), (4, wrapped(ITEM, 4)), (5, wrapped(OTHER, 4)), (6, f"{PROSE} who wrote hamlet? {PROSE}"),
        (7, "7 8 9 10 11 12 13 14 15 16"), (8, PROSE), (9, "Who wrote Macbeth? Hamlet!"), (10, None), (10, ""), (None, ITEM.lower()),
    ])
    items = [(1, ITEM), (2, "Who wrote Hamlet?"), (3, "8, 9, 10, 11, 12, 13, 14, 15"), (4, "?!"), (5, wrapped(ITEM, 3))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    asked = {(d, i) for d in (1, 2, 3, 4, 5, None) for i in (1, 5)} | {(6, 2), (7, 3)}
    for limit in (200_000, 0):
        rows = contaminated(docs, bench, broadcast_windows=limit).collect()
        assert {(r["id"], r["item"]) for r in rows} == asked and len(rows) == len(asked)


def test_templates_empty_tables(spark):
    docs = frame(spark, [(1, ITEM)])
    none = spark.createDataFrame([], "item_id int, text string")
    assert contaminated(docs, none).count() == 0
    assert contaminated(docs.limit(0), spark.createDataFrame([(1, ITEM)], "item_id int, text string")).count() == 0


def test_prefix_is_shortened_to_the_recall():
    for target in (0.9, 0.99, 0.9999):
        depth = prefix_depth(24, 8, 0.8, target)
        assert 1 - (1 - 0.8**depth) ** 24 >= target
        assert depth == 8 or 1 - (1 - 0.8 ** (depth + 1)) ** 24 < target


def test_shingles_are_exact():
    words = words_of(" The  a\tthe A b c d e the a the a b ")
    asked = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(shingles(words, 5)) == len(asked) and len(shingles(["x"], 5)) == 1 and len(shingles([], 5)) == 0
    assert set(shingles(words, 5).tolist()) == set(np.concatenate([shingles(list(s), 5) for s in asked]).tolist())


def brute_classes(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links, group = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    names = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted(((rows[i][0], names[group[i]], links[i]) for i in range(len(rows))), key=repr)


def near_copies(rng, groups, copies):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 90))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_jaccard_classes_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 4: every group is cut into pairs of blocks
    rows = near_copies(random.Random(6), 12, 12)
    rows += [(500, None), (501, ""), (502, "  \n"), (503, "one two"), (504, "One  two"), (None, "one two"), (505, "w " * 3000), (505, "w " * 3000)]
    found = jaccard_classes(frame(spark, rows)).collect()
    assert sorted(((r["id"], r["class_id"], r["n_links"]) for r in found), key=repr) == brute_classes(rows)


def test_one_document_of_each_class_stays(spark):
    rows = near_copies(random.Random(9), 6, 6) + [(500, None), (501, ""), (505, "same row"), (505, "same row"), (506, "same row")]
    docs = frame(spark, rows)
    kept = keep_first_of_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(rows)})


def test_no_links_at_all(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)]
    assert sorted((r["id"], r["class_id"], r["n_links"]) for r in jaccard_classes(frame(spark, rows)).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert keep_first_of_class(frame(spark, rows).where(F.col("doc_id") > 1)).count() == 2


def test_large_group_gives_edges_in_proportion(spark, monkeypatch):
    """One group of distinct near copies over many blocks: few more edges than texts, and every link counted."""
    made = {}
    real = jaccard_join.components

    def counted(edges):
        made["edges"] = edges.distinct().count()
        return real(edges)

    monkeypatch.setattr(jaccard_join, "components", counted)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:3], f"own{i}", *base[4:]])) for i in range(3000)]
    found = jaccard_classes(frame(spark, rows)).collect()
    assert len(found) == 3000 and {(r["class_id"], r["n_links"]) for r in found} == {(0, 2999)}
    assert made["edges"] < 3 * len(rows)
