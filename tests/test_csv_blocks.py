"""CSV read by blocks gives the rows of the multi-line reader, wherever the blocks end."""

import csv
import io
import random

import pytest
from pyspark.sql import Row

from corpusflow.sources import readers
from corpusflow.sources.csv_blocks import begin_inside, ends_inside

SCHEMA = "n int, text string, more string"
PIECES = ["a", "b c", '"', '""', ",", "\n", "\n\n", "\r\n", "é東😀", " ", "'", "x" * 40, '",', ',"', '"\n']


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "70b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "40"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=quoting)
    writer.writerow(["n", "text", "more"])
    writer.writerows(rows)
    return out.getvalue()


def random_rows(seed, n=60):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices(PIECES, k=draw.randint(0, 9)))
    return [(i, text(), text()) for i in range(n)] + [(n, "long\n" * 200 + '"quoted"', None), (n + 1, "", ""), (n + 2, "\n", "end")]


@pytest.mark.parametrize("seed, end, quoting", [(1, "\n", csv.QUOTE_MINIMAL), (2, "\r\n", csv.QUOTE_MINIMAL), (3, "\n", csv.QUOTE_ALL)])
def test_same_rows_as_the_multi_line_reader(spark, tmp_path, small_blocks, seed, end, quoting):
    for part in range(3):
        (tmp_path / f"p{part}.csv").write_text(written(random_rows(seed * 10 + part), end, quoting), newline="")
    (tmp_path / "p3.csv").write_text("n,text,more" + end, newline="")
    (tmp_path / "p4.csv").write_text("")
    lines = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert lines > 30
    if end == "\n":
        expected = sorted(map(repr, readers.read_csv(spark, str(tmp_path), SCHEMA).collect()))
    else:  # there the multi-line reader turns CR LF inside quotes into LF
        expected = sorted(repr(Row(n=n, text=t or None, more=m or None)) for part in range(3) for n, t, m in random_rows(seed * 10 + part))
    found = readers.read_csv_parallel(spark, str(tmp_path), SCHEMA)
    assert sorted(map(repr, found.collect())) == expected and len(expected) == 3 * 63


def test_ids_follow_the_order_of_records(spark, tmp_path, small_blocks):
    rows = random_rows(7)
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(written([(f"{i}", t, name) for i, t, _ in rows]), newline="")
    table = readers.ingest_csv(spark, f"{tmp_path}/*.csv", f"{tmp_path}/table", SCHEMA).orderBy("doc_id").collect()
    assert [(r["more"], r["n"]) for r in table] == [(name, i) for name in "ab" for i in range(len(rows))]
    assert len({r["doc_id"] for r in table}) == len(table)


def test_a_field_over_many_blocks_and_an_open_end(spark, tmp_path, small_blocks):
    inner = "line, and more\n" * 100
    (tmp_path / "x.csv").write_text(f'\n\nn,text,more\n\n1,"{inner}",y\n2,stray " quote,z\n\n')
    rows = readers.read_csv_parallel(spark, str(tmp_path / "x.csv"), SCHEMA).collect()
    assert sorted(map(tuple, rows)) == [(1, inner, "y"), (2, 'stray " quote', "z")]
    (tmp_path / "y.csv").write_text('n,text,more\n1,"never closed\nto the end')
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        readers.read_csv_parallel(spark, str(tmp_path / "y.csv"), SCHEMA).collect()


def test_states_of_lines():
    cases = [("a,b", False, False), ('"a', False, True), ('a"', True, False), ('""', False, False), ('"a""', False, True), ('a","b', True, True),
             ('x"y,z', False, False), ('x,"', False, True), ("plain", True, True), ('""', True, True), ('"",""', False, False), ('","', True, True)]
    for line, begin, end in cases:
        assert ends_inside(line, begin) is end, (line, begin)


def test_prefix_scan_composes_maps(spark):
    draw = random.Random(4)
    blocks = [(f"f{f}", b, draw.random() < 0.5, draw.random() < 0.5) for f in range(5) for b in range(40)]
    expected = set()
    for f in range(5):
        inside = False
        for file, b, outside, within in blocks[f * 40 : f * 40 + 40]:
            if inside:
                expected.add((file, b))
            inside = within if inside else outside
    draw.shuffle(blocks)
    ends = spark.createDataFrame(blocks, "file string, block bigint, from_outside boolean, from_inside boolean")
    assert {tuple(r) for r in begin_inside(ends).collect()} == expected
