"""Benchmark decontamination by templates, in DataFrame functions.

A text becomes a template: the first word of a sentence and capitalised words become a name slot (a run
of them one slot), numbers a number slot, a unit after a number a unit slot; the rest is lower case
without punctuation.  Windows of ``width`` template tokens of all benchmark items are hash-joined with those
of all documents.  A document that holds at least ``min_coverage`` of an item's distinct windows is then
compared slot by slot over the matched windows: the item's slot values must map to the document's values
consistently, one value to one value, but for a share of 1 - ``min_consistency`` of the values.  So a question with new numbers and names is caught like a copy.
Where all matched windows together are not consistent (several variants in one document, an item that repeats
a template), each occurrence is asked alone: the windows of one alignment (position in the document minus
position in the item), and those with the gaps filled from the nearest alignments.

Texts with lines that begin inside a sentence are read a second time with single line breaks as blanks.

Beside templates, windows of ``width`` case-folded words are joined, so a copy in other letter case, with other line
breaks or with too little outside its slots for a template is found word for word (no slots, ``slots`` is 0).

* Null and empty texts, on either side, match nothing; neither does an item without letters and digits.
* An item shorter than a window is one window of its own length.  As templates, items below ``least`` tokens and
  windows that are mostly slots are not asked; word for word every item is, even one of a single word.
* A long text may hold many items, and an item may occur several times; a pair is one row.  Its counts are those of
  all matched windows, or of the best occurrence where only single occurrences are consistent.
* Repeated rows (same id, same text) of either side are one row of the result; null ids stay null.
* Extra columns are not read, whatever their names.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.llm.common import packed, row_key, unpacked
from corpusflow.operators.corpus import compute_once
from corpusflow.session import materialise

# Units that may follow a number.
UNITS = (
    "mm cm m km g kg mg t l ml s ms h hz khz mhz ghz w kw kwh v j kj n pa mph kmh ft lb lbs oz mi "
    "inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "gram grams kilogram kilograms ton tons liter liters litre litres second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()
_WORD = r"[\p{L}\p{M}'’-]*"
# (pattern, replacement); both regex dialects in use read them alike
TEMPLATE_STEPS = [
    (rf"(\p{{Lu}}\p{{Ll}}{_WORD})", r" <n:\1> "),
    (rf"(^|[.!?][\"')\]]*\s+|\n\s*)(\p{{L}}{_WORD})", r"\1 <n:\2> "),
    (r">\s+<n:", "_"),
    (
        rf"([0-9]+(?:[.,:/][0-9]+)*)(?:\s*(%|{'|'.join(sorted(UNITS, key=len, reverse=True))})([^\p{{L}}\p{{M}}]|$))?",
        r" <d:\1> <u:\2> \3",
    ),
    (r"<u:>", ""),
    (r"(<[^<>]*>)|[^\p{L}\p{M}\p{N}<>]+", r"\1 "),
]


# the same slots at the same places without their values, which is all that windows need
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
KIND_STEPS = [
    (rf"\p{{Lu}}\p{{Ll}}{_WORD}", r" <n> "),
    (rf"(^|[.!?][\"')\]]*\s+|\n\s*)(\p{{L}}{_WORD})", r"\1 <n> "),
    (r"<n>(?:\s+<n>)+", "<n>"),
    (rf"{_NUMBER}\s*(?:%|{'|'.join(sorted(UNITS, key=len, reverse=True))})([^\p{{L}}\p{{M}}]|$)", r" <d> <u> \1"),
    (_NUMBER, " <d> "),
]


# a line that begins inside a sentence with a word that is no slot elsewhere
WRAPPED = r"[^\s.!?][ \t\r]*\n\s*(?!\p{Lu}\p{Ll})\p{L}"
#: In place of the number of a form: matched word for word.
LITERAL = -1


def _unwrapped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\S[ \t\r]*)\n(?=[ \t]*\S)", "$1 ")


def literal_tokens(text: Column) -> Column:
    """Lower-case words and numbers."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")


def template_kinds(text: Column) -> Column:
    """The tokens of :func:`template_tokens` with slots as ``<n>``, ``<d>`` and ``<u>``."""
    out = F.replace(F.replace(text, F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    for pattern, to in KIND_STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    # what stands before the first token and after the last is empty
    return F.array_remove(F.split(F.lower(out), r"[^\p{L}\p{M}\p{N}<>]+"), "")


def template_tokens(text: Column) -> Column:
    """Lower-case tokens; slots are ``<n:value>``, ``<d:value>`` and ``<u:value>``."""
    out = F.replace(F.replace(text, F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    for pattern, to in TEMPLATE_STEPS:
        out = F.regexp_replace(out, pattern, to.replace("\\", "$"))
    return F.split(F.trim(F.lower(out)), " +")


def with_run_hashes(rows: DataFrame, widths: list[int], name: str = "runs") -> DataFrame:
    """``rows`` with ``{name}{w}``: for each width the hashes of all runs of ``w`` entries of the array ``codes``.

    Runs of 2, 4, 8, ... entries come from two of half the length, other widths from those; so a run costs a few hashes
    of two numbers.  The array is empty where ``codes`` is shorter than ``w``.
    """

    def joined(left: str, right: str, by: int) -> Column:
        later = F.slice(right, by + 1, F.greatest(F.size(right) - by, F.lit(0)))
        first = F.slice(left, 1, F.size(later))
        return F.zip_with(first, later, lambda a, b: F.xxhash64(a, b))

    own, spans, span = rows.columns, {1: "codes"}, 1
    while 2 * span <= max(widths):
        rows = compute_once(rows, f"_span{2 * span}", joined(spans[span], spans[span], span))
        spans[2 * span], span = f"_span{2 * span}", 2 * span
    for w in widths:
        parts = [s for s in sorted(spans, reverse=True) if w & s]
        at, last = parts[0], spans[parts[0]]
        for i, part in enumerate(parts[1:]):
            rows = compute_once(rows, f"_run{w}_{i}", joined(last, spans[part], at))
            at, last = at + part, f"_run{w}_{i}"
        rows = rows.withColumn(f"{name}{w}", F.col(last))
    return rows.select(*own, *[f"{name}{w}" for w in widths])


def _windows(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    """(keep, pos, width, window) for each run of ``width`` tokens, from the array ``codes``."""
    hashed = with_run_hashes(rows.select(*dict.fromkeys([*keep, "codes"])), [width])
    return hashed.select(*keep, F.posexplode(f"runs{width}").alias("pos", "window")).withColumn("width", F.lit(width))


def _coded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, form, text, codes): form 0 is the text as it is, form 1 without its single line breaks."""
    text = F.col(text_col)
    forms = F.when(text.rlike(WRAPPED), F.array(text, _unwrapped(text))).otherwise(F.array(text))
    rows = df.where(text.isNotNull()).select(row_key(id_col, text_col).alias("key"), F.posexplode(forms).alias("form", "text"))
    kinds = rows.select("key", "form", "text", template_kinds(F.col("text")).alias("kinds"))
    return kinds.select("key", "form", "text", F.transform("kinds", lambda t: F.xxhash64(t)).alias("codes"))


def _literal_pairs(docs, benchmark, id_col, text_col, item_col, item_text_col, width, min_coverage, broadcast_windows) -> DataFrame | None:
    """(key, item_key, windows, asked) of the items that documents hold word for word; None without items."""

    def coded(df: DataFrame, ident: str, text: str, name: str) -> DataFrame:
        rows = df.where(F.col(text).isNotNull()).select(row_key(ident, text).alias(name), literal_tokens(F.col(text)).alias("words"))
        return compute_once(rows, "codes", F.transform("words", lambda t: F.xxhash64(t))).drop("words")

    items = materialise(coded(benchmark, item_col, item_text_col, "item_key").where(F.size("codes") > 0).dropDuplicates(["item_key"]), "words")
    size = F.least(F.size("codes"), F.lit(width))
    widths = sorted(r[0] for r in items.select(size).distinct().collect())  # at most ``width`` values
    if not widths:
        return None
    parts = [_windows(items.where(size == w), w, "item_key").select("item_key", F.col("pos").alias("q"), "window") for w in widths]
    mine = parts[0]
    for part in parts[1:]:
        mine = mine.unionByName(part)
    small = mine.count() <= broadcast_windows
    hashed = with_run_hashes(coded(docs, id_col, text_col, "key"), widths)
    runs = F.array_distinct(F.concat(*[f"runs{w}" for w in widths]))
    hits = hashed.select("key", F.explode(runs).alias("window")).join(F.broadcast(mine) if small else mine, "window")
    found = hits.groupBy("key", "item_key").agg(F.count_distinct("q").alias("windows"))
    asked = mine.groupBy("item_key").agg(F.count("*").alias("asked"))
    found = found.join(F.broadcast(asked) if small else asked, "item_key")
    return found.where(F.col("windows") >= min_coverage * F.col("asked"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(id, item, windows, coverage, slots, changed_slots): each document with each item it holds.

    ``changed_slots`` counts item values that the document replaces.  Options: see :func:`keyed_matches`.
    """
    return keyed_matches(docs, benchmark, **options).drop("key")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    bad = keyed_matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("key").distinct()
    return unpacked(packed(docs, key=row_key(id_col, text_col)).join(bad, "key", "left_anti"), docs.columns)


def keyed_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", width: int = 8, least: int = 5, min_coverage: float = 0.5, min_consistency: float = 0.8,
    broadcast_windows: int = 200_000,
) -> DataFrame:
    """(key, id, item, windows, coverage, slots, changed_slots), ``key`` being the row key of the document.

    The benchmark's windows are broadcast up to ``broadcast_windows`` of them (some 40 bytes each); more
    are joined by a shuffle.
    """
    items = _coded(benchmark, item_col, item_text_col).where(F.size("codes") >= least).dropDuplicates(["key", "form"])
    items = items.select(F.col("key").alias("item_key"), F.col("form").alias("item_form"), template_tokens(F.col("text")).alias("tokens"), "codes")
    items = materialise(items, "items")
    widths = [r[0] for r in items.select(F.least(F.size("tokens"), F.lit(width))).distinct().collect()]  # at most ``width`` values
    coded = _coded(docs, id_col, text_col)
    literal = F.size(F.filter(F.slice("tokens", F.col("pos") + 1, F.col("width")), lambda t: F.substring(t, 1, 1) != "<"))
    hits, asked = None, None
    for w in sorted(widths):
        own = items.where(F.least(F.size("tokens"), F.lit(width)) == w)
        mine = _windows(own, w, "item_key", "item_form", "tokens", "codes").where(literal * 2 >= w).select("item_key", "item_form", F.col("pos").alias("q"), "window")
        small = mine.count() <= broadcast_windows
        found = _windows(coded, w, "key", "form").select("key", "form", "pos", "window").join(F.broadcast(mine) if small else mine, "window")
        found = found.select("key", "form", "item_key", "item_form", "pos", "q", F.lit(w).alias("width"))
        asked = mine if asked is None else asked.unionByName(mine)
        hits = found if hits is None else hits.unionByName(found)
    words = _literal_pairs(docs, benchmark, id_col, text_col, item_col, item_text_col, width, min_coverage, broadcast_windows)
    if words is None:  # then there are no templates either
        ids = (docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
        return docs.sparkSession.createDataFrame([], f"key binary, id {ids[0]}, item {ids[1]}, windows bigint, coverage double, slots int, changed_slots int")
    none = F.array().cast("array<struct<pos:int,q:int>>")
    pairs = words.withColumns({"form": F.lit(LITERAL), "item_form": F.lit(0), "width": F.lit(width), "at": none})
    if hits is not None:
        sizes = asked.groupBy("item_key", "item_form").agg(F.count("*").alias("asked"))
        found = hits.groupBy("key", "form", "item_key", "item_form").agg(
            F.count_distinct("q").alias("windows"), F.first("width").alias("width"), F.collect_set(F.struct("pos", "q")).alias("at")
        )
        found = found.join(F.broadcast(sizes) if benchmark.count() <= broadcast_windows else sizes, ["item_key", "item_form"])
        pairs = pairs.unionByName(found)
    pairs = pairs.withColumn("coverage", F.col("windows") / F.col("asked")).where(F.col("coverage") >= min_coverage)
    return _consistent(pairs, docs, benchmark, items, id_col, text_col, item_col, item_text_col, min_coverage, min_consistency)


def _slots_of(hit: Column) -> Column:
    """(value of the item, value of the document) of each slot in a matched window."""
    values = F.transform(
        F.sequence(F.lit(0), F.col("width") - 1),
        lambda j: F.struct(F.get("asked_tokens", hit["q"] + j).alias("asked"), F.get("tokens", hit["pos"] + j).alias("found")),
    )
    return F.filter(values, lambda v: F.substring(v["asked"], 1, 1) == "<")


def _compared(rows: DataFrame, min_consistency: float) -> DataFrame:
    """``slots``, ``changed_slots`` and ``steady`` from the distinct ``slot_pairs``.

    A slot with two values in the document is inconsistent, and all its values count against the pair.
    """
    asked = F.transform("slot_pairs", lambda v: v["asked"])
    slots = F.size(F.array_distinct(asked))
    changed = F.size(F.filter("slot_pairs", lambda v: v["asked"] != v["found"]))
    # distinct pairs in the order of what was asked: a slot with one value has other neighbours
    order = F.array_sort(asked)
    single = F.size(F.filter(order, lambda a, i: ~a.eqNullSafe(F.get(order, i - 1)) & ~a.eqNullSafe(F.get(order, i + 1))))
    steady = single >= min_consistency * F.size("slot_pairs")
    return rows.withColumns({"slots": slots, "changed_slots": changed, "steady": steady})


def _single_occurrences(rows: DataFrame, min_coverage: float, min_consistency: float) -> DataFrame:
    """The best occurrence of each pair that is covered and consistent by itself.

    Hits are dealt to overlapping stretches of four item lengths, so the work grows with the length of a
    document and not with its square.
    """
    pair = ["key", "form", "id", "item", "item_form", "asked", "length"]
    hits = rows.select(*pair, F.explode("hits").alias("hit"))
    stretch = F.floor(F.col("hit.pos") / (F.col("length") * 2))
    hits = hits.withColumn("stretch", F.explode(F.array(stretch, stretch - 1)))
    # repeated rows of a document give the same hits
    near = hits.groupBy(*pair, "stretch").agg(F.collect_set("hit").alias("hits"), F.count_distinct("hit.q").alias("most"))
    near = near.where(F.col("most") >= min_coverage * F.col("asked"))
    near = near.withColumn("shift", F.explode(F.array_distinct(F.transform("hits", lambda h: h["shift"]))))
    close = F.filter("hits", lambda h: F.abs(h["shift"] - F.col("shift")) <= F.col("length"))
    order = F.transform(close, lambda h: F.struct(h["q"].alias("q"), F.abs(h["shift"] - F.col("shift")).alias("far"), h["shift"].alias("shift"), h["slots"].alias("slots")))
    near = compute_once(near, "order", F.array_sort(order))
    # of each window of the item, the hit nearest to this alignment
    filled = F.filter("order", lambda h, i: (i == 0) | (h["q"] != F.get("order", i - 1)["q"]))
    exact = F.filter("order", lambda h: h["far"] == 0)
    near = near.select(*pair, F.explode(F.array(exact, filled)).alias("hits"))
    near = near.withColumns({"windows": F.size("hits").cast("bigint"), "coverage": F.size("hits") / F.col("asked")})
    near = near.where(F.col("coverage") >= min_coverage)
    near = compute_once(near, "slot_pairs", F.array_distinct(F.flatten(F.transform("hits", lambda h: h["slots"]))))
    near = _compared(near, min_consistency).where("steady")
    best = F.max(F.struct("windows", "slots", (-F.col("changed_slots")).alias("same"), "coverage"))
    near = near.groupBy("key", "id", "item").agg(best.alias("b"))
    return near.select("key", "id", "item", "b.windows", "b.coverage", "b.slots", (-F.col("b.same")).alias("changed_slots"))


def _consistent(pairs, docs, benchmark, items, id_col, text_col, item_col, item_text_col, min_coverage, min_consistency) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    names = benchmark.select(F.col(item_col).alias("item"), row_key(item_col, item_text_col).alias("item_key")).distinct()
    both = pairs.join(texts, "key").join(names, "item_key")
    both = both.join(items.select("item_key", "item_form", F.col("tokens").alias("asked_tokens")), ["item_key", "item_form"], "left")
    both = both.withColumn("raw", F.when(F.col("form") == 1, _unwrapped(F.col("text"))).when(F.col("form") == 0, F.col("text"))).drop("text")
    both = compute_once(both, "tokens", template_tokens(F.col("raw")))
    both = compute_once(both, "slot_pairs", F.array_distinct(F.flatten(F.transform("at", _slots_of))))
    hits = F.transform("at", lambda h: F.struct((h["pos"] - h["q"]).alias("shift"), h["pos"].alias("pos"), h["q"].alias("q"), _slots_of(h).alias("slots")))
    both = _compared(both, min_consistency).withColumn("hits", F.when(~F.col("steady"), hits))
    own = ["key", "id", "item", "windows", "coverage", "slots", "changed_slots"]
    rest = ["form", "item_form", "steady", "hits", "asked", F.size("asked_tokens").alias("length")]
    both = materialise(both.select(*own, *rest), "compared")
    # the texts as they are come first, then other forms, single occurrences, copies word for word
    rank = F.when(F.col("form") == LITERAL, 4).otherwise(F.col("form") + F.col("item_form"))
    single = _single_occurrences(both.where("NOT steady"), min_coverage, min_consistency).withColumn("rank", F.lit(3))
    found = both.where("steady").select(*own, rank.alias("rank")).unionByName(single)
    best = F.min(F.struct("rank", (-F.col("windows")).alias("less"), "changed_slots", "slots", "windows", "coverage"))
    found = found.groupBy("key", "id", "item").agg(best.alias("b"))
    return found.select("key", "id", "item", *[F.col(f"b.{c}") for c in own[3:]])
