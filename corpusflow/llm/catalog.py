"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.llm.common import blocks_for, table
from corpusflow.llm.decontaminate import TEMPLATE_STEPS, contaminated
from corpusflow.llm.fingerprints import BLANK, PIECE, SHORT, SHORT_PIECE, fingerprint_edits
from corpusflow.llm.jaccard_join import jaccard_classes
from corpusflow.llm.lexical_search import search_documents
from corpusflow.llm.licences import scan_licences
from corpusflow.llm.line_dedup import dedup_lines
from corpusflow.llm.nearest import nearest_neighbours
from corpusflow.llm.packing import pack_documents
from corpusflow.llm.pieces import decode_ids, encode_texts, load_model
from corpusflow.llm.sentence_dedup import dedup_passages, dedup_sentences
from corpusflow.llm.source_audit import audit_sources
from corpusflow.llm.token_files import file_number, placed_ids, scan_token_files, write_token_files
from corpusflow.llm.toxicity import score_toxicity
from corpusflow.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def piece_model() -> bytes:
    """The public 32k piece model."""
    import public_tokenizers

    return load_model(public_tokenizers.path("piece_bpe_32k.model"))


@query("op1_packed_rows")
def op1_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into rows of 2,048 ids; the matrices as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pack_documents(docs, piece_model(), shards=blocks_for(docs, "text", 8_000_000))
    return rows.select(
        "shard", "bin", "n_tokens", "cu_seqlens", "doc_ids", "offsets",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )


@query("op4_piece_ids")
def op4_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document with begin and end id, and the text they decode to, as digests."""
    model = piece_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, model, begin=True, end=True).drop("text")
    return decode_ids(encoded, model).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted from flat token files of the whole table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "tokens")
    write_token_files(docs, path, piece_model())
    counts = scan_token_files(spark, path, within="/kind=tokens/").withColumn("number", file_number(F.col("path")))
    # both sides grow with the documents: never a broadcast
    return counts.join(placed_ids(spark, path).hint("merge"), ["number", "doc"]).select(F.col("id").alias("doc_id"), "n_tokens")


LINES_SQL = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {docs} WHERE text IS NOT NULL),
starts AS (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM lines WHERE len(ls) >= 3),
windows AS (
  SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS w FROM starts
  WHERE trim(ls[pos + 1]) <> '' OR trim(ls[pos + 2]) <> '' OR trim(ls[pos + 3]) <> ''),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, pos) AS k FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM ranked WHERE k > 1),
numbered AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM lines),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM numbered ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS INTEGER) AS lines_removed
FROM {docs} d LEFT JOIN kept k USING (doc_id)"""


@query("op8_line_dedup", LINES_SQL.format(docs="documents"))
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the three-line passages that occurred before."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


SENTENCES_SQL = """
WITH cut AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?][ \\t]{1,8})', '\\1' || chr(1), 'g'), '(\\n+)', '\\1' || chr(1), 'g') AS t
  FROM documents WHERE text IS NOT NULL),
sentences AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda x: x <> '') AS ss FROM cut),
starts AS (SELECT doc_id, ss, unnest(range(len(ss) - 1)) AS pos FROM sentences WHERE len(ss) >= 2),
runs AS (
  SELECT doc_id, pos, trim(ss[pos + 1], ' ' || chr(9) || chr(10) || chr(13)) AS a, trim(ss[pos + 2], ' ' || chr(9) || chr(10) || chr(13)) AS b
  FROM starts),
counted AS (
  SELECT doc_id, pos, a || chr(31) || b AS run FROM runs
  WHERE length(a) - length(replace(a, ' ', '')) + length(b) - length(replace(b, ' ', '')) + 2 >= 16),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, pos) AS k FROM counted),
covered AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM ranked WHERE k > 1),
numbered AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM sentences),
kept AS (
  SELECT doc_id, string_agg(s, '' ORDER BY pos) AS text, count(*) AS n
  FROM numbered ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id),
sizes AS (SELECT doc_id, len(ss) AS n FROM sentences)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE z.n - coalesce(k.n, 0) END AS INTEGER) AS sentences_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN sizes z USING (doc_id)"""


@query("op9_sentence_spans", SENTENCES_SQL)
def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of several sentences that occurred before."""
    return dedup_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_passages")
def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occurred before, also those of short sentences and of one sentence."""
    return dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _template_sql(text: str) -> str:
    out = f"translate({text}, '<>', '  ')"
    for pattern, to in TEMPLATE_STEPS:
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), to)
    return f"string_split_regex(trim(lower({out})), ' +')"


TEMPLATES_CTE = f"""
items AS (SELECT DISTINCT item_id, text, {_template_sql("text")} AS tokens FROM benchmark WHERE text IS NOT NULL),
docs AS (SELECT DISTINCT doc_id, text, {_template_sql("text")} AS tokens FROM DOCS_TABLE WHERE text IS NOT NULL),
item_windows AS (
  SELECT item_id, q, tokens[q + 1 : q + 8] AS w
  FROM (SELECT item_id, tokens, unnest(range(len(tokens) - 7)) AS q FROM items WHERE len(tokens) >= 8)
  WHERE len(list_filter(tokens[q + 1 : q + 8], lambda t: substr(t, 1, 1) <> '<')) >= 4),
doc_windows AS (
  SELECT doc_id, pos, tokens[pos + 1 : pos + 8] AS w
  FROM (SELECT doc_id, tokens, unnest(range(len(tokens) - 7)) AS pos FROM docs WHERE len(tokens) >= 8)),
item_keys AS (
  SELECT item_id, q, w, array_to_string(list_transform(w, lambda t: CASE WHEN substr(t, 1, 1) = '<' THEN substr(t, 1, 2) ELSE t END), ' ') AS k
  FROM item_windows),
doc_keys AS (
  SELECT doc_id, pos, w, array_to_string(list_transform(w, lambda t: CASE WHEN substr(t, 1, 1) = '<' THEN substr(t, 1, 2) ELSE t END), ' ') AS k
  FROM doc_windows),
hits AS (SELECT d.doc_id, i.item_id, i.q, d.w AS found, i.w AS asked FROM doc_keys d JOIN item_keys i USING (k)),
sizes AS (SELECT item_id, count(*) AS asked FROM item_keys GROUP BY item_id),
pairs AS (
  SELECT doc_id, item_id, count(DISTINCT q) AS windows, count(DISTINCT q) / any_value(z.asked) AS coverage
  FROM hits JOIN sizes z USING (item_id) GROUP BY doc_id, item_id HAVING count(DISTINCT q) >= 0.5 * any_value(z.asked)),
slot_pairs AS (
  SELECT DISTINCT doc_id, item_id, asked, found
  FROM (SELECT doc_id, item_id, unnest(asked) AS asked, unnest(found) AS found FROM hits) WHERE substr(asked, 1, 1) = '<'),
slot_values AS (
  SELECT doc_id, item_id, asked, count(*) AS n, count(*) FILTER (WHERE asked <> found) AS changed FROM slot_pairs GROUP BY doc_id, item_id, asked),
slots AS (
  SELECT doc_id, item_id, count(*) AS slots, sum(n) AS n, count(*) FILTER (WHERE n = 1) AS steady, sum(changed) AS changed
  FROM slot_values GROUP BY doc_id, item_id),
found AS (
  SELECT p.doc_id, p.item_id, p.windows, p.coverage, CAST(coalesce(s.slots, 0) AS INTEGER) AS slots,
         CAST(coalesce(s.changed, 0) AS INTEGER) AS changed_slots
  FROM pairs p LEFT JOIN slots s USING (doc_id, item_id) WHERE coalesce(s.steady, 0) >= 0.8 * coalesce(s.n, 0))"""


@query("op3_benchmark_templates", f"WITH {TEMPLATES_CTE} SELECT * FROM found".replace("DOCS_TABLE", "documents"))
def op3_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, word for word or with other names and numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


JACCARD_CTE = """
words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM DOCS_TABLE),
runs AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE c.n / (x.n + y.n - c.n) >= 0.8),
reach AS (SELECT doc_id AS a, doc_id AS b FROM DOCS_TABLE UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)"""


@query(
    "op6_jaccard_links",
    f"WITH RECURSIVE {JACCARD_CTE} SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN counts USING (doc_id)".replace(
        "DOCS_TABLE", "documents"
    ),
)
def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links."""
    classes = jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


@query("op7_nearest_vectors")
def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    found = nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op5_licence_paragraphs")
def op5_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that a licence family's notice is in."""
    found = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")


def _tree_sql(text: str) -> str:
    branches = f"list_transform(string_split({text}, chr(10)), lambda p: md5(p) || ':' || length(p))"
    ends = f"CASE WHEN starts_with(b, '0') OR starts_with(b, '{BLANK}') THEN ';' ELSE ',' END"
    return f"regexp_replace(array_to_string(list_transform({branches}, lambda b: b || {ends}), ''), '[,;]$', '')"


def _fingerprint_sql(text: str, tree: str) -> str:
    root = f"sha256(array_to_string(list_transform(string_split({tree}, ';'), lambda s: md5(s)), ''))"
    found = [f"regexp_extract_all({text}, '{pattern}')" for pattern in (SHORT_PIECE, PIECE)]
    found = f"CASE WHEN length({text}) < {SHORT} THEN {found[0]} ELSE {found[1]} END"
    pieces = f"list_sort(list_distinct(list_transform({found}, lambda x: substr(md5(x), 1, 8))))"
    return f"{root} || ':' || array_to_string({pieces}, '')"


def _likeness_sql(a: str, b: str) -> str:
    pieces = [f"regexp_extract_all(substr({x}, 66), '.{{8}}')" for x in (a, b)]
    share = f"2 * len(list_intersect({pieces[0]}, {pieces[1]})) / greatest(len({pieces[0]}) + len({pieces[1]}), 1)"
    return f"CASE WHEN {a}[:64] = {b}[:64] THEN 1.0::DOUBLE ELSE ({share})::DOUBLE END"


FINGERPRINTS_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(doc_id::VARCHAR, 'null') || chr(31) || coalesce(text, '')) AS key FROM documents),
followed AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS other
  FROM rows WINDOW w AS (ORDER BY doc_id NULLS FIRST, key)),
edits AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 4) || substr(other, 1, length(text) // 4) AS edited FROM followed),
trees AS (SELECT *, {_tree_sql("text")} AS t, {_tree_sql("other")} AS o, {_tree_sql("edited")} AS e FROM edits),
prints AS (
  SELECT doc_id, text, edited, {_fingerprint_sql("text", "t")} AS f, {_fingerprint_sql("other", "o")} AS fo, {_fingerprint_sql("edited", "e")} AS fe,
         string_split_regex(t, '[,;]') AS tp, string_split_regex(e, '[,;]') AS ep
  FROM trees),
places AS (
  SELECT *, list_position(list_transform(range(1, greatest(len(tp), len(ep)) + 1), lambda i: tp[i] IS DISTINCT FROM ep[i]), true) AS place FROM prints)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, f AS fingerprint, fe AS edited_fingerprint,
       {_likeness_sql("f", "fe")} AS near_edited, {_likeness_sql("f", "fo")} AS near_next,
       CASE WHEN f <> fe THEN coalesce(list_sum(list_transform(tp[1 : place - 1], lambda b: split_part(b, ':', 2)::BIGINT + 1)), 0)::BIGINT END AS edit_start
FROM places"""


@query("op11_fingerprints", FINGERPRINTS_SQL)
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, how alike they are, and where the edit begins."""
    found = fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_start",
    )


AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
words AS (
  SELECT r, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(found) AS term FROM docs)),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
grp AS (
  SELECT g.lang, g.source, coalesce(any_value(z.v), 0) AS v, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes z ON z.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 1)) // (z.n + z.v))::HUGEINT AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN sizes z ON z.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op12_source_divergence", AUDIT_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source against the others of its language, and the terms it uses more than its language."""
    return audit_sources(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
words AS (
  SELECT r, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT r, unnest(found) AS term FROM docs)),
asked AS (
  SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
stats AS (SELECT count(*) FILTER (WHERE len(found) > 0)::BIGINT AS n, sum(len(found))::BIGINT AS l FROM docs),
measures AS (SELECT r, doc_id, 100 - 90 + ((90 * len(found) * n) // l) AS m FROM docs, stats),
tfs AS (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, stats GROUP BY term),
scores AS (
  SELECT a.item_id, m.doc_id, t.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked a JOIN tfs t USING (term) JOIN weights USING (term) JOIN measures m ON m.r = t.r GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query("op13_ranked_search", SEARCH_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    found = search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
