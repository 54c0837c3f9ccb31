"""Sources, cleaning, filters, labels, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.catalog.base import CORPUS, clean_sql, corpus, cut_sql, query, strip_sql, table
from corpusflow.functions import text as tx
from corpusflow.operators import corpus as co, dedup, labels
from corpusflow.plans.corpus import prepare_corpus, prepare_neural_news
from corpusflow.session import scratch_path
from corpusflow.sources import readers, writers

# Real texts with every second sentence gap turned into an entity and every comma gap into NBSP.
_MESSY = "replace(replace(text, '. ', '.&nbsp; '), ', ', ',' || chr(160))"
_DATELINE = "CASE WHEN lang = 'en' THEN 'CITY (Agency) - ' || text ELSE text END"
# neural news: `neural` and `real` rows, some without a body
_NEWS_BODY = "CASE WHEN n_chars % 19 = 0 THEN NULL ELSE text END"
_NEWS_LABEL = "CASE WHEN doc_id % 10 = 8 THEN 'neural' ELSE 'real' END"


@query(
    "corpus_summary",
    f"""WITH {CORPUS}, cleaned AS (
      SELECT source, doc_id, {clean_sql('text')} AS text FROM corpus WHERE lang = 'en'),
    firsts AS (SELECT source, text, min(doc_id) AS doc_id FROM cleaned GROUP BY source, text)
    SELECT source, count(*) AS n_docs, sum(length(text))::BIGINT AS total_length
    FROM firsts WHERE length(text) BETWEEN 750 AND 5000 GROUP BY source""",
)
def corpus_summary(spark, sf):
    rows = co.clean_column(co.keep_language(corpus(spark, sf)))
    rows = co.keep_lengths(co.add_length(rows))
    return co.corpus_summary(dedup.drop_duplicate_texts(rows, ("source",)))


@query(
    "clean_text",
    f"""SELECT doc_id, md5(c) AS digest, length(c)::INTEGER AS length
    FROM (SELECT doc_id, {clean_sql(_MESSY)} AS c FROM documents)""",
)
def clean_text(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_MESSY).alias("text"))
    return co.add_length(co.clean_column(rows)).select("doc_id", F.md5("text").alias("digest"), "length")


@query(
    "collapse_whitespace",
    """SELECT page_id, md5(regexp_replace(html, '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g')) AS digest FROM pages""",
)
def collapse_whitespace(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.collapse_whitespace("html")).alias("digest"))


@query("strip_text", f"SELECT page_id, md5({strip_sql('html')}) AS digest FROM pages")
def strip_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.strip("html")).alias("digest"))


@query(
    "delete_prefix",
    f"SELECT doc_id, md5({cut_sql('t')}) AS digest FROM (SELECT doc_id, {_DATELINE} AS t FROM documents)",
)
def delete_prefix(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_DATELINE).alias("text"))
    return rows.select("doc_id", F.md5(tx.delete_prefix("text")).alias("digest"))


@query(
    "delete_short_prefix",
    f"""SELECT doc_id, md5({strip_sql("CASE WHEN instr(t, '-') BETWEEN 1 AND 41 THEN substr(t, instr(t, '-') + 1) ELSE t END")}) AS digest
    FROM (SELECT doc_id, {_DATELINE} AS t FROM documents)""",
)
def delete_short_prefix(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_DATELINE).alias("text"))
    return rows.select("doc_id", F.md5(tx.delete_prefix("text", max_prefix_chars=40)).alias("digest"))


@query(
    "true_source_text",
    f"""SELECT doc_id, md5({clean_sql(cut_sql('t'))}) AS digest
    FROM (SELECT doc_id, {_DATELINE} AS t FROM documents)""",
)
def true_source_text(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_DATELINE).alias("text"))
    return co.cut_dateline(rows).select("doc_id", F.md5("text").alias("digest"))


@query(
    "language_filter",
    f"SELECT doc_id, n_chars FROM (SELECT *, {_NEWS_BODY} AS body FROM documents) WHERE body IS NOT NULL AND lang = 'en'",
)
def language_filter(spark, sf):
    rows = table(spark, sf, "documents").withColumn("body", F.expr(_NEWS_BODY))
    return co.keep_language(rows, "en", "lang", body="body").select("doc_id", "n_chars")


@query(
    "class_subset",
    f"WITH {CORPUS} SELECT doc_id, length(text)::INTEGER AS length FROM corpus WHERE source = 'fake'",
)
def class_subset(spark, sf):
    return co.add_length(co.keep_class(corpus(spark, sf), "fake")).select("doc_id", "length")


@query("tag_source", "SELECT 'benchmark' AS source, count(*) AS n_rows, sum(length(text))::BIGINT AS total FROM benchmark")
def tag_source(spark, sf):
    rows = co.add_length(co.tag_source(table(spark, sf, "benchmark"), "benchmark"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("length").alias("total"))


@query("text_length", "SELECT doc_id, length(text)::INTEGER AS length FROM documents")
def text_length(spark, sf):
    return co.add_length(table(spark, sf, "documents")).select("doc_id", "length")


@query("length_filter", "SELECT doc_id, length(text)::INTEGER AS length FROM documents WHERE length(text) BETWEEN 750 AND 5000")
def length_filter(spark, sf):
    return co.keep_lengths(co.add_length(table(spark, sf, "documents"))).select("doc_id", "length")


@query("cast_text", "SELECT vec_id, label::VARCHAR AS label_text FROM embeddings")
def cast_text(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label_text"))


@query(
    "empty_text_report",
    f"""SELECT count(*) FILTER (WHERE t = '') AS dropped, count(*) FILTER (WHERE t <> '') AS kept
    FROM (SELECT coalesce({_NEWS_BODY}, '') AS t FROM documents)""",
)
def empty_text_report(spark, sf):
    return co.count_empty_texts(table(spark, sf, "documents").select(F.expr(_NEWS_BODY).alias("text")))


@query(
    "line_filter",
    f"""SELECT md5(t) AS digest, count(*) AS n_rows FROM (
      SELECT {strip_sql("unnest(string_split('= ' || source || ' =' || chr(10) || text, chr(10)))")} AS t FROM documents)
    WHERE t <> '' AND NOT starts_with(t, '=') GROUP BY md5(t)""",
)
def line_filter(spark, sf):
    """Documents as a line corpus on storage, each under a ``=`` heading, read back line by line."""
    path = scratch_path(spark, "lines")
    heading = F.concat(F.lit("= "), "source", F.lit(" =\n"), "text")
    writers.write_lines(table(spark, sf, "documents").select(heading.alias("text")), path)
    lines = co.corpus_lines(readers.read_lines(spark, path))
    return lines.groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("csv_round_trip", "SELECT doc_id, md5(text) AS digest, lang, source FROM documents")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "corpus_csv")
    writers.write_corpus(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path, "csv")
    back = readers.read_csv(spark, path, "doc_id bigint, text string, lang string, source string")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source")


@query("csv_parallel", "SELECT doc_id, md5(text) AS digest, lang, source FROM documents")
def csv_parallel(spark, sf):
    """Documents written as few large CSV files and read again block by block."""
    path = scratch_path(spark, "corpus_csv")
    writers.write_corpus(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path, "csv")
    back = readers.read_csv_parallel(spark, path, "doc_id bigint, text string, lang string, source string")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source")


@query("csv_ingest", "SELECT md5(text) AS digest, count(*) AS n_rows, count(*) AS n_ids FROM documents GROUP BY md5(text)")
def csv_ingest(spark, sf):
    path = scratch_path(spark, "ingest")
    writers.write_corpus(table(spark, sf, "documents").select("text"), f"{path}/csv", "csv")
    rows = readers.ingest_csv(spark, f"{path}/csv", f"{path}/table", source_no=3)
    return rows.groupBy(F.md5("text").alias("digest")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_ids")
    )


@query("optional_source", "SELECT source, count(*) AS n_rows FROM documents GROUP BY source")
def optional_source(spark, sf):
    nothing = readers.read_optional_csv(spark, None)
    rows = co.concat_sources([table(spark, sf, "documents"), nothing])
    return co.rows_per(rows, "source")


@query(
    "named_split",
    """SELECT conv_id, turn, length(text)::INTEGER AS length FROM conversations WHERE role = 'assistant' AND turn % 4 = 1""",
)
def named_split(spark, sf):
    """Written with split and variant folders; one of them is read back."""
    path = scratch_path(spark, "splits")
    rows = table(spark, sf, "conversations").withColumn("split", F.col("role")).withColumn(
        "variant", F.when(F.col("turn") % 4 == 1, "matched").otherwise("mismatched")
    )
    writers.write_corpus(rows, path, partition_by=("split", "variant"))
    one = readers.read_split(spark, path, "assistant", "matched")
    return one.select("conv_id", "turn", F.length("text").alias("length"))


@query("split_counts", "SELECT role AS split, count(*) AS n_rows FROM conversations GROUP BY role")
def split_counts(spark, sf):
    return co.rows_per(table(spark, sf, "conversations").withColumnRenamed("role", "split"), "split")


@query(
    "split_exists",
    """SELECT s.split, EXISTS (SELECT 1 FROM conversations c WHERE c.role = s.split) AS found
    FROM (VALUES ('user'), ('test')) s(split)""",
)
def split_exists(spark, sf):
    rows = table(spark, sf, "conversations").withColumnRenamed("role", "split")
    found = [(name, readers.has_split(rows, name)) for name in ("user", "test")]
    return spark.createDataFrame(found, "split string, found boolean")


@query(
    "label_map_strict",
    f"""WITH {CORPUS} SELECT doc_id, source,
      CASE source WHEN 'true' THEN 0 WHEN 'fake' THEN 1 ELSE 2 END AS label_id FROM corpus""",
)
def label_map_strict(spark, sf):
    rows = corpus(spark, sf).select("doc_id", "source")
    return labels.add_label_id(rows, labels.label_dim(spark), "source")


@query(
    "label_map_lenient",
    f"""WITH {CORPUS} SELECT doc_id, lang,
      CASE lang WHEN 'en' THEN NULL END::INTEGER AS label_id FROM corpus WHERE lang = 'en'
    UNION ALL SELECT doc_id, source, CASE source WHEN 'true' THEN 0 WHEN 'fake' THEN 1 ELSE 2 END
    FROM corpus WHERE lang <> 'en'""",
)
def label_map_lenient(spark, sf):
    """English rows carry a label the scheme does not know."""
    mixed = F.when(F.col("lang") == "en", F.col("lang")).otherwise(F.col("source")).alias("lang")
    rows = corpus(spark, sf).select("doc_id", mixed)
    return labels.add_label_id(rows, labels.label_dim(spark), "source", "lang", on_unknown="null")


@query(
    "label_names",
    """SELECT doc_id, quality AS prediction, CASE quality WHEN 0 THEN 'human' ELSE 'neural' END AS label FROM labels""",
)
def label_names(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("prediction"))
    return labels.add_label_name(rows, labels.label_dim(spark), "binary")


@query(
    "relabel",
    f"SELECT doc_id, CASE WHEN l = 'real' THEN 'human' ELSE l END AS label FROM (SELECT doc_id, {_NEWS_LABEL} AS l FROM documents)",
)
def relabel(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.expr(_NEWS_LABEL).alias("label"))
    return rows.select("doc_id", labels.normalize_label("label").alias("label"))


@query(
    "alphabetical_labels",
    """SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS label_id FROM documents""",
)
def alphabetical_labels(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return labels.add_label_id(rows, labels.alphabetical_scheme(rows, "lang"), "alphabetical", "lang")


@query(
    "dedup_per_class",
    f"WITH {CORPUS} SELECT source, min(doc_id) AS doc_id, length(text)::INTEGER AS length FROM corpus GROUP BY source, text",
)
def dedup_per_class(spark, sf):
    rows = dedup.drop_duplicate_texts(corpus(spark, sf), ("source",))
    return rows.select("source", "doc_id", F.length("text").alias("length"))


@query("dedup_global", "SELECT min(doc_id) AS doc_id, length(text)::INTEGER AS length FROM documents GROUP BY text")
def dedup_global(spark, sf):
    rows = dedup.drop_duplicate_texts(corpus(spark, sf))
    return rows.select("doc_id", F.length("text").alias("length"))


@query(
    "class_conflicts",
    f"""WITH {CORPUS} SELECT min(doc_id) AS first_doc_id, count(*) AS n_rows, count(DISTINCT source) AS n_classes,
      string_agg(DISTINCT source, ',' ORDER BY source) AS classes
    FROM corpus GROUP BY text HAVING count(DISTINCT source) > 1""",
)
def class_conflicts(spark, sf):
    return dedup.class_conflicts(corpus(spark, sf))


@query(
    "union_sources",
    """SELECT 'documents' AS origin, lang, count(*) AS n_rows FROM documents GROUP BY lang
    UNION ALL SELECT 'benchmark', NULL, count(*) FROM benchmark
    UNION ALL SELECT 'conversations', NULL, count(*) FROM conversations""",
)
def union_sources(spark, sf):
    """Inputs with different columns in one table; what an input lacks is NULL."""
    named = [co.tag_source(table(spark, sf, n), n, "origin") for n in ("documents", "benchmark", "conversations")]
    return co.rows_per(co.concat_sources(named), "origin", "lang")


@query(
    "union_distinct",
    """SELECT min(doc_id) AS doc_id, length(text)::INTEGER AS length FROM (
      SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark
      UNION ALL SELECT 1000000000000 + conv_id * 1000 + turn, text FROM conversations) GROUP BY text""",
)
def union_distinct(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    items = table(spark, sf, "benchmark").select((F.lit(-1) - F.col("item_id")).alias("doc_id"), "text")
    turns = table(spark, sf, "conversations").select(
        (F.lit(1000000000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"
    )
    rows = dedup.union_distinct([docs, items, turns])
    return rows.select("doc_id", F.length("text").alias("length"))


def _news(spark, sf):
    """The neural rows of the corpus in the shape of the news benchmark."""
    return co.keep_class(corpus(spark, sf), "neural").select(
        "doc_id", F.expr(_NEWS_BODY).alias("body"), F.col("lang").alias("language"), F.expr(_NEWS_LABEL).alias("label")
    )


@query(
    "neural_news",
    f"""WITH {CORPUS}, news AS (
      SELECT doc_id, {_NEWS_BODY} AS body, lang, {_NEWS_LABEL} AS l FROM corpus WHERE source = 'neural')
    SELECT doc_id, CASE l WHEN 'neural' THEN 1 ELSE 0 END AS label, md5({clean_sql('body')}) AS digest
    FROM news WHERE body IS NOT NULL AND lang = 'en'""",
)
def neural_news(spark, sf):
    return prepare_neural_news(_news(spark, sf)).select("doc_id", "label", F.md5("text").alias("digest"))


_PREPARED = f"""{CORPUS}, news AS (
      SELECT doc_id, {_NEWS_BODY} AS body, lang, {_NEWS_LABEL} AS l FROM corpus WHERE source = 'neural'),
    everything AS (
      SELECT doc_id, {clean_sql(cut_sql('text'))} AS text, 'true' AS source FROM corpus WHERE source = 'true'
      UNION ALL SELECT doc_id, {clean_sql('text')}, 'fake' FROM corpus WHERE source = 'fake'
      UNION ALL SELECT doc_id, {clean_sql('body')}, CASE l WHEN 'neural' THEN 'neural' ELSE 'true' END
      FROM news WHERE body IS NOT NULL AND lang = 'en')"""


@query(
    "prepare_corpus",
    f"""WITH {_PREPARED}
    SELECT source, min(doc_id) AS doc_id, length(text)::INTEGER AS length, md5(text) AS digest FROM everything
    WHERE length(text) BETWEEN 750 AND 5000 GROUP BY source, text""",
)
def prepare_corpus_query(spark, sf):
    base = corpus(spark, sf).select("doc_id", "text", "source")
    fake, true = (co.keep_class(base, name).drop("source") for name in ("fake", "true"))
    rows = prepare_corpus(fake, true, _news(spark, sf))
    return rows.select("source", "doc_id", "length", F.md5("text").alias("digest"))


@query(
    "prepare_corpus_global",
    f"""WITH {_PREPARED}
    SELECT arg_min(source, doc_id) AS source, min(doc_id) AS doc_id, length(text)::INTEGER AS length FROM everything GROUP BY text""",
)
def prepare_corpus_global(spark, sf):
    base = corpus(spark, sf).select("doc_id", "text", "source")
    fake, true = (co.keep_class(base, name).drop("source") for name in ("fake", "true"))
    rows = prepare_corpus(fake, true, _news(spark, sf), enforce_length=False, dedup_scope="global")
    return rows.select("source", "doc_id", "length")
