"""Words, vocabularies, encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusflow.catalog.base import query, table
from corpusflow.catalog.evaluation import _TURNS, turns
from corpusflow.functions import arrays as ar, tokens as tk
from corpusflow.operators import encode as en, models as mo, vocab as vo, wordpiece as wp
from corpusflow.session import materialise, scratch_path
from corpusflow.sources import stores

N_WORDS = 400

# the word and punctuation classes in RE2 notation
_W = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
_WORDS = rf"[{_W}]+|[^{_W}\s\p{{Z}}\x0b\x85]+"
_COUNTS = f"""counts AS (
      SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORDS}')) AS word FROM documents)
      GROUP BY word)"""
_VOCAB = f"""{_COUNTS}, letters AS (SELECT DISTINCT unnest(regexp_extract_all(word, '.')) AS token FROM counts),
    parts AS (
      SELECT token, min(part) AS part FROM (
        SELECT 1 AS part, token FROM letters UNION ALL SELECT 2, '##' || token FROM letters
        UNION ALL SELECT 3, word FROM (
          SELECT word FROM counts WHERE length(word) > 1 ORDER BY n DESC, word LIMIT {N_WORDS}))
      WHERE token NOT IN ('[PAD]', '[CLS]', '[SEP]', '[MASK]', '[UNK]') GROUP BY token),
    vocab AS (
      SELECT (row_number() OVER (ORDER BY part, token) + 4)::INTEGER AS token_id, token FROM parts
      UNION ALL SELECT i::INTEGER, t FROM (VALUES (0, '[PAD]'), (1, '[CLS]'), (2, '[SEP]'), (3, '[MASK]'), (4, '[UNK]')) s(i, t))"""


def _pieces_sql(texts: str, words: str = f"regexp_extract_all(text, '{_WORDS}')", unknown: int = 4) -> str:
    """CTEs that end in ``ids(id, a_ids)``: every text of ``texts(id, text)`` as token ids."""
    return f"""placed AS (
      SELECT id, unnest(found) AS word, generate_subscripts(found, 1) AS pos
      FROM (SELECT id, {words} AS found FROM {texts})),
    distinct_words AS (SELECT DISTINCT word FROM placed),
    spans AS (
      SELECT word, s, e - s + 1 AS len, CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, e - s + 1) AS token
      FROM (SELECT word, s, unnest(range(s, length(word) + 1)) AS e
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM distinct_words WHERE length(word) <= 100))),
    longest AS (
      SELECT word, s, max(len) AS len, arg_max(token_id, len) AS token_id
      FROM spans JOIN vocab USING (token) GROUP BY word, s),
    walk AS (
      SELECT word, 1::BIGINT AS pos, []::INTEGER[] AS found FROM distinct_words
      UNION ALL SELECT w.word, w.pos + l.len, list_append(w.found, l.token_id)
      FROM walk w JOIN longest l ON l.word = w.word AND l.s = w.pos),
    spelled AS (
      SELECT d.word, coalesce(any_value(w.found), [{unknown}]) AS found FROM distinct_words d
      LEFT JOIN walk w ON w.word = d.word AND w.pos = length(d.word) + 1 AND length(d.word) <= 100 GROUP BY d.word),
    gathered AS (
      SELECT id, flatten(list(found ORDER BY pos)) AS found FROM placed JOIN spelled USING (word) GROUP BY id),
    ids AS (SELECT t.id, coalesce(g.found, []) AS found FROM {texts} t LEFT JOIN gathered g USING (id))"""


def _join_sql(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def vocabulary(spark, sf):
    """Characters and the most frequent words of the documents."""
    counts = materialise(vo.word_counts(table(spark, sf, "documents")), "counts")
    return materialise(vo.word_vocabulary(counts, N_WORDS), "vocabulary")


def joined(column: str):
    return F.concat_ws(" ", F.col(column).cast("array<string>"))


@query("word_counts", f"WITH {_COUNTS} SELECT word, n FROM counts")
def word_counts(spark, sf):
    return vo.word_counts(table(spark, sf, "documents"))


@query(
    "nfkc",
    "SELECT page_id, md5(replace(replace(t, 'ﬁ', 'fi'), '①', '1')) AS digest FROM (SELECT page_id, replace(replace(html, 'fi', 'ﬁ'), '10', '①0') AS t FROM pages)",
)
def nfkc(spark, sf):
    """Pages with a ligature and a circled digit put in."""
    changed = F.replace(F.replace("html", F.lit("fi"), F.lit("ﬁ")), F.lit("10"), F.lit("①0"))
    return table(spark, sf, "pages").select("page_id", F.md5(tk.nfkc(changed)).alias("digest"))


@query(
    "split_words",
    f"""SELECT doc_id, len(f)::INTEGER AS n_words, md5(array_to_string(f, ' ')) AS digest
    FROM (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS f FROM documents)""",
)
def split_words(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tk.words("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("word_vocabulary", f"WITH {_VOCAB} SELECT token_id, token FROM vocab")
def word_vocabulary(spark, sf):
    return vocabulary(spark, sf)


@query("vocabulary_files", f"WITH {_VOCAB} SELECT token_id, token FROM vocab")
def vocabulary_files(spark, sf):
    path = scratch_path(spark, "vocabulary")
    stores.save_vocabulary(vo.word_vocabulary(vo.word_counts(table(spark, sf, "documents")), N_WORDS), path)
    return stores.load_vocabulary(spark, path)


_DOC_TEXTS = "texts AS (SELECT doc_id AS id, text FROM documents)"


@query(
    "encode_words",
    f"""WITH RECURSIVE {_VOCAB}, {_DOC_TEXTS}, {_pieces_sql('texts')}
    SELECT word, {_join_sql('found')} AS ids FROM spelled""",
)
def encode_words(spark, sf):
    """Distinct words against the vocabulary as a joined table."""
    counts = materialise(vo.word_counts(table(spark, sf, "documents")), "counts")
    vocab = materialise(vo.word_vocabulary(counts, N_WORDS), "vocabulary")
    return en.encode_words_by_join(counts.select("word"), vocab).select("word", joined("ids").alias("ids"))


@query(
    "encode_single",
    f"""WITH RECURSIVE {_VOCAB}, {_DOC_TEXTS}, {_pieces_sql('texts')}
    SELECT id AS doc_id, len(found)::INTEGER AS n_tokens, md5({_join_sql('found')}) AS all_tokens,
      {_join_sql("list_resize([1] || found[1:126] || [2], 128, 0)")} AS input_ids FROM ids""",
)
def encode_single(spark, sf):
    rows = en.encode(table(spark, sf, "documents").select("doc_id", "text"), vocabulary(spark, sf))
    rows = en.model_input(rows, "tokens")
    return rows.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(joined("tokens")).alias("all_tokens"),
        joined("input_ids").alias("input_ids"),
    )


@query(
    "encode_pair",
    f"""WITH RECURSIVE {_VOCAB}, {_TURNS}, texts AS (
      SELECT 2 * idx AS id, first_text AS text FROM turns UNION ALL SELECT 2 * idx + 1, second_text FROM turns),
    {_pieces_sql('texts')},
    sides AS (SELECT a.id // 2 AS idx, a.found AS a, b.found AS b, len(a.found) AS la, len(b.found) AS lb
      FROM ids a JOIN ids b ON b.id = a.id + 1 AND a.id % 2 = 0),
    kept AS (SELECT *, CASE WHEN la + lb <= 125 OR la <= 62 THEN la WHEN lb <= 62 THEN 125 - lb
      WHEN la > lb THEN 63 ELSE 62 END AS ka FROM sides),
    both_kept AS (SELECT *, CASE WHEN la + lb <= 125 THEN lb ELSE 125 - ka END AS kb FROM kept)
    SELECT idx, {_join_sql("list_resize([1] || a[1:ka] || [2] || b[1:kb] || [2], 128, 0)")} AS input_ids,
      {_join_sql("list_resize(list_transform(range(ka + 2), lambda x: 0) || list_transform(range(kb + 1), lambda x: 1), 128, 0)")} AS token_type_ids
    FROM both_kept""",
)
def encode_pair(spark, sf):
    columns = (("first_text", "a"), ("second_text", "b"))
    rows = en.encode(turns(spark, sf), vocabulary(spark, sf), columns, id_col="idx")
    rows = en.model_input(rows, "a", "b")
    return rows.select("idx", joined("input_ids").alias("input_ids"), joined("token_type_ids").alias("token_type_ids"))


@query(
    "pad_mask",
    f"""WITH RECURSIVE {_VOCAB}, texts AS (SELECT item_id AS id, text FROM benchmark), {_pieces_sql('texts')}
    SELECT id AS item_id, greatest(128 - 2 - len(found), 0)::BIGINT AS n_padding FROM ids""",
)
def pad_mask(spark, sf):
    items = table(spark, sf, "benchmark")
    rows = en.model_input(en.encode(items, vocabulary(spark, sf), id_col="item_id"), "tokens")
    mask = ar.pad_mask("input_ids")
    return rows.select("item_id", F.size(F.filter(mask, lambda m: m)).cast("bigint").alias("n_padding"))


def _make_token_sums():
    """A stand-in for a sequence model: the sum of the ids and the number of real tokens."""

    def run(ids):
        return np.stack([ids.sum(axis=1), (ids != 0).sum(axis=1)], axis=1)

    return run


@query(
    "dynamic_padding_scores",
    f"""WITH RECURSIVE {_VOCAB}, texts AS (SELECT item_id AS id, text FROM benchmark), {_pieces_sql('texts')}
    SELECT id AS item_id, (list_sum(found[1:126]) + 3)::BIGINT AS id_sum, (len(found[1:126]) + 2)::BIGINT AS n_real FROM ids""",
)
def dynamic_padding_scores(spark, sf):
    """Unpadded inputs, padded batch by batch inside the scorer."""
    items = table(spark, sf, "benchmark")
    rows = en.model_input(en.encode(items, vocabulary(spark, sf), id_col="item_id"), "tokens", pad=False)
    scored = mo.score_tokens(rows, _make_token_sums)
    return scored.select(
        "item_id", *[F.get("logits", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(("id_sum", "n_real"))]
    )


@query(
    "decode",
    f"""WITH RECURSIVE {_VOCAB}, {_DOC_TEXTS}, {_pieces_sql('texts')},
    listed AS (SELECT id, unnest(found) AS token_id, generate_subscripts(found, 1) AS pos FROM ids),
    named AS (SELECT id, pos, token FROM listed JOIN vocab USING (token_id) WHERE token_id > 4)
    SELECT d.doc_id, md5(coalesce(string_agg(
        CASE WHEN first THEN token WHEN starts_with(token, '##') THEN substr(token, 3)
             WHEN regexp_matches(token, '^([.?!,]|n''t|''m|''s|''ve|''re)') THEN token ELSE ' ' || token END, '' ORDER BY pos), '')) AS digest
    FROM documents d LEFT JOIN (SELECT *, pos = min(pos) OVER (PARTITION BY id) AS first FROM named) n ON n.id = d.doc_id
    GROUP BY d.doc_id""",
)
def decode(spark, sf):
    vocab = vocabulary(spark, sf)
    rows = en.encode(table(spark, sf, "documents").select("doc_id", "text"), vocab)
    return en.decode(rows, vocab, "tokens").select("doc_id", F.md5("decoded").alias("digest"))


# tokens beside special tokens and characters, as many as a published uncased vocabulary has
N_UNCASED_WORDS = 30_000
# marks and ideographs alone, everything else in runs
_P = r"!-/:-@\[-`{-~\p{P}"
_IDEOGRAPHS = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in tk.IDEOGRAPHS)
_UNCASED = rf"regexp_extract_all(lower(strip_accents(text)), '[{_P}{_IDEOGRAPHS}]|[^\s\p{{Z}}\x0b\x85{_P}{_IDEOGRAPHS}]+')"
_UNCASED_VOCAB = f"""counts AS (
      SELECT word, count(*) AS n FROM (SELECT unnest({_UNCASED}) AS word FROM documents) GROUP BY word),
    letters AS (SELECT DISTINCT unnest(regexp_extract_all(word, '.')) AS token FROM counts),
    parts AS (
      SELECT token, min(part) AS part FROM (
        SELECT 1 AS part, token FROM letters UNION ALL SELECT 2, '##' || token FROM letters
        UNION ALL SELECT 3, word FROM (
          SELECT word FROM counts WHERE length(word) > 1 ORDER BY n DESC, word LIMIT {N_UNCASED_WORDS})) GROUP BY token),
    vocab AS (
      SELECT (row_number() OVER (ORDER BY part, token) + 103)::INTEGER AS token_id, token FROM parts
      UNION ALL SELECT i::INTEGER, t FROM (VALUES (0, '[PAD]'), (100, '[UNK]'), (101, '[CLS]'), (102, '[SEP]'), (103, '[MASK]')) s(i, t))"""


def uncased_vocabulary(spark, sf):
    """Characters and frequent words of the uncased documents, special tokens at their published ids."""
    counts = vo.word_counts(table(spark, sf, "documents"), split=en.uncased_vocabulary_words)
    return materialise(vo.word_vocabulary(materialise(counts, "counts"), N_UNCASED_WORDS, vo.UNCASED_SPECIAL_IDS), "vocabulary")


@query(
    "uncased_words",
    f"""SELECT doc_id, len(f)::INTEGER AS n_words, md5(array_to_string(f, ' ')) AS digest
    FROM (SELECT doc_id, {_UNCASED} AS f FROM documents)""",
)
def uncased_words(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", tk.uncased_words("text").alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(
    "encode_uncased_single",
    f"""WITH RECURSIVE {_UNCASED_VOCAB}, {_DOC_TEXTS}, {_pieces_sql('texts', _UNCASED, 100)}
    SELECT id AS doc_id, len(found)::INTEGER AS n_tokens, md5({_join_sql('found')}) AS all_tokens,
      {_join_sql("list_resize([101] || found[1:126] || [102], 128, 0)")} AS input_ids FROM ids""",
)
def encode_uncased_single(spark, sf):
    vocab = uncased_vocabulary(spark, sf)
    rows = en.encode_uncased(table(spark, sf, "documents").select("doc_id", "text"), vocab)
    rows = en.model_input(rows, "tokens", special_tokens=vo.special_ids(vocab))
    return rows.select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.md5(joined("tokens")).alias("all_tokens"),
        joined("input_ids").alias("input_ids"),
    )


@query(
    "encode_uncased_pair",
    f"""WITH RECURSIVE {_UNCASED_VOCAB}, {_TURNS}, texts AS (
      SELECT 2 * idx AS id, first_text AS text FROM turns UNION ALL SELECT 2 * idx + 1, second_text FROM turns),
    {_pieces_sql('texts', _UNCASED, 100)},
    sides AS (SELECT a.id // 2 AS idx, a.found AS a, b.found AS b, len(a.found) AS la, len(b.found) AS lb
      FROM ids a JOIN ids b ON b.id = a.id + 1 AND a.id % 2 = 0),
    kept AS (SELECT *, CASE WHEN la + lb <= 125 OR la <= 62 THEN la WHEN lb <= 62 THEN 125 - lb
      WHEN la > lb THEN 63 ELSE 62 END AS ka FROM sides),
    both_kept AS (SELECT *, CASE WHEN la + lb <= 125 THEN lb ELSE 125 - ka END AS kb FROM kept)
    SELECT idx, {_join_sql("list_resize([101] || a[1:ka] || [102] || b[1:kb] || [102], 128, 0)")} AS input_ids,
      {_join_sql("list_resize(list_transform(range(ka + 2), lambda x: 0) || list_transform(range(kb + 1), lambda x: 1), 128, 0)")} AS token_type_ids
    FROM both_kept""",
)
def encode_uncased_pair(spark, sf):
    vocab = uncased_vocabulary(spark, sf)
    rows = en.encode_uncased(turns(spark, sf), vocab, (("first_text", "a"), ("second_text", "b")), id_col="idx")
    rows = en.model_input(rows, "a", "b", special_tokens=vo.special_ids(vocab))
    return rows.select("idx", joined("input_ids").alias("input_ids"), joined("token_type_ids").alias("token_type_ids"))


@query(
    "decode_uncased",
    f"""WITH RECURSIVE {_UNCASED_VOCAB}, {_DOC_TEXTS}, {_pieces_sql('texts', _UNCASED, 100)},
    listed AS (SELECT id, unnest(found) AS token_id, generate_subscripts(found, 1) AS pos FROM ids),
    named AS (SELECT id, pos, token FROM listed JOIN vocab USING (token_id) WHERE token_id NOT IN (0, 100, 101, 102, 103))
    SELECT d.doc_id, md5(coalesce(string_agg(
        CASE WHEN first THEN token WHEN starts_with(token, '##') THEN substr(token, 3)
             WHEN regexp_matches(token, '^([.?!,]|n''t|''m|''s|''ve|''re)') THEN token ELSE ' ' || token END, '' ORDER BY pos), '')) AS digest
    FROM documents d LEFT JOIN (SELECT *, pos = min(pos) OVER (PARTITION BY id) AS first FROM named) n ON n.id = d.doc_id
    GROUP BY d.doc_id""",
)
def decode_uncased(spark, sf):
    vocab = uncased_vocabulary(spark, sf)
    rows = en.encode_uncased(table(spark, sf, "documents").select("doc_id", "text"), vocab)
    return en.decode(rows, vocab, "tokens").select("doc_id", F.md5("decoded").alias("digest"))


@query("train_wordpiece")
def train_wordpiece(spark, sf):
    """A vocabulary of the published size, trained on all words of the documents."""
    return wp.train_wordpiece(materialise(vo.word_counts(table(spark, sf, "documents")), "counts"))


# tokens of the vocabulary trained on the benchmark's items
N_ITEM_TOKENS = 300


def _wrapped(piece: str) -> str:
    return f"chr(1) || {piece} || chr(2)"


@query(
    "train_wordpiece_items",
    f"""WITH RECURSIVE counts AS (
      SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORDS}')) AS word FROM benchmark) GROUP BY word),
    split AS (
      SELECT n, array_to_string(list_transform(regexp_extract_all(word, '.'), lambda c, i: chr(1) || CASE WHEN i > 1 THEN '##' ELSE '' END || c || chr(2)), '') AS w
      FROM counts),
    seen AS (SELECT DISTINCT unnest(string_split(w[2:-2], chr(2) || chr(1))) AS c FROM split),
    plain AS (SELECT DISTINCT CASE WHEN starts_with(c, '##') AND length(c) > 2 THEN substr(c, 3) ELSE c END AS c FROM seen),
    first AS (
      SELECT (row_number() OVER (ORDER BY part, c) + 4)::INTEGER AS token_id, c AS token
      FROM (SELECT 1 AS part, c FROM plain UNION ALL SELECT 2, c FROM seen WHERE c NOT IN (SELECT c FROM plain))),
    rounds AS (
      SELECT (SELECT list({{'w': w, 'n': n}}) FROM split) AS words, (SELECT list(token ORDER BY token_id) FROM first) AS tokens, false AS over
      UNION ALL
      SELECT CASE WHEN b.a IS NULL THEN words ELSE list_transform(words, lambda x: {{
               'w': replace(x.w, {_wrapped('b.a')} || {_wrapped('b.b')}, {_wrapped('b.p')}), 'n': x.n}}) END,
             CASE WHEN b.a IS NULL OR list_contains(tokens, b.p) THEN tokens ELSE list_append(tokens, b.p) END, b.a IS NULL
      FROM rounds, LATERAL (
        SELECT any_value(a) AS a, any_value(b) AS b, any_value(a || CASE WHEN starts_with(b, '##') THEN substr(b, 3) ELSE b END) AS p FROM (
          SELECT a, b FROM (
            SELECT ps[i] AS a, ps[i + 1] AS b, n FROM (
              SELECT ps, n, unnest(range(1, len(ps))) AS i FROM (
                SELECT string_split(x.w[2:-2], chr(2) || chr(1)) AS ps, x.n AS n FROM (SELECT unnest(words) AS x))))
          GROUP BY a, b ORDER BY sum(n) DESC, a, b LIMIT 1)) b
      WHERE NOT over AND len(tokens) < {N_ITEM_TOKENS} - 5),
    last AS (SELECT tokens FROM rounds ORDER BY len(tokens) DESC LIMIT 1)
    SELECT i::INTEGER AS token_id, t AS token FROM (VALUES (0, '[PAD]'), (1, '[CLS]'), (2, '[SEP]'), (3, '[MASK]'), (4, '[UNK]')) s(i, t)
    UNION ALL SELECT (generate_subscripts(tokens, 1) + 4)::INTEGER, unnest(tokens) FROM last""",
)
def train_wordpiece_items(spark, sf):
    """A vocabulary trained on the items of the benchmark."""
    return wp.train_wordpiece(vo.word_counts(table(spark, sf, "benchmark")), N_ITEM_TOKENS)
