"""Encode words with a WordPiece vocabulary, build model inputs, decode ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.functions.arrays import pad_to
from corpusflow.functions.tokens import slices, uncased_words, words
from corpusflow.operators.lookup import counted_join, lookup_join
from corpusflow.operators.vocab import CONTINUATION, SPECIAL_TOKENS, special_ids
from corpusflow.session import materialise

# Longer words become the unknown token; model inputs are cut to this many tokens.
MAX_WORD_CHARS = 100
MAX_LEN = 128
UNKNOWN = "[UNK]"
# vocabularies up to this many tokens go to the executors as a broadcast dictionary
BROADCAST_TOKENS = 500_000
# distinct words a task remembers before it starts over
_MEMORY_WORDS = 200_000
# words that a task encodes, and ids that it decodes, at a time
_SLICE_WORDS = 100_000
_SLICE_IDS = 500_000
# A continued token that starts like this is written without a space before it.
_NO_SPACE_BEFORE = (".", "?", "!", ",", "n't", "'m", "'s", "'ve", "'re")


def _tokens_by_id(vocab: DataFrame, limit: int) -> dict[int, str] | None:
    """Tokens by id, or ``None`` when there are more than ``limit``.  Ids may have gaps."""
    rows = vocab.select("token_id", "token").limit(limit + 1).collect()
    return None if len(rows) > limit else {row["token_id"]: row["token"] for row in rows}


def word_pieces(word: str, ids: dict[str, int], unknown: int, max_chars: int = MAX_WORD_CHARS) -> list[int]:
    """Longest match first; one unknown id for a word that cannot be spelled."""
    if len(word) > max_chars:
        return [unknown]
    out: list[int] = []
    start = 0
    while start < len(word):
        mark = CONTINUATION if start else ""
        for end in range(len(word), start, -1):
            token_id = ids.get(mark + word[start:end])
            if token_id is not None:
                break
        else:
            return [unknown]
        out.append(token_id)
        start = end
    return out


def _arrow_encoder(ids, unknown: str, max_chars: int):
    """Arrow function ``array<string> -> array<int>``.

    A slice of a batch is reduced to its distinct words with Arrow's dictionary encoding; Python touches each
    distinct word once per task, until its memory of words is full.  Everything per token is vectorised.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ids.value
        unknown_id = table[unknown]
        memory: dict[str, bytes] = {}

        def encoded(part: pa.Array) -> pa.Array:
            coded = pc.dictionary_encode(part.flatten())
            if len(memory) > _MEMORY_WORDS:
                memory.clear()
            pieces = []
            for word in coded.dictionary.to_pylist():
                known = memory.get(word)
                if known is None:
                    known = memory[word] = np.array(word_pieces(word, table, unknown_id, max_chars), np.int32).tobytes()
                pieces.append(known)
            ends = np.cumsum([0, *map(len, pieces)]) // 4
            per_word = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(pieces), np.int32)))
            per_word = per_word.take(coded.indices)
            token_ends = np.concatenate([[0], np.cumsum(pc.list_value_length(per_word).to_numpy(zero_copy_only=False))])
            word_counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            word_ends = np.concatenate([[0], np.cumsum(word_counts)])
            return pa.ListArray.from_arrays(pa.array(token_ends[word_ends], pa.int32()), per_word.flatten())

        for batch in batches:
            for part in slices(batch, _SLICE_WORDS):
                yield encoded(part)

    return encode


def encode_words_by_join(distinct_words: DataFrame, vocab: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """``(word, ids)`` for a table of distinct words, with the vocabulary as a joined table.

    Every substring of a word (at most 100 characters) is looked up in the vocabulary; the matches
    of a word are walked from its start, longest first.
    """
    context = distinct_words.sparkSession.sparkContext
    size = F.length("word")
    # words are few bytes each but unfold into many substrings: spread them over all cores first
    short = distinct_words.where(size <= MAX_WORD_CHARS).repartition(context.defaultParallelism, "word")
    spans = short.select("word", F.explode(F.sequence(F.lit(1), size)).alias("start")).select(
        "word", "start", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("start") + 1)).alias("len")
    )
    part = F.substr(F.col("word"), F.col("start"), F.col("len"))
    spans = spans.withColumn("token", F.when(F.col("start") > 1, F.concat(F.lit(CONTINUATION), part)).otherwise(part))
    matches = lookup_join(spans, vocab.select("token", "token_id"), "token", "inner", BROADCAST_TOKENS)
    # at most 100 * 101 / 2 entries per word; sorted by start, then longest first
    step = F.struct("start", (-F.col("len")).alias("shorter"), "token_id")
    paths = matches.groupBy("word").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("ids"))
    walk = F.aggregate(
        "steps",
        begin,
        lambda acc, s: F.when(
            s["start"] == acc["at"],
            F.struct((acc["at"] - s["shorter"]).alias("at"), F.concat(acc["ids"], F.array(s["token_id"])).alias("ids")),
        ).otherwise(acc),
        lambda acc: F.when(acc["at"] == F.length("word") + 1, acc["ids"]),
    )
    unknown_id = vocab.where(F.col("token") == unknown).select("token_id").first()["token_id"]
    found = distinct_words.join(paths.select("word", walk.alias("ids")), "word", "left")
    return found.select("word", F.coalesce("ids", F.array(F.lit(unknown_id))).alias("ids"))


def cased_words(column: str) -> Column:
    return words(column, special_tokens=SPECIAL_TOKENS)


def _encode_by_join(
    df: DataFrame, vocab: DataFrame, column: str, out: str, id_col: str, unknown: str, split: Callable[[str], Column]
) -> DataFrame:
    """Encoding when the vocabulary is too large for a broadcast.

    Words are counted first; the most frequent meet their ids in a broadcast, all others in a shuffle join.
    """
    listed = materialise(df.select(id_col, F.posexplode(split(column)).alias("_at", "word")), "words")
    counts = materialise(listed.groupBy("word").agg(F.count(F.lit(1)).alias("_n")), "counts")
    coded = materialise(counts.join(encode_words_by_join(counts.select("word"), vocab, unknown), "word"), "coded")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts = counted_join(listed, coded, "word", "_n", total).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("_at", "ids"))).alias("_parts")
    )
    ids = F.flatten(F.transform("_parts", lambda p: p["ids"]))
    joined = df.join(parts.select(id_col, ids.alias(out)), id_col, "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<int>")))


def encode(
    df: DataFrame,
    vocab: DataFrame,
    columns: Sequence[tuple[str, str]] = (("text", "tokens"),),
    unknown: str = UNKNOWN,
    id_col: str = "doc_id",
    max_broadcast: int = BROADCAST_TOKENS,
    split: Callable[[str], Column] = cased_words,
) -> DataFrame:
    """Add the token ids of each ``(text column, output column)`` pair, unpadded and uncut.

    ``split`` finds the words of a column.  Within ``max_broadcast`` tokens this is a narrow step: words are
    found in the JVM, encoded per Arrow batch, nothing is shuffled.  A larger vocabulary is joined as a table.
    """
    tokens = _tokens_by_id(vocab, max_broadcast)
    if tokens is None:
        for source, out in columns:
            df = _encode_by_join(df, vocab, source, out, id_col, unknown, split)
        return df
    ids = df.sparkSession.sparkContext.broadcast({token: i for i, token in tokens.items()})
    to_ids = _arrow_encoder(ids, unknown, MAX_WORD_CHARS)
    for source, out in columns:
        df = df.withColumn(out, to_ids(F.coalesce(split(source), F.array().cast("array<string>"))))
    return df


def uncased_vocabulary_words(column: str) -> Column:
    """The words that an uncased vocabulary encodes."""
    return uncased_words(column, SPECIAL_TOKENS)


def encode_uncased(df: DataFrame, vocab: DataFrame, columns: Sequence[tuple[str, str]] = (("text", "tokens"),), **options) -> DataFrame:
    """:func:`encode` of lower-case text without accents, with one token a punctuation mark and an ideograph."""
    return encode(df, vocab, columns, split=uncased_vocabulary_words, **options)


def _special(special_tokens: Sequence[str] | Mapping[str, int], name: str) -> int:
    """The id of a special token: what a mapping says, or its place in a sequence."""
    return special_tokens[name] if isinstance(special_tokens, Mapping) else list(special_tokens).index(name)


def single_input(
    tokens: Column | str, max_len: int = MAX_LEN, special_tokens: Sequence[str] | Mapping[str, int] = SPECIAL_TOKENS
) -> Column:
    """``[CLS] a [SEP]``, cut to ``max_len``."""
    ids = F.col(tokens) if isinstance(tokens, str) else tokens
    cls, sep = F.lit(_special(special_tokens, "[CLS]")), F.lit(_special(special_tokens, "[SEP]"))
    return F.concat(F.array(cls), F.slice(ids, 1, max_len - 2), F.array(sep))


def pair_lengths(la: Column, lb: Column, budget: int) -> tuple[Column, Column]:
    """How many tokens of either side stay when the pair must fit into ``budget``.

    A side of at most half the budget is kept whole and the other gets the rest; two long sides
    share it, the odd token going to the longer first side.
    """
    half = budget // 2
    keep_a = (
        F.when(la + lb <= budget, la)
        .when(la <= half, la)
        .when(lb <= half, F.lit(budget) - lb)
        .when(la > lb, F.lit(budget - half))
        .otherwise(F.lit(half))
    )
    keep_b = F.when(la + lb <= budget, lb).otherwise(F.lit(budget) - keep_a)
    return keep_a.cast("int"), keep_b.cast("int")


def pair_input(
    a: Column | str, b: Column | str, max_len: int = MAX_LEN, special_tokens: Sequence[str] | Mapping[str, int] = SPECIAL_TOKENS
) -> tuple[Column, Column]:
    """``[CLS] a [SEP] b [SEP]`` cut longest side first, and its 0/1 segment ids."""
    left = F.col(a) if isinstance(a, str) else a
    right = F.col(b) if isinstance(b, str) else b
    cls, sep = F.lit(_special(special_tokens, "[CLS]")), F.lit(_special(special_tokens, "[SEP]"))
    keep_a, keep_b = pair_lengths(F.size(left), F.size(right), max_len - 3)
    ids = F.concat(F.array(cls), F.slice(left, F.lit(1), keep_a), F.array(sep), F.slice(right, F.lit(1), keep_b), F.array(sep))
    types = F.concat(F.array_repeat(F.lit(0), keep_a + 2), F.array_repeat(F.lit(1), keep_b + 1))
    return ids, types


def model_input(
    df: DataFrame,
    tokens: str,
    tokens_b: str | None = None,
    max_len: int = MAX_LEN,
    pad: bool = True,
    special_tokens: Sequence[str] | Mapping[str, int] = SPECIAL_TOKENS,
) -> DataFrame:
    """Add ``input_ids`` and ``token_type_ids``; ``pad`` extends both to ``max_len``.

    ``special_tokens`` as :func:`corpusflow.operators.vocab.special_ids` finds them in a vocabulary, or in the
    order of ids 0, 1, ...
    """
    if tokens_b is None:
        ids = single_input(tokens, max_len, special_tokens)
        df = df.withColumn("input_ids", ids)
        df = df.withColumn("token_type_ids", F.transform("input_ids", lambda _: F.lit(0)))
    else:
        ids, types = pair_input(tokens, tokens_b, max_len, special_tokens)
        df = df.withColumns({"input_ids": ids, "token_type_ids": types})
    if pad:
        fill = _special(special_tokens, "[PAD]")
        df = df.withColumns(
            {"input_ids": pad_to("input_ids", max_len, fill), "token_type_ids": pad_to("token_type_ids", max_len, 0)}
        )
    return df


def _arrow_decoder(tokens):
    @F.arrow_udf("string")
    def render(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = np.asarray(sorted(tokens.value), np.int64)
        plain = [tokens.value[i] for i in ids.tolist()]
        joined = []
        for token in plain:
            if token.startswith(CONTINUATION):
                joined.append(token[len(CONTINUATION):])
            else:
                joined.append(token if token.startswith(_NO_SPACE_BEFORE) else " " + token)
        # the second half holds the form a token takes at the start of a text
        forms = pa.array(joined + list(plain), pa.string())
        def rendered(part: pa.Array) -> pa.Array:
            lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            found = pc.fill_null(part.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(ids, found)
            # ids that the vocabulary does not have are left out before a text's first token is known
            held = ids[np.minimum(at, len(ids) - 1)] == found if len(ids) else np.zeros(len(found), bool)
            rows = np.repeat(np.arange(len(lengths)), lengths)[held]
            lengths = np.bincount(rows, minlength=len(lengths))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            index = at[held]
            index[offsets[:-1][lengths > 0]] += len(plain)
            parts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), forms.take(pa.array(index, pa.int64())))
            return pc.binary_join(parts, "")

        for batch in batches:
            for part in slices(batch, _SLICE_IDS):
                yield rendered(part)

    return render


def decode(
    df: DataFrame,
    vocab: DataFrame,
    column: str = "input_ids",
    out: str = "decoded",
    special_tokens: Sequence[str] = SPECIAL_TOKENS,
    max_broadcast: int = BROADCAST_TOKENS,
    id_col: str = "doc_id",
) -> DataFrame:
    """Ids back to text: special tokens dropped, continuations glued, spaces tidied.

    The ids of the special tokens are looked up in the vocabulary, which may have gaps.  Ids that are NULL or not
    in the vocabulary are dropped too; a NULL list gives an empty text.
    """
    kept = F.filter(column, lambda i: ~i.isin(list(special_ids(vocab, special_tokens).values())))
    tokens = _tokens_by_id(vocab, max_broadcast)
    if tokens is not None:
        return df.withColumn(out, _arrow_decoder(df.sparkSession.sparkContext.broadcast(tokens))(kept))
    # too many tokens to ship: look each id up in the vocabulary table
    listed = materialise(df.select(id_col, F.posexplode(kept).alias("_at", "token_id")).where("token_id IS NOT NULL"), "ids")
    counts = listed.groupBy("token_id").agg(F.count(F.lit(1)).alias("_n"))
    named = counted_join(listed, materialise(vocab.join(counts, "token_id"), "tokens"), "token_id", "_n", listed.count())
    # the first id that the vocabulary holds begins the text
    begins = named.groupBy(id_col).agg(F.min("_at").alias("_begin"))
    named = named.join(begins, id_col)
    glued = F.when(F.col("token").startswith(CONTINUATION), F.substr(F.col("token"), F.lit(len(CONTINUATION) + 1)))
    tight = F.lit(False)
    for start in _NO_SPACE_BEFORE:
        tight = tight | F.col("token").startswith(start)
    form = (
        F.when(F.col("_at") == F.col("_begin"), F.col("token"))
        .otherwise(F.coalesce(glued, F.when(tight, F.col("token")).otherwise(F.concat(F.lit(" "), "token"))))
    )
    texts = named.groupBy(id_col).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", form.alias("f")))), lambda p: p["f"]), "").alias(out)
    )
    return df.join(texts, id_col, "left").withColumn(out, F.coalesce(out, F.lit("")))
