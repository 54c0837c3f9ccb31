"""Word counts and vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusflow.functions.tokens import terms, words

VOCAB_SIZE = 30_522
# Ids 0 to 4 in this order.
SPECIAL_TOKENS = ("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]")
# Where the vocabularies of published uncased models have them.
UNCASED_SPECIAL_IDS = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[MASK]": 103}
CONTINUATION = "##"


def word_counts(
    df: DataFrame, column: str = "text", normalise: bool = True, split: Callable[[str], Column] | None = None
) -> DataFrame:
    """``(word, n)`` over the whole corpus; counts are combined on the map side.  ``split`` finds the words of a column."""
    found = split(column) if split else words(column, normalise)
    return df.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def top_terms(
    df: DataFrame, max_terms: int = 10_000, column: str = "text", stop_words: Sequence[str] = ()
) -> DataFrame:
    """The most frequent terms with their counts; equal counts are ordered by term."""
    counts = (
        df.select(F.explode(terms(column, list(stop_words))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.desc("n"), "term").limit(max_terms)


def vocabulary_from_tokens(spark: SparkSession, tokens: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(tokens)), "token_id int, token string")


def special_ids(vocab: DataFrame, special_tokens: Sequence[str] = SPECIAL_TOKENS) -> dict[str, int]:
    """The ids that a vocabulary gives the special tokens it has."""
    rows = vocab.where(F.col("token").isin(list(special_tokens))).select("token", "token_id").collect()
    return {row["token"]: row["token_id"] for row in rows}


def word_vocabulary(
    counts: DataFrame, n_words: int, special_tokens: Sequence[str] | Mapping[str, int] = SPECIAL_TOKENS
) -> DataFrame:
    """A vocabulary without training: special tokens, all characters, their ``##`` forms, top words.

    Special tokens have the ids that a mapping says, or 0, 1, ...; the others follow the largest of these.
    The set of tokens is bounded by the number of characters plus ``n_words``.
    """
    special = dict(special_tokens) if isinstance(special_tokens, Mapping) else {t: i for i, t in enumerate(special_tokens)}
    characters = counts.select(F.explode(F.array_distinct(F.split("word", ""))).alias("token")).distinct()
    frequent = counts.where(F.length("word") > 1).orderBy(F.desc("n"), "word").limit(n_words)
    candidates = (
        characters.select(F.lit(1).alias("_part"), "token")
        .union(characters.select(F.lit(2), F.concat(F.lit(CONTINUATION), "token")))
        .union(frequent.select(F.lit(3), "word"))
        # a word may spell a special or a continued token: the earlier part keeps it
        .groupBy("token")
        .agg(F.min("_part").alias("_part"))
        .where(~F.col("token").isin(list(special)))
        .withColumn("_all", F.lit(1))
    )
    place = F.row_number().over(Window.partitionBy("_all").orderBy("_part", "token"))
    rest = candidates.select((place + max(special.values(), default=-1)).alias("token_id"), "token")
    first = counts.sparkSession.createDataFrame([(i, t) for t, i in special.items()], "token_id int, token string")
    return first.union(rest)
