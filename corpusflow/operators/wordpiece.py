"""Training of WordPiece vocabularies by greedy merging of neighbouring pieces.

The corpus is counted into distinct words by Spark; what merging needs from there on is the words' pieces and how
often each word occurs.  A round works on a bounded table of them:

* Up to ``max_words`` distinct words are taken whole, and one round makes every merge.
* Of more words, only *hot* pairs, the most frequent ones, are looked at.  Words are cut wherever two pieces are no hot
  pair, and equal stretches are added up; fewer pairs are hot until the stretches are few enough.  As long as no
  piece comes about that there is already, a pair that is not hot stays below every hot one, whatever is merged, and the
  counts of the hot ones are complete.  So the round makes merges down to the count of the pairs it left out, or up to the
  first piece made a second time; then the merges are applied to all words, by Spark, and the next round begins.

Either way the merges are those of one merge at a time over all words: most frequent first, ties in the order of the pieces.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from corpusflow.operators.vocab import CONTINUATION, SPECIAL_TOKENS, VOCAB_SIZE, vocabulary_from_tokens
from corpusflow.session import cut_lineage

#: Distinct words, or stretches of words, that one round works on: some 450 bytes of the driver's memory each.
MAX_WORDS = 3_000_000
#: Pairs that may be hot in one round.
MAX_PAIRS = 200_000


def merged(a: str, b: str) -> str:
    return a + (b[len(CONTINUATION):] if b.startswith(CONTINUATION) else b)


def split_words(counts: DataFrame) -> DataFrame:
    """``(pieces, n)``: each word as its characters, all but the first marked as continuations."""
    marked = F.transform(F.split("word", ""), lambda c, i: F.when(i > 0, F.concat(F.lit(CONTINUATION), c)).otherwise(c))
    return counts.where(F.col("word") != "").select(marked.alias("pieces"), "n")


def pair_counts(split: DataFrame) -> DataFrame:
    """``(a, b, n)``: how often each pair of neighbouring pieces occurs."""
    neighbours = F.arrays_zip(
        F.slice("pieces", F.lit(1), F.size("pieces") - 1).alias("a"), F.slice("pieces", F.lit(2), F.size("pieces") - 1).alias("b")
    )
    pairs = split.where(F.size("pieces") > 1).select(F.inline(neighbours).alias("a", "b"), "n")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def collected(rows: DataFrame) -> pa.Table:
    """All rows on the driver, sent as compressed blocks: a row of plain Arrow takes several times the bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sink = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_batches([batch]), sink, compression="zstd")
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    blocks = rows.mapInArrow(pack, "block binary").toArrow().column("block")
    parts = [pq.read_table(pa.BufferReader(block.as_buffer())) for block in blocks]
    return pa.concat_tables(parts) if parts else rows.limit(0).toArrow()


def most_frequent(pairs: DataFrame, max_pairs: int) -> tuple[list[dict], int]:
    """(pairs, floor): the most frequent pairs, most frequent first, and the count that all others are at or below.

    At most ``max_pairs``, all of a count or none; but the largest count's first ``max_pairs`` and one always.
    ``pairs`` is read several times.  How many pairs have each count decides, so no task sorts all of them.
    """
    sizes = sorted(((row["n"], row["pairs"]) for row in pairs.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).collect()), reverse=True)
    held, floor = 0, 0
    for n, size in sizes:
        if held + size > max_pairs:
            floor = n
            break
        held += size
    if sizes and not held:
        floor = sizes[0][0] - 1
        hot = pairs.where(F.col("n") > floor).orderBy("a", "b").limit(max_pairs + 1)
        hot = cut_lineage(hot)  # else every task sends its first ones to the driver
    else:
        hot = pairs.where(F.col("n") > floor)
    return sorted(collected(hot).to_pylist(), key=lambda row: (-row["n"], row["a"], row["b"])), floor


def _codes(words: pa.Array, inside: int) -> np.ndarray:
    """The characters of all words as numbers, those inside a word raised by ``inside``."""
    codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.zeros(len(codes), bool)
    first[np.cumsum(np.concatenate([[0], pc.utf8_length(words).to_numpy()[:-1]]))] = True
    return np.where(first, codes, codes + inside)


def _cut(ids: np.ndarray, lengths: np.ndarray) -> list[str]:
    """One string per word, with the character of :meth:`Merger.char` for each id."""
    codes = np.where(ids + 256 < 0xD800, ids + 256, ids + 256 + 0x800).astype("<u4")  # no surrogates
    text = codes.tobytes().decode("utf-32-le")
    ends = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Merger:
    """Pair counts of a table of words, kept up to date merge by merge through an index from pairs to words.

    A word is a string with a character per piece, a pair a string of two.
    """

    def __init__(self, names: list[str], words: list[str], weights: Sequence[int]):
        self.names, self.words, self.weights = names, words, weights
        self.ids = {name: i for i, name in enumerate(names)}
        self.counts: dict[str, int] = {}
        self.index: dict[str, array] = {}
        for i, word in enumerate(words):
            weight = weights[i]
            for k in range(len(word) - 1):
                self._add(word[k : k + 2], weight, i)
        self.heap = [self._entry(pair) for pair in self.counts]
        heapq.heapify(self.heap)

    @classmethod
    def of_words(cls, table: pa.Table) -> Merger:
        """From whole words, ``(word, n)``; a character is one piece at the start of a word and another inside."""
        inside = 0x110000  # beyond the last character
        used = np.zeros(2 * inside, bool)
        parts = [batch.column(0) for batch in table.to_batches(100_000)]  # few at a time as numbers
        for words in parts:
            used[_codes(words, inside)] = True
        names = [chr(c) if c < inside else CONTINUATION + chr(c - inside) for c in np.flatnonzero(used).tolist()]
        place = np.zeros(2 * inside, np.uint32)
        place[used] = np.arange(len(names))
        found: list[str] = []
        for words in parts:
            found += _cut(place[_codes(words, inside)], pc.utf8_length(words).to_numpy())
        return cls(names, found, array("q", table.column(1).to_numpy()))

    @classmethod
    def of_pieces(cls, table: pa.Table) -> Merger:
        """From stretches of words, ``(pieces, n)``."""
        pieces = pa.concat_arrays(table.column(0).chunks) if table.num_rows else pa.array([], pa.list_(pa.string()))
        coded = pieces.flatten().dictionary_encode()
        found = _cut(coded.indices.to_numpy().astype(np.uint32), pieces.value_lengths().to_numpy())
        return cls(coded.dictionary.to_pylist(), found, array("q", table.column(1).to_numpy()))

    @staticmethod
    def char(code: int) -> str:
        return chr(code + 256 if code + 256 < 0xD800 else code + 256 + 0x800)

    def name(self, char: str) -> str:
        code = ord(char)
        return self.names[code - 256 if code < 0xD800 else code - 256 - 0x800]

    def _entry(self, pair: str) -> tuple[int, str, str, str]:
        return -self.counts[pair], self.name(pair[0]), self.name(pair[1]), pair

    def _add(self, pair: str, weight: int, word: int) -> None:
        if pair in self.counts:
            self.counts[pair] += weight
        else:
            self.counts[pair] = weight
        if pair in self.index:
            self.index[pair].append(word)
        else:
            self.index[pair] = array("i", (word,))

    def best(self) -> tuple[int, str] | None:
        """Count and pair of the next merge."""
        while self.heap:
            negative, _, _, pair = self.heap[0]
            n = self.counts.get(pair, 0)
            if n == -negative:
                return n, pair
            heapq.heappop(self.heap)
            if n > 0:
                heapq.heappush(self.heap, self._entry(pair))
        return None

    def merge(self, pair: str) -> tuple[str, bool]:
        """Merge a pair in all words; the new piece, and whether it had been there."""
        piece = merged(self.name(pair[0]), self.name(pair[1]))
        again = piece in self.ids
        code = self.ids.setdefault(piece, len(self.names))
        if not again:
            self.names.append(piece)
        (first, second), new, touched = pair, self.char(code), set()
        for i in self.index.pop(pair):
            old, weight = self.words[i], self.weights[i]
            at = old.find(pair)
            if at < 0:  # merged otherwise since, or listed twice
                continue
            if old.find(pair, at + 1) < 0:
                self.words[i] = old[:at] + new + old[at + 2 :]
                gone, come = [], []
                if at:
                    gone.append(old[at - 1] + first)
                    come.append(old[at - 1] + new)
                if at + 2 < len(old):
                    gone.append(second + old[at + 2])
                    come.append(new + old[at + 2])
            else:
                self.words[i] = word = old.replace(pair, new)
                gone = [old[k : k + 2] for k in range(len(old) - 1)]
                come = [word[k : k + 2] for k in range(len(word) - 1)]
            for near in gone:
                self.counts[near] -= weight
            for near in come:
                if new in near:
                    self._add(near, weight, i)
                    touched.add(near)
                else:
                    self.counts[near] += weight
        self.counts.pop(pair, None)
        for near in touched:
            if self.counts.get(near, 0) > 0:
                heapq.heappush(self.heap, self._entry(near))
        return piece, again


def merge_rounds_end(merger: Merger, tokens: list[str], known: set[str], vocab_size: int, floor: int, complete: bool) -> list[tuple[str, str]]:
    """Merge while that is sure, and add the new pieces to ``tokens``; the merges made."""
    merges = []
    while len(tokens) < vocab_size:
        best = merger.best()
        if best is None or best[0] <= floor:
            break
        pair = best[1]
        merges.append((merger.name(pair[0]), merger.name(pair[1])))
        piece, again = merger.merge(pair)
        if piece not in known:
            tokens.append(piece)
            known.add(piece)
        if again and not complete:
            break
    return merges


def hot_stretches(split: DataFrame, pairs: list) -> DataFrame:
    """``(pieces, n)``: the stretches of words that hold hot pairs alone, equal ones added up."""
    hot = split.sparkSession.sparkContext.broadcast({(row["a"], row["b"]) for row in pairs})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            found, counts = [], []
            for pieces, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin = 0
                for k in range(1, len(pieces) + 1):
                    if k == len(pieces) or (pieces[k - 1], pieces[k]) not in known:
                        if k - begin > 1:
                            found.append(pieces[begin:k])
                            counts.append(n)
                        begin = k
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(counts, pa.int64())], ["pieces", "n"])

    return split.mapInArrow(cut, "pieces array<string>, n bigint").groupBy("pieces").agg(F.sum("n").alias("n"))


def apply_merges(split: DataFrame, merges: list[tuple[str, str]]) -> DataFrame:
    """Every merge in turn, in all words.  A pair that a later merge brings about again is left alone."""
    ranks: dict[tuple[str, str], list[int]] = {}
    for rank, pair in enumerate(merges):
        ranks.setdefault(pair, []).append(rank)
    carried = split.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = carried.value

        def following(pair: tuple[str, str], done: int) -> int | None:
            known = ranks.get(pair)
            at = bisect_right(known, done) if known else 0
            return known[at] if known and at < len(known) else None

        def applied(pieces: list[str]) -> list[str]:
            done = -1
            while len(pieces) > 1:
                due = [(r, pair) for pair in zip(pieces[:-1], pieces[1:], strict=True) if (r := following(pair, done)) is not None]
                if not due:
                    break
                done, (a, b) = min(due)
                out, k = [], 0
                while k < len(pieces):
                    if k + 1 < len(pieces) and pieces[k] == a and pieces[k + 1] == b:
                        out.append(merged(a, b))
                        k += 2
                    else:
                        out.append(pieces[k])
                        k += 1
                pieces = out
            return pieces

        for batch in batches:
            new = pa.array([applied(p) for p in batch.column(0).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([new, batch.column(1)], ["pieces", "n"])

    return split.mapInArrow(run, "pieces array<string>, n bigint")


def train_wordpiece(
    counts: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    special_tokens: Sequence[str] = SPECIAL_TOKENS,
    min_pair_count: int = 1,
    max_words: int = MAX_WORDS,
    max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """Train a vocabulary on a word-count table: ``(token_id, token)``.

    Special tokens and every character in use are always in it; merges of pairs that occur ``min_pair_count`` times
    or more fill it up to ``vocab_size``.  ``max_words`` and ``max_pairs`` bound what a round holds, not the result.
    ``counts`` is read several times and should be a stored table.
    """
    spark = counts.sparkSession
    split = split_words(counts)
    # one row per character in use
    seen = {row["c"] for row in split.select(F.explode(F.array_distinct("pieces")).alias("c")).distinct().collect()}
    plain = {c[len(CONTINUATION):] if c.startswith(CONTINUATION) and len(c) > len(CONTINUATION) else c for c in seen}
    tokens = list(special_tokens)
    known = set(tokens)
    for token in [*sorted(plain), *sorted(c for c in seen if c not in plain)]:
        if token not in known:
            tokens.append(token)
            known.add(token)
    words = counts.where(F.length("word") > 1).select("word", "n")
    complete = words.count() <= max_words
    if not complete:  # every round works through all pieces of all words: keep every core busy, however few the bytes
        split = cut_lineage(split.repartition(spark.sparkContext.defaultParallelism))
    while len(tokens) < vocab_size:
        if complete:
            floor, merger = 0, Merger.of_words(collected(words))
        else:
            # all pairs of one count are hot or none; the first count always is
            best, floor = most_frequent(cut_lineage(pair_counts(split)), max_pairs)
            while best:
                floor = min(floor, best[0]["n"] - 1)
                hot = [row for row in best if row["n"] > floor]
                table = cut_lineage(hot_stretches(split, hot))
                if len({row["n"] for row in hot}) == 1 or table.count() <= max_words:
                    break
                floor = hot[len(hot) // 4]["n"]
            if not best:
                break
            merger = Merger.of_pieces(collected(table))
        merges = merge_rounds_end(merger, tokens, known, vocab_size, max(floor, min_pair_count - 1), complete)
        if not merges or complete:
            break
        split = cut_lineage(apply_merges(split, merges))
    return vocabulary_from_tokens(spark, tokens)
