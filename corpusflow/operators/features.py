"""Text features: TF-IDF vectors and rows, embeddings, principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
    Word2Vec,
)
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusflow.functions.tokens import TERM, terms
from corpusflow.operators.lookup import BROADCAST_ROWS, is_small
from corpusflow.operators.vocab import top_terms
from corpusflow.session import materialise

MAX_TERMS = 10_000
# widest input for which the d x d covariance of pyspark.ml's PCA is acceptable on the driver
COVARIANCE_COLUMNS = 2_000
# characters of text that one task learns word vectors from, while there are cores for more tasks
CHARS_PER_PART = 16_000_000


class NoTermsError(ValueError):
    """Texts without a single term: nothing can be learned from them."""


def english_stop_words() -> list[str]:
    """The default list; needs a running session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def fit_tfidf(
    train: DataFrame,
    max_terms: int = MAX_TERMS,
    column: str = "text",
    out: str = "features",
    stop_words: Sequence[str] | None = None,
) -> PipelineModel:
    """TF-IDF with smoothed idf + 1 and unit length, as a pipeline that can be saved.

    The vocabulary is the ``max_terms`` most frequent terms of ``train`` with a fixed tie order, so
    at most that many strings and weights pass through the driver.
    """
    counting = _counting(train, max_terms, column, out, stop_words)
    counted = PipelineModel(counting).transform(train.select(column))
    return PipelineModel([*counting, *_weighing(counted, out)])


def _counting(train: DataFrame, max_terms: int, column: str, out: str, stop_words: Sequence[str] | None) -> list:
    """The stages from texts to counts of the terms in the vocabulary."""
    stops = english_stop_words() if stop_words is None else list(stop_words)
    vocabulary = [row["term"] for row in top_terms(train, max_terms, column, stops).collect()]
    if not vocabulary:
        raise NoTermsError("no terms left to build features from")
    found, kept, counts = (f"_{out}_{step}" for step in ("terms", "kept", "counts"))
    tokenizer = RegexTokenizer(inputCol=column, outputCol=found, gaps=False, pattern=TERM, toLowercase=True)
    # an empty list would mean "default" to the stage
    remover = StopWordsRemover(inputCol=found, outputCol=kept, stopWords=stops or [" "], caseSensitive=True)
    return [tokenizer, remover, CountVectorizerModel.from_vocabulary(vocabulary, inputCol=kept, outputCol=counts)]


def _weighing(counted: DataFrame, out: str) -> list:
    """The stages from counts to the finished vector."""
    counts, weighted = f"_{out}_counts", f"_{out}_weighted"
    idf = IDF(inputCol=counts, outputCol="_idf").fit(counted.select(counts)).idf.toArray() + 1.0
    weigh = ElementwiseProduct(inputCol=counts, outputCol=weighted, scalingVec=Vectors.dense(idf))
    return [weigh, Normalizer(inputCol=weighted, outputCol=out, p=2.0)]


def tfidf_vectors(
    df: DataFrame, max_terms: int = MAX_TERMS, column: str = "text", out: str = "features", stop_words: Sequence[str] | None = None
) -> DataFrame:
    """The vectors of :func:`fit_tfidf` instead of the texts it is fitted on, from stored counts: where no model is kept, a pass over the texts less."""
    counting = _counting(df, max_terms, column, out, stop_words)
    rest = [c for c in df.columns if c != column]
    counted = store_vectors(PipelineModel(counting).transform(df).select(*rest, f"_{out}_counts"), "counts")
    return PipelineModel(_weighing(counted, out)).transform(counted).select(*rest, out)


def add_tfidf(df: DataFrame, model: PipelineModel, out: str = "features") -> DataFrame:
    """Apply the model and keep only the finished vector."""
    return model.transform(df).select(*df.columns, out)


def vocabulary_size(model: PipelineModel) -> int:
    return next(len(stage.vocabulary) for stage in model.stages if isinstance(stage, CountVectorizerModel))


def tfidf_rows(
    df: DataFrame,
    max_terms: int = MAX_TERMS,
    column: str = "text",
    id_col: str = "doc_id",
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """The same weights as ``(doc_id, term, weight)`` rows, for SQL users.

    Terms are counted row by row and weighed where they are; only the rows of ids that repeat are brought together.
    A vocabulary too large for that is joined as a table.
    """
    if max_terms > BROADCAST_ROWS:
        return _tfidf_by_join(df, max_terms, column, id_col, stop_words)
    spark = df.sparkSession
    vocabulary = [row["term"] for row in top_terms(df, max_terms, column, stop_words).collect()]
    if not vocabulary:
        return df.select(id_col, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    found = F.coalesce(terms(column, list(stop_words)), F.array().cast("array<string>"))
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_counts")
    counted = materialise(counter.transform(df.select(id_col, found.alias("_terms"))).select(id_col, "_counts"), "counts")
    often = counted.groupBy(F.col(id_col).alias("_often")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_often")
    often = materialise(often, "often")
    often = F.broadcast(often) if is_small(often) else often
    again = F.col(id_col).eqNullSafe(F.col("_often"))
    single = counted.join(often, again, "left_anti")
    tf = _entries(counted.join(often, again, "left_semi"), id_col, "_counts").groupBy(id_col, "j").agg(F.sum("x").alias("tf"))
    held = _entries(single, id_col, "_counts").select("j").unionByName(tf.select("j")).groupBy("j").agg(F.count(F.lit(1)).alias("df"))
    n_docs, idf = counted.count(), np.ones(len(vocabulary))
    for row in held.collect():  # a row a term
        idf[row["j"]] += np.log((1.0 + n_docs) / (1.0 + row["df"]))
    weigh = ElementwiseProduct(inputCol="_counts", outputCol="_weighted", scalingVec=Vectors.dense(idf))
    normalise = Normalizer(inputCol="_weighted", outputCol="_weights", p=2.0)
    names = spark.createDataFrame([(j, t, float(idf[j])) for j, t in enumerate(vocabulary)], "j int, term string, _idf double")
    alone = _entries(normalise.transform(weigh.transform(single)), id_col, "_weights").withColumnRenamed("x", "weight")
    alone = alone.join(F.broadcast(names), "j").select(id_col, "term", "weight")
    return alone.unionByName(_normalised(tf.join(F.broadcast(names), "j"), id_col))


def _entries(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, j, x) of the entries of sparse vectors."""
    v = F.unwrap_udt(vector)
    return rows.select(id_col, F.inline(F.arrays_zip(v["indices"].alias("j"), v["values"].alias("x"))).alias("j", "x"))


def _normalised(tf: DataFrame, id_col: str) -> DataFrame:
    weighted = tf.select(id_col, "term", (F.col("tf") * F.col("_idf")).alias("_w"))
    # one document's terms, at most max_terms rows
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", (F.col("_w") / norm).alias("weight"))


def _tfidf_by_join(df: DataFrame, max_terms: int, column: str, id_col: str, stop_words: Sequence[str]) -> DataFrame:
    listed = df.select(id_col, F.explode(terms(column, list(stop_words))).alias("term"))
    tf = listed.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    # both counts come from the per-document table
    vocab = (
        tf.groupBy("term")
        .agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
        .orderBy(F.desc("n"), "term")
        .limit(max_terms)
    )
    idf = F.ln(F.lit(1.0 + df.count()) / (F.col("df") + 1.0)) + 1.0
    return _normalised(tf.join(vocab.select("term", idf.alias("_idf")), "term"), id_col)


def store_vectors(df: DataFrame, name: str = "vectors") -> DataFrame:
    """Write feature rows once, in evenly sized files, and continue from them.

    Training reads them once per fit and caches its own blocks.  The rebalance hint lets AQE size
    the files from the actual bytes: one for a small table, many for a large one.
    """
    return materialise(df.hint("rebalance"), name)


def embedding_column(df: DataFrame, column: str = "embedding", out: str = "features") -> DataFrame:
    """Use a stored ``ARRAY<FLOAT>`` column as features."""
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def fit_word_average(
    train: DataFrame, size: int = 100, column: str = "text", out: str = "features", seed: int = 42, min_count: int = 5,
    chars_per_part: int = CHARS_PER_PART,
) -> PipelineModel:
    """Average of word vectors learned from ``train``.

    The vectors of a small corpus are learned in one task.  A larger one is dealt to a task per ``chars_per_part``
    characters, as many as run at once at most: each learns from its share of the texts, and the vectors of a word are averaged.
    """
    tokenizer = RegexTokenizer(inputCol=column, outputCol="_terms", gaps=False, pattern=TERM, toLowercase=True)
    chars = train.agg(F.sum(F.length(column).cast("bigint"))).first()[0] or 0
    parts = max(1, min(-(-chars // chars_per_part), train.sparkSession.sparkContext.defaultParallelism))
    learner = Word2Vec(vectorSize=size, inputCol="_terms", outputCol=out, seed=seed, minCount=min_count, numPartitions=parts)
    return PipelineModel([tokenizer, learner.fit(tokenizer.transform(train.select(column)))])


def embed_with(
    df: DataFrame,
    make_predict: Callable,
    column: str = "text",
    out: str = "embedding",
    batch_size: int = 64,
) -> DataFrame:
    """Embed texts with the caller's model; ``make_predict`` runs once per Python worker."""
    model = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn(out, model(column))


def _project(vectors: DataFrame, column: str, matrix: np.ndarray, id_cols: Sequence[str], out: Sequence[str]) -> DataFrame:
    """``features . matrix`` row by row; ``matrix`` is (width, few) and travels as a broadcast."""
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns, values = _triplets(batch.column(len(id_cols)))
            scores = np.empty((batch.num_rows, shared.value.shape[1]))
            for j in range(shared.value.shape[1]):
                scores[:, j] = np.bincount(rows, values * shared.value[columns, j], minlength=batch.num_rows)
            arrays = [batch.column(i) for i in range(len(id_cols))] + [pa.array(scores[:, j]) for j in range(scores.shape[1])]
            yield pa.RecordBatch.from_arrays(arrays, [*id_cols, *out])

    kinds = [f"{c} {vectors.schema[c].dataType.simpleString()}" for c in id_cols]
    return vectors.select(*id_cols, column).mapInArrow(project, ", ".join(kinds + [f"{c} double" for c in out]))


def _triplets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries in an Arrow array of ML vectors, sparse or dense."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ExtensionArray):
        column = column.storage
    sparse = column.field("type").to_numpy(zero_copy_only=False) == 0
    sizes = np.fromiter((len(v) for v in column.field("values")), dtype=np.int64, count=len(column))
    values = column.field("values").flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), sizes)
    starts = np.cumsum(sizes) - sizes
    columns = np.arange(len(values)) - np.repeat(starts, sizes)
    held = column.field("indices").flatten().to_numpy(zero_copy_only=False)
    columns[np.repeat(sparse, sizes)] = held
    return rows, columns, values


def wide_components(
    vectors: DataFrame, width: int, k: int = 2, column: str = "features", seed: int = 42, oversample: int = 8,
    max_rounds: int = 300, tolerance: float = 1e-6,
) -> tuple[np.ndarray, np.ndarray]:
    """Leading ``k`` principal directions (width x k) and the mean, without a width x width matrix.

    Subspace iteration on the centred covariance: every round multiplies the sparse rows with a
    width x (k + oversample) block and adds the results up per column, so a task emits at most one
    short row per column.  The driver only orthogonalises that block.  Stops when the spanned
    directions no longer move; directions that still move after ``max_rounds`` are an error.
    """
    totals = _column_sums(vectors, column, None, width, 1)
    n_rows, mean = totals[0], totals[1][:, 0] / max(totals[0], 1)
    rng = np.random.default_rng(seed)
    basis, _ = np.linalg.qr(rng.standard_normal((width, min(width, k + oversample))))
    best = None
    for _ in range(max_rounds):
        _, product = _column_sums(vectors, column, basis, width, basis.shape[1])
        product = product / max(n_rows, 1) - np.outer(mean, mean @ basis)
        small = (basis.T @ product + product.T @ basis) / 2
        order = np.linalg.eigh(small)
        directions = basis @ order[1][:, ::-1][:, :k]
        basis, _ = np.linalg.qr(product)
        if best is not None and np.linalg.norm(directions - best @ (best.T @ directions)) < tolerance:
            best = directions
            break
        best = directions
    else:
        raise ValueError(f"principal directions still move after {max_rounds} rounds")
    # a fixed sign: the largest entry of each direction is positive
    flip = np.sign(best[np.abs(best).argmax(axis=0), np.arange(best.shape[1])])
    return best * np.where(flip == 0, 1, flip), mean


def _column_sums(vectors: DataFrame, column: str, basis: np.ndarray | None, width: int, many: int):
    """Row count and ``X' (X basis)``; without a basis the plain column sums."""
    shared = vectors.sparkSession.sparkContext.broadcast(basis) if basis is not None else None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value if shared is not None else None
        total, seen, count = np.zeros((width, many)), np.zeros(width, dtype=bool), 0
        for batch in batches:
            rows, columns, values = _triplets(batch.column(0))
            count += batch.num_rows
            seen[columns] = True
            for j in range(many):
                if block is None:
                    weight = values
                else:
                    score = np.bincount(rows, values * block[columns, j], minlength=batch.num_rows)
                    weight = values * score[rows]
                total[:, j] += np.bincount(columns, weight, minlength=width)
        used = np.flatnonzero(seen)
        # column -1 carries the row count
        index = pa.array(np.concatenate([[-1], used]).astype(np.int32))
        sums = np.vstack([np.full((1, many), float(count)), total[used]])
        yield pa.RecordBatch.from_arrays(
            [index, *[pa.array(sums[:, j]) for j in range(many)]], ["i", *[f"s{j}" for j in range(many)]]
        )

    schema = ", ".join(["i int", *[f"s{j} double" for j in range(many)]])
    parts = vectors.select(column).mapInArrow(partial, schema)
    rows = parts.groupBy("i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(many)]).collect()
    out, n_rows = np.zeros((width, many)), 0.0
    for row in rows:
        if row["i"] < 0:
            n_rows = row["s0"]
        else:
            out[row["i"]] = [row[f"s{j}"] for j in range(many)]
    return n_rows, out


def principal_components(
    df: DataFrame,
    width: int,
    column: str = "features",
    out: Sequence[str] = ("x", "y"),
    keep: Sequence[str] = ("doc_id",),
    max_covariance: int = COVARIANCE_COLUMNS,
) -> DataFrame:
    """``keep`` columns plus the mean-centred scores on the leading ``len(out)`` components.

    ``df`` should be persisted: it is read a few times.  Up to ``max_covariance`` columns the
    covariance is solved directly, wider input goes through :func:`wide_components`.
    """
    k = len(out)
    if width <= max_covariance:
        model = PCA(k=k, inputCol=column, outputCol="_pc").fit(df.select(column))
        directions = model.pc.toArray()
        mean = _column_sums(df, column, None, width, 1)
        mean = mean[1][:, 0] / max(mean[0], 1)
    else:
        directions, mean = wide_components(df, width, k, column)
    scores = _project(df, column, directions, list(keep), list(out))
    shift = mean @ directions
    return scores.withColumns({name: F.col(name) - F.lit(float(shift[j])) for j, name in enumerate(out)})
