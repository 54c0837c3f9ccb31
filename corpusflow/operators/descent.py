"""Linear models fitted in steps that can be stopped, stored and continued, any number of models in the same passes.

A pass reads the rows of all models once and sums loss and gradient of each at its own point; every model then takes
its own limited-memory quasi-Newton step.  The state after a step is all that the next one needs, so a fit that
is stored and continued goes through the same points as one that is not interrupted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.session import materialise

if TYPE_CHECKING:
    import pyarrow as pa

MAX_WEIGHTS = 50_000_000  # numbers of all models together; the model and each step hold a few times as many
BLOCK = 4096  # numbers of a gradient that are summed as one row
ENTRIES = 1 << 18  # entries of the rows that are stored as one block
STORED = 65_536  # numbers of a state that are stored as one row
FAN_IN = 64  # partial sums of a block before the last sum
STATE_SCHEMA = "model string, kind string, outputs int, columns int, n_rows bigint, part string, place int, values binary"


def sparse_rows(rows: DataFrame, features: str, label: str, *keep: str, label_type: str = "int") -> DataFrame:
    """(label, indices, values) of a table with an ML vector column, sparse or dense; beside the columns to ``keep``."""
    v = F.unwrap_udt(features)
    every = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    indices = F.when(v["type"] == 0, v["indices"]).when(F.size(v["values"]) > 0, every).otherwise(F.array().cast("array<int>"))
    return rows.select(*keep, F.col(label).cast(label_type).alias("label"), indices.alias("indices"), v["values"].alias("values"))


def packed(rows: DataFrame, name: str = "blocks") -> DataFrame:
    """The blocks of :func:`in_blocks`, stored."""
    return materialise(in_blocks(rows), name)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (model, label, indices, values) as blocks of up to ENTRIES entries, their numbers as bytes.

    A pass over blocks copies bytes where one over rows takes every number out of the row in the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            named = batch.column("model").dictionary_encode()
            for k, model in enumerate(named.dictionary.to_pylist()):
                mine = batch.filter(pa.array(named.indices.to_numpy() == k))
                indices, values = mine.column("indices"), mine.column("values")
                ends = indices.offsets.to_numpy().astype(np.int64)
                ends = ends - ends[0]
                at, x = indices.flatten().to_numpy().astype("<i4"), values.flatten().to_numpy().astype("<f8")
                label, begin = mine.column("label").to_numpy().astype("<f8"), 0
                while begin < mine.num_rows:
                    end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ENTRIES, "right")) - 1)
                    a, b = ends[begin], ends[end]
                    columns = [label[begin:end], np.diff(ends[begin : end + 1]).astype("<i4"), at[a:b], x[a:b]]
                    arrays = [pa.array([model], pa.string()), *[pa.array([c.tobytes()], pa.binary()) for c in columns]]
                    yield pa.RecordBatch.from_arrays(arrays, ["model", "label", "sizes", "indices", "values"])
                    begin = end

    made = rows.select("model", F.col("label").cast("double").alias("label"), "indices", "values")
    return made.mapInArrow(run, "model string, label binary, sizes binary, indices binary, values binary")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(model, label, place, at, x) of each block: its rows' labels, and row, column and value of its entries."""
    for batch in batches:
        columns = [batch.column(c) for c in ("model", "label", "sizes", "indices", "values")]
        for model, label, sizes, at, x in zip(*columns, strict=True):
            label = np.frombuffer(label.as_buffer(), "<f8")
            place = np.repeat(np.arange(len(label)), np.frombuffer(sizes.as_buffer(), "<i4"))
            yield model.as_py(), label, place, np.frombuffer(at.as_buffer(), "<i4").astype(np.intp), np.frombuffer(x.as_buffer(), "<f8")


def logits_of(blocks: DataFrame, fits: dict[str, Fit], keep: tuple[str, ...]) -> DataFrame:
    """(model, columns to ``keep``, logits, label) of every row in the blocks of ``fits``, as their models score it."""
    shared = blocks.sparkSession.sparkContext.broadcast({m: f.weights(f.descent.at) for m, f in fits.items()})
    kinds = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for batch in batches:
            kept = [batch.column(c) for c in keep]
            for i, (model, label, place, at, x) in enumerate(blocks_of([batch])):
                n, weights = len(label), shared.value[model]
                margins = np.stack([np.bincount(place, x * w.take(at), n) + w[-1] for w in weights], axis=1)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(weights))
                alike = [pa.array([model], pa.string()), *[c.slice(i, 1) for c in kept]]
                columns = [*[c.take(pa.array(np.zeros(n, np.int32))) for c in alike], pa.ListArray.from_arrays(ends, pa.array(margins.ravel())), pa.array(label)]
                yield pa.RecordBatch.from_arrays(columns, ["model", *keep, "logits", "label"])

    return blocks.where(F.col("model").isin(list(fits))).mapInArrow(run, f"model string, {kinds}logits array<double>, label double")


def parts_of(sums: dict) -> pa.RecordBatch:
    """The sums of one task, ``{model: numbers}``, cut into blocks."""
    import pyarrow as pa

    cut = [(m, b, numbers[b : b + BLOCK]) for m, numbers in sums.items() for b in range(0, len(numbers), BLOCK)]
    m, b, parts = zip(*cut, strict=True) if cut else ((), (), ())
    columns = [pa.array(m, pa.string()), pa.array(b, pa.int32()), pa.array(parts, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["model", "b", "part"])


def total(parts: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The parts of all tasks added up in two levels; one row a model and block reaches the driver."""
    parts = parts.withColumn("fan", F.spark_partition_id() % FAN_IN).withColumn("part", array_to_vector("part"))
    some = parts.groupBy("model", "b", "fan").agg(Summarizer.sum(F.col("part")).alias("part"))
    out = {model: np.zeros(size) for model, size in sizes.items()}
    for r in some.groupBy("model", "b").agg(Summarizer.sum(F.col("part")).alias("part")).collect():
        values = r["part"].toArray()
        out[r["model"]][r["b"] : r["b"] + len(values)] = values
    return out


class Descent:
    """One model's quasi-Newton state; ``ask`` is the point whose loss and gradient it waits for."""

    def __init__(self, width: int, tolerance: float, memory: int = 10):
        self.at = self.ask = np.zeros(width)
        self.tolerance, self.memory, self.steps = tolerance, memory, 0
        self.loss, self.gradient, self.pairs, self.done = np.inf, None, [], False

    def _turn(self) -> None:
        """A new direction from the last steps."""
        d, saved = -self.gradient, []
        for s, y in reversed(self.pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            saved.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(self.pairs, reversed(saved), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        if not d @ self.gradient < 0:
            d, self.pairs = -self.gradient, []
        self.direction = d
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / np.linalg.norm(self.gradient))

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        if self.gradient is None:
            self.enough = self.tolerance * np.linalg.norm(gradient)
        elif loss > self.loss + 1e-4 * self.step * (self.gradient @ self.direction):
            self.step /= 2
            self.done = self.step < 1e-12  # no further descent in doubles
            self.ask = self.at if self.done else self.at + self.step * self.direction
            return
        else:
            self.steps += 1
            s, y = self.ask - self.at, gradient - self.gradient
            if s @ y > 0:
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.at, self.loss, self.gradient = self.ask, loss, gradient
        self.done = np.linalg.norm(gradient) <= self.enough
        if not self.done:
            self._turn()
            self.ask = self.at + self.step * self.direction

    def parts(self) -> dict[str, np.ndarray]:
        """Everything the next step needs, as named vectors; only after the first ``tell``."""
        turned = {} if self.done else {"direction": self.direction}
        kept = {f"s{i}": s for i, (s, _) in enumerate(self.pairs)} | {f"y{i}": y for i, (_, y) in enumerate(self.pairs)}
        step = 0.0 if self.done else self.step
        numbers = np.array([self.loss, step, self.enough, self.steps, self.done, self.tolerance, self.memory], float)
        return {"numbers": numbers, "at": self.at, "gradient": self.gradient, **turned, **kept}

    @classmethod
    def restored(cls, parts: dict[str, np.ndarray]) -> Descent:
        loss, step, enough, steps, done, tolerance, memory = parts["numbers"].tolist()
        new = cls(len(parts["at"]), tolerance, int(memory))
        new.loss, new.enough, new.steps, new.done = loss, enough, int(steps), bool(done)
        new.at = new.ask = parts["at"]
        new.gradient = parts["gradient"]
        new.pairs = [(parts[f"s{i}"], parts[f"y{i}"]) for i in range(sum(name[0] == "s" for name in parts))]
        if not new.done:
            new.step, new.direction = step, parts["direction"]
            new.ask = new.at + step * new.direction
        return new


@dataclass
class Fit:
    """A linear model on the way: ``kind`` is ``"softmax"`` (``outputs`` classes) or ``"squared"`` (one output).

    It minimises the mean loss of its ``n_rows`` rows plus ``|w|^2 / (2 n_rows)``; intercepts are free.
    """

    kind: str
    outputs: int
    columns: int
    n_rows: int
    tolerance: float = 1e-6
    descent: Descent = field(default=None, repr=False)

    def __post_init__(self):
        if self.descent is None:
            self.descent = Descent(self.outputs * (self.columns + 1), self.tolerance)

    def weights(self, point: np.ndarray) -> np.ndarray:
        return point.reshape(self.outputs, self.columns + 1)

    def tell(self, sums: np.ndarray) -> None:
        held = self.weights(self.descent.ask).copy()
        held[:, -1] = 0.0
        held = held.ravel() / self.n_rows
        self.descent.tell(float(sums[-1] / self.n_rows + 0.5 * self.n_rows * (held @ held)), sums[:-1] / self.n_rows + held)

    def model(self, spark: SparkSession, features: str = "features") -> Model:
        """The model of the last step, as one of ``pyspark.ml``."""
        sc, w = spark.sparkContext, self.weights(self.descent.at)
        if self.kind == "squared":
            args = LinearRegression._randomUID(), _py2java(sc, Vectors.dense(w[0, :-1])), float(w[0, -1])
            made = JavaWrapper._new_java_obj("org.apache.spark.ml.regression.LinearRegressionModel", *args)
            return LinearRegressionModel(made).setFeaturesCol(features)
        matrix = DenseMatrix(self.outputs, self.columns, w[:, :-1].ravel(order="F"))
        args = LogisticRegression._randomUID(), _py2java(sc, matrix), _py2java(sc, Vectors.dense(w[:, -1])), self.outputs, True
        made = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel", *args)
        return LogisticRegressionModel(made).setFeaturesCol(features)


def _losses(shared):
    """Per task: the sums of gradients and losses of every model that has rows there."""

    def add(out, kind, weights, place, at, x, label):
        n, columns = len(label), weights.shape[1] - 1
        margins = np.stack([np.bincount(place, x * w.take(at), n) + w[-1] for w in weights], axis=1)
        if kind == "squared":
            pull = margins - label[:, None]
            loss = 0.5 * (pull**2).sum()
        else:
            top = margins.max(axis=1, keepdims=True)
            shares = np.exp(margins - top)
            norm = shares.sum(axis=1, keepdims=True)
            own = np.arange(n), label.astype(int)
            loss = (np.log(norm) + top).sum() - margins[own].sum()
            pull = shares / norm
            pull[own] -= 1.0
        for o in range(len(weights)):
            begin = o * (columns + 1)
            out[begin : begin + columns] += np.bincount(at, pull[:, o].take(place) * x, columns)
            out[begin + columns] += pull[:, o].sum()
        out[-1] += loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sums = shared.value, {}
        for model, label, place, at, x in blocks_of(batches):
            kind, weights = points[model]
            add(sums.setdefault(model, np.zeros(weights.size + 1)), kind, weights, place, at, x, label)
        yield parts_of(sums)

    return run


def advance(rows: DataFrame, fits: dict[str, Fit], steps: int) -> int:
    """Every model takes ``steps`` more steps, fewer where its gradient is small; returns the number of passes.

    ``rows`` holds (model, label double, indices, values), at least the rows of ``fits``, or is such a table as :func:`packed` blocks,
    for several calls: each pass reads the blocks of the models that still go on.  Labels of a softmax are 0 .. outputs - 1.
    """
    sizes = {m: f.outputs * (f.columns + 1) for m, f in fits.items()}
    if sum(sizes.values()) > MAX_WEIGHTS:
        raise ValueError(f"{sum(sizes.values())} weights are more than {MAX_WEIGHTS}")
    rows = rows if "sizes" in rows.columns else packed(rows)
    goal, passes = {m: f.descent.steps + steps for m, f in fits.items()}, 0
    while going := [m for m, f in fits.items() if not f.descent.done and f.descent.steps < goal[m]]:
        shared = rows.sparkSession.sparkContext.broadcast({m: (fits[m].kind, fits[m].weights(fits[m].descent.ask)) for m in going})
        parts = rows.where(F.col("model").isin(going))
        sums = total(parts.mapInArrow(_losses(shared), "model string, b int, part array<double>"), {m: sizes[m] + 1 for m in going})
        shared.unpersist()
        for m in going:
            fits[m].tell(sums[m])
        passes += 1
    return passes


def save_fits(spark: SparkSession, fits: dict[str, Fit], path: str) -> None:
    """The states of fits that have had a pass, as a table; some 24 numbers of 8 bytes a weight."""
    cut = [
        (m, f.kind, f.outputs, f.columns, f.n_rows, part, b, bytearray(values[b : b + STORED].astype("<f8").tobytes()))
        for m, f in fits.items() for part, values in f.descent.parts().items() for b in range(0, len(values), STORED)
    ]
    spark.createDataFrame(cut, STATE_SCHEMA).write.mode("overwrite").parquet(path)


def load_fits(spark: SparkSession, path: str) -> dict[str, Fit]:
    """Fits as they were stored; bounded, as ``advance`` bounds the weights."""
    found: dict = {}
    for r in spark.read.schema(STATE_SCHEMA).parquet(path).collect():
        found.setdefault((r["model"], r["kind"], r["outputs"], r["columns"], r["n_rows"]), {}).setdefault(r["part"], []).append((r["place"], r["values"]))
    fits = {}
    for (m, *shape), parts in sorted(found.items()):
        whole = {part: np.concatenate([np.frombuffer(v, "<f8") for _, v in sorted(blocks)]) for part, blocks in parts.items()}
        descent = Descent.restored(whole)
        fits[m] = Fit(*shape, tolerance=descent.tolerance, descent=descent)
    return fits
