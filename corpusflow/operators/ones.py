"""Logistic regression over rows of ones: sets of columns, stored as bytes.

The model, objective and optimiser are those of ``pyspark.ml``'s binary ``LogisticRegression``: columns scaled by their
deviation and centred, the penalty on scaled weights, ten corrections, a strong Wolfe line search, the same
tests for the end.  Only the passes differ: they read two bytes an entry from the stored rows, where the library keeps twelve in memory or,
of a large table, on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.operators.descent import parts_of, total

if TYPE_CHECKING:
    import pyarrow as pa

DIRECT = 32  # sums of as many tasks go straight to the driver; of more, they are added up before


class SearchError(ArithmeticError):
    """No step along this direction."""


def code_type(width: int) -> str:
    """The smallest unsigned number that holds a column below ``width``."""
    return "<u2" if width <= 1 << 16 else "<u4"


def codes_array(ends: np.ndarray, columns: np.ndarray, width: int) -> pa.Array:
    """Rows of columns, ``ends[i]`` to ``ends[i + 1]``, as an Arrow array of bytes."""
    import pyarrow as pa

    kind = np.dtype(code_type(width))
    buffers = [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32).tobytes()), pa.py_buffer(columns.astype(kind).tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, buffers)


def codes_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries of each row, columns of all rows) of such an array."""
    import pyarrow as pa

    kind = np.dtype(code_type(width))
    _, ends, data = column.cast(pa.binary()).buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset) // kind.itemsize
    columns = np.frombuffer(data or b"", kind, int(ends[-1]) if data else 0)[ends[0] :]
    return np.diff(ends), columns.astype(np.intp)


def row_sums(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each row's values; an empty row has none."""
    out, full = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _interpolated(left: tuple, right: tuple) -> float:
    """The minimum of the cubic through two points (place, value, slope), kept off the ends."""
    (a, fa, da), (b, fb, db) = left, right
    d1 = da + db - 3 * (fa - fb) / (a - b)
    inner = d1 * d1 - da * db
    d2 = np.sqrt(inner) if inner >= 0 else np.nan
    t = b - (b - a) * (db + d2 - d1) / (db - da + 2 * d2)
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return low if t < low else high if t > high else t


def _wolfe_step(phi: Callable[[float], tuple], first: float, most: int = 10, c1: float = 1e-4, c2: float = 0.9) -> float:
    """A step with enough descent and a flat enough slope (Nocedal and Wright); ``phi`` gives (place, value, slope)."""
    _, value, slope = low = phi(0.0)
    if slope > 0:
        raise SearchError

    def zoomed(low: tuple, high: tuple) -> float:
        for _ in range(most):
            t = _interpolated(high, low) if low[0] > high[0] else _interpolated(low, high)
            c = phi(t)
            if c[1] > value + c1 * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchError

    t = first
    for i in range(most):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i > 0):
            return zoomed(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return t
        if c[2] >= 0:
            return zoomed(c, low)
        low, t = c, t * 1.5
    raise SearchError


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient, turned by the last (step, change of the gradient); the newest pair comes first."""
    d, saved = gradient.copy(), []
    for s, y in pairs:
        rho = s @ y
        a = (s @ d) / rho
        if np.isnan(a):
            raise SearchError
        d -= a * y
        saved.append((a, rho))
    if pairs:
        s, y = pairs[0]
        if not s @ y >= 0:
            raise SearchError
        d *= (s @ y) / (y @ y)
    for (s, y), (a, rho) in zip(reversed(pairs), reversed(saved), strict=True):
        d += (a - (y @ d) / rho) * s
    return -d


def minimise(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, max_iter: int, tolerance: float, memory: int = 10, recent: int = 20
) -> tuple[np.ndarray, int]:
    """(point, iterations): limited-memory quasi-Newton descent, step by step that of the library.

    It ends after ``max_iter`` steps, when the loss is near the largest of the ``recent`` last ones, when the gradient is
    small, or when no step is found twice in a row.
    """
    last: list = [None, None]

    def known(point: np.ndarray) -> tuple[float, np.ndarray]:
        if last[0] is None or not np.array_equal(last[0], point):
            last[:] = point, evaluate(point)
        return last[1]

    x = start
    value, gradient = known(x)
    begun, pairs, values, steps, failed = value, [], [np.inf], 0, False
    while steps < max_iter and np.linalg.norm(gradient) > max(tolerance * abs(value), 1e-8):
        if len(values) > 1 and abs(value - max(values)) <= tolerance * begun:
            break
        try:
            d = _direction(gradient, pairs)

            def phi(t: float, x: np.ndarray = x, d: np.ndarray = d) -> tuple[float, float, float]:
                found = known(x + d * t)
                return t, found[0], float(found[1] @ d)

            step = _wolfe_step(phi, 1.0 if steps else 1.0 / np.linalg.norm(d))
            if step * np.linalg.norm(gradient) < 1e-10:
                raise SearchError
        except SearchError:
            if failed:
                break
            failed, pairs = True, []
            continue
        new = x + d * step
        new_value, new_gradient = known(new)
        pairs = [(new - x, new_gradient - gradient), *pairs][:memory]
        x, value, gradient, steps, failed = new, new_value, new_gradient, steps + 1, False
        values = [*values, value][-recent:]
    return x, steps


class OnesRegression(LogisticRegression):
    """Binary ``LogisticRegression`` of rows (label, weight, codes); ``featuresCol`` names the codes of columns below ``width``.

    Labels are 0 and 1.  The rows should be a stored table: every pass reads them.
    """

    width: int

    def of(self, width: int) -> OnesRegression:
        self.width = width
        return self

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        spark, width = dataset.sparkSession, self.width
        names = (self.getLabelCol(), self.getWeightCol(), self.getFeaturesCol())
        rows = dataset.select(*[F.col(c).alias(to) for c, to in zip(names, ("label", "weight", "codes"), strict=True)])
        rows = rows.coalesce(max(1, 2 * spark.sparkContext.defaultParallelism))  # a sum of all columns a task, not a split
        few = rows.rdd.getNumPartitions() <= DIRECT

        def counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(3 + width)
            for label, weight, sizes, codes in _numbers(batches, width):
                out[:3] += weight.sum(), (weight**2).sum(), weight @ label
                out[3:] += np.bincount(codes, np.repeat(weight, sizes), width)
            return out

        found = _summed(rows, counted, 3 + width, few)
        weight, squares, licences = found[:3].tolist()
        mean = found[3:] / weight
        deviation = np.sqrt(np.maximum(found[3:] * (1.0 - mean), 0.0) / (weight - squares / weight))
        inverse = np.divide(1.0, deviation, out=np.zeros(width), where=deviation > 0)
        centre, penalty = inverse * mean, self.getRegParam()
        if licences in (0.0, weight):  # one class
            return _model(spark, np.zeros(width), np.inf if licences else -np.inf)

        def evaluate(point: np.ndarray) -> tuple[float, np.ndarray]:
            inner, outer = point[:width], float(point[width] - point[:width] @ centre)
            shared = spark.sparkContext.broadcast((inner * inverse, outer))

            def each(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
                (own, base), out = shared.value, np.zeros(width + 2)
                for label, weight, sizes, codes in _numbers(batches, width):
                    margin = row_sums(sizes, own.take(codes)) + base
                    with np.errstate(over="ignore"):
                        pull = weight * (1.0 / (1.0 + np.exp(-margin)) - label)
                    out[:width] += np.bincount(codes, np.repeat(pull, sizes), width)
                    out[width] += pull.sum()
                    out[width + 1] += weight @ np.logaddexp(0.0, np.where(label > 0, -margin, margin))
                return out

            sums = _summed(rows, each, width + 2, few) / weight
            shared.destroy()
            gradient = np.append(inverse * sums[:width] - sums[width] * centre + penalty * inner, sums[width])
            return float(sums[width + 1] + 0.5 * penalty * (inner @ inner)), gradient

        start = np.append(np.zeros(width), np.log(licences / (weight - licences)))
        point, _ = minimise(evaluate, start, self.getMaxIter(), self.getTol())
        return _model(spark, point[:width] * inverse, float(point[width] - point[:width] @ centre))


def _numbers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in batches:
        label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
        yield label, weight, *codes_of(batch.column("codes"), width)


def _model(spark: SparkSession, weights: np.ndarray, intercept: float) -> LogisticRegressionModel:
    args = LogisticRegression._randomUID(), _py2java(spark.sparkContext, Vectors.dense(weights)), float(intercept)
    return LogisticRegressionModel(JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel", *args))


def _summed(rows: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, few: bool) -> np.ndarray:
    """The sum over all tasks, few or not, of the ``size`` numbers that ``each`` makes of a task's batches."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([each(batches).tobytes()], pa.binary())], ["part"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield parts_of({"": each(batches)})

    if not few:
        return total(rows.mapInArrow(cut, "model string, b int, part array<double>"), {"": size})[""]
    return sum((np.frombuffer(r["part"]) for r in rows.mapInArrow(whole, "part binary").collect()), np.zeros(size))
