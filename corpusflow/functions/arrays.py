"""Column expressions over arrays: logits, scores and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def argmax(logits: Column | str) -> Column:
    """Index of the largest entry; the first one wins a tie."""
    values = _col(logits)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def clip_and_round(score: Column | str, low: float = 0.0, high: float = 5.0) -> Column:
    """Clip to [low, high] and round to one decimal, half to even, in single precision."""
    single = _col(score).cast("float")
    clipped = F.greatest(F.lit(low).cast("float"), F.least(F.lit(high).cast("float"), single))
    return F.rint(clipped * F.lit(10.0).cast("float")) / F.lit(10.0)


def row_cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """``log(sum(exp(logits))) - logits[label]``, shifted by the maximum to stay finite."""
    values = F.transform(_col(logits), lambda v: v.cast("double"))
    peak = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v - peak))
    return peak + F.ln(total) - F.get(values, _col(label).cast("int"))


def row_squared_error(prediction: Column | str, label: Column | str) -> Column:
    gap = _col(prediction).cast("double") - _col(label).cast("double")
    return gap * gap


def pad_mask(ids: Column | str, pad_id: int = 0) -> Column:
    """TRUE where the position holds padding."""
    return F.transform(_col(ids), lambda i: i == F.lit(pad_id))


def pad_to(ids: Column | str, width: int, value: int = 0) -> Column:
    """Extend an array to ``width`` entries."""
    values = _col(ids)
    fill = F.greatest(F.lit(width) - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(value), fill))


def zero_types(ids: Column | str) -> Column:
    """All-zero segment ids of the same length."""
    return F.transform(_col(ids), lambda _: F.lit(0))
