"""Array expressions: pooling, normalising, padding, soft-max, arg-max."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def l2_normalise(values: Column) -> Column:
    """Unit vector; an all-zero vector stays zero."""
    norm = F.sqrt(dot(values, values))
    return F.transform(values, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def softmax(values: Column) -> Column:
    """Shifted by the maximum, so large values do not overflow."""
    exps = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(exps, lambda e: e / array_sum(exps))


def argmax(values: Column) -> Column:
    """Zero-based position of the maximum; the lowest position wins ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def pad_to(values: Column, size: int, filler) -> Column:
    """First ``size`` elements, filled up at the end."""
    kept = F.slice(values, 1, size)
    return F.concat(kept, F.array_repeat(F.lit(filler), F.lit(size) - F.size(kept)))


def pad_mask(values: Column, size: int) -> Column:
    """1 for real elements, 0 for padding."""
    n = F.least(F.size(values), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(size) - n))


def zeros(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def gated(values: Column, gate: Column) -> Column:
    """Element-wise product with a gate already in (0, 1)."""
    return F.zip_with(values, gate, lambda v, g: v * g)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def gate_from(features: Column, weights: list[list[float]]) -> Column:
    """``sigmoid(W · features)``, one value per row of ``W``."""
    matrix = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    return F.transform(matrix, lambda row: sigmoid(dot(row, features)))
