"""Expressions over numbers and arrays; they stay inside generated code and run no job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_of(columns: str | Sequence[str]) -> Column:
    """Features as one array of doubles: an array column's name, or a list of number columns."""
    if isinstance(columns, str):
        return F.col(columns).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in columns])


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not at each of its uses inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_logistic(x: Column | str) -> Column:
    """log(1 / (1 + exp(-x))) without overflow on either side."""
    x = _column(x).cast("double")
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def softmax(x: Column | str) -> Column:
    """exp(x - max) over its sum, per row; an empty array stays empty."""
    x = _column(x).cast("array<double>")
    powers = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(powers, lambda p: let(_sum(p), lambda total: F.transform(p, lambda v: v / total)))


def row_norms(x: Column | str, squared: bool = False) -> Column:
    total = _sum(F.transform(_column(x).cast("array<double>"), lambda v: v * v))
    return total if squared else F.sqrt(total)


def norm(x: Column | str, kind: str = "l2") -> Column:
    """l1, l2 or max norm of an array; 0 when it is empty."""
    x = _column(x).cast("array<double>")
    if kind == "l1":
        return _sum(F.transform(x, F.abs))
    if kind == "l2":
        return row_norms(x)
    if kind == "max":
        return F.coalesce(F.array_max(F.transform(x, F.abs)), F.lit(0.0))
    raise ValueError(f"norm is 'l1', 'l2' or 'max', not {kind!r}")


def dot(x: Column | str, y: Column | str | Sequence[float]) -> Column:
    """Sum of products over the length of ``x``; what ``y`` lacks counts as 0."""
    x = _column(x).cast("array<double>")
    y = _column(y).cast("array<double>") if isinstance(y, (Column, str)) else literal_array(y)
    return _sum(F.transform(x, lambda v, i: v * F.coalesce(F.get(y, i), F.lit(0.0))))


def euclidean_distance(x: Column | str, y: Column | str) -> Column:
    """Over the length of ``x``; what ``y`` lacks counts as 0."""
    x, y = _column(x).cast("array<double>"), _column(y).cast("array<double>")
    gap = F.transform(x, lambda v, i: v - F.coalesce(F.get(y, i), F.lit(0.0)))
    return F.sqrt(_sum(F.transform(gap, lambda d: d * d)))
