"""Sufficient statistics of features and a target, in one or two passes, never centred by copying."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import array_of
from ..shipping import ship

#: Up to so many features one aggregate of expressions is the fastest; above it, partial products in Arrow batches.
NARROW = 8


@dataclass
class Moments:
    """Count, means, and centred (or raw) sums of products."""

    n: int
    mean: np.ndarray
    target_mean: float
    gram: np.ndarray
    cross: np.ndarray


def moments(df: DataFrame, features: str | Sequence[str], target: str, centred: bool = True) -> Moments:
    """The p x p Gram matrix and the p products with the target; p x p numbers reach the driver."""
    if not isinstance(features, str) and len(features) <= NARROW:
        return _narrow(df, list(features), target, centred)
    return _wide(df, features, target, centred)


def _narrow(df: DataFrame, features: list[str], target: str, centred: bool) -> Moments:
    x = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    n = F.count(F.lit(1))
    product = (lambda a, b: F.covar_pop(a, b) * n) if centred else (lambda a, b: F.sum(a * b))
    row = df.agg(
        n.alias("n"),
        F.avg(y).alias("my"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[product(x[i], x[j]).alias(f"g{i}_{j}") for i, j in pairs],
        *[product(c, y).alias(f"c{i}") for i, c in enumerate(x)],
    ).first()
    number = lambda v: float("nan") if v is None else v
    gram = np.zeros((len(x), len(x)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = number(row[f"g{i}_{j}"])
    return Moments(row["n"], np.array([number(row[f"m{i}"]) for i in range(len(x))]), number(row["my"]), gram, np.array([number(row[f"c{i}"]) for i in range(len(x))]))


def _wide(df: DataFrame, features: str | Sequence[str], target: str, centred: bool) -> Moments:
    rows = df.select(F.concat(array_of(features), F.array(F.col(target).cast("double"))).alias("x"))
    n, mean, total = scatter(rows, centred)
    return Moments(n, mean[:-1], float(mean[-1]) if n else float("nan"), total[:-1, :-1], total[:-1, -1])


def scatter(rows: DataFrame, centred: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means, and sums of products of the array ``x``, about the means if ``centred``, from one pass.

    Each partition has its own count, means and products about its means; those
    are merged exactly, so nothing cancels. Products are added up by Spark; a
    count and means for each partition reach the driver.
    """
    ship(rows.sparkSession)

    def run(batches):
        n, mean, total = 0, None, None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                own = x.mean(0) if centred else np.zeros(x.shape[1])
                part = (x - own).T @ (x - own)
                if n:
                    gap = own - mean
                    total += part + np.outer(gap, gap) * (n * len(x) / (n + len(x)))
                    mean = mean + gap * (len(x) / (n + len(x)))
                else:
                    mean, total = own, part
                n += len(x)
        if n:
            from pyspark import TaskContext

            size, mark = len(mean), -1 - TaskContext.get().partitionId()
            i, j = np.indices((size, size))
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])
            yield pa.RecordBatch.from_arrays([pa.array([mark] * (size + 1)), pa.array(np.arange(-1, size)), pa.array(np.concatenate([[float(n)], mean]))], names=["i", "j", "s"])

    got = rows.mapInArrow(run, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    i, j, s = (got.column(k).to_numpy() for k in range(3))
    size = int(j.max()) + 1 if len(j) else 0
    total, own = np.zeros((size, size)), i < 0
    total[i[~own], j[~own]] = s[~own]
    marks, place = np.unique(i[own], return_inverse=True)
    parts = np.zeros((len(marks), size + 1))
    parts[place, j[own] + 1] = s[own]
    counts = parts[:, 0]
    n = int(counts.sum())
    if not n:
        return 0, np.zeros(size), total
    mean = counts @ parts[:, 1:] / n
    gap = parts[:, 1:] - mean
    return n, mean, total + (gap * counts[:, None]).T @ gap if centred else total


def column_statistics(rows: DataFrame) -> DataFrame:
    """(k, n, mean, m2, lo, hi) of each position of the array ``x``, one row for each partition, from one pass.

    ``m2`` is the sum of squares about the mean; nulls are left out of all but n, NaN of lo and hi.
    """
    ship(rows.sparkSession)

    def run(batches):
        held = None
        for b in batches:
            x = b.column(0)
            if not b.num_rows:
                continue
            width = x.value_lengths().to_numpy(zero_copy_only=False)
            if not (width == width[0]).all() or held is not None and len(held[0]) != width[0]:
                raise ValueError("rows have different numbers of features")
            v = x.flatten()
            given = np.asarray(v.is_valid()).reshape(b.num_rows, -1)
            v = v.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            n = given.sum(0).astype(np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, np.where(given, v, 0).sum(0) / n, 0)
                m2 = (np.where(given, v - mean, 0) ** 2).sum(0)
                real = given & ~np.isnan(v)
                lo, hi = np.where(real, v, np.inf).min(0), np.where(real, v, -np.inf).max(0)
                if held is not None:
                    rows_, n0, mean0, m0, lo0, hi0 = held
                    both = n0 + n
                    gap = np.where(n0 > 0, np.where(n > 0, mean - mean0, 0), 0)
                    m2 = m0 + m2 + gap * gap * np.where(both > 0, n0 * n / both, 0)
                    mean = np.where(n0 > 0, mean0 + gap * np.where(both > 0, n / both, 0), mean)
                    n, lo, hi = both, np.minimum(lo0, lo), np.maximum(hi0, hi)
                    held = rows_ + b.num_rows, n, mean, m2, lo, hi
                else:
                    held = np.full(len(n), b.num_rows), n, mean, m2, lo, hi
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held[0]))), *(pa.array(h.astype(np.int64) if k < 2 else h.astype(np.float64)) for k, h in enumerate(held))], names=["k", "rows", "n", "mean", "m2", "lo", "hi"])

    return rows.mapInArrow(run, "k bigint, rows bigint, n bigint, mean double, m2 double, lo double, hi double")
