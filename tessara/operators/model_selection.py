"""Exact, repeatable splits by ranks, without collecting or single-partition sorts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Estimator
from ..plans.ranks import with_rank


def test_rows(n: int, test_size: float) -> int:
    """max(1, test_size * n), halves rounded up."""
    import math

    return max(1, math.floor(n * test_size + 0.5))


test_rows.__test__ = False  # not a test, though pytest would take its name for one


def assign_split(df: DataFrame, key: str, test_size: float = 0.25, random_state: int = 42, shuffle: bool = True) -> DataFrame:
    """``df`` with ``part``: 'train' for the first rows of the order of a unique key, 'test' for the rest."""
    n = df.count()
    n_train = n - test_rows(n, test_size)
    if n_train < 1:
        raise ValueError("no rows are left for training")
    ranked = with_rank(df, key, random_state if shuffle else None)
    return ranked.withColumn("part", F.when(F.col("rank") < n_train, "train").otherwise("test")).drop("rank", "total")


def train_test_split(df: DataFrame, key: str, test_size: float = 0.25, train_size: float | None = None, random_state: int = 42, shuffle: bool = True, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exact sizes; the same for the same seed."""
    if train_size is not None or stratify is not None:
        raise ValueError("train_size and stratify are not supported")
    parts = assign_split(df, key, test_size, random_state, shuffle)
    return tuple(parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))


class KFold(Estimator):
    """Folds of consecutive rows of the order of a unique key, or of its hash; the first ones are larger by one."""

    def __init__(self, key: str, n_splits: int = 5, shuffle: bool = False, random_state: int = 0):
        self.key, self.n_splits, self.shuffle, self.random_state = key, n_splits, shuffle, random_state

    def get_n_splits(self) -> int:
        return self.n_splits

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with ``fold`` from 0: the fold whose test set has the row."""
        ranked = with_rank(df, self.key, self.random_state if self.shuffle else None)
        size, extra = F.floor(F.col("total") / self.n_splits), F.col("total") % self.n_splits
        long = extra * (size + 1)
        fold = F.when(F.col("rank") < long, F.floor(F.col("rank") / (size + 1))).otherwise(extra + F.floor((F.col("rank") - long) / F.nullif(size, F.lit(0))))
        return ranked.withColumn("fold", fold.cast("bigint")).drop("rank", "total")

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        """(train, test) of each fold; ValueError, at the first one, if there are fewer rows than folds."""
        n = df.count()
        if self.n_splits > n:
            raise ValueError(f"{self.n_splits} folds of {n} rows")
        yield from _sides(self.assign(df), self.n_splits)


class StratifiedKFold(Estimator):
    """Deals each class's rows to folds 0, 1, 2, ... in turn, so every fold has its share of each class."""

    def __init__(self, key: str, target: str, n_splits: int = 5, shuffle: bool = False, random_state: int = 0):
        self.key, self.target, self.n_splits, self.shuffle, self.random_state = key, target, n_splits, shuffle, random_state

    def assign(self, df: DataFrame) -> DataFrame:
        ranked = with_rank(df, self.key, self.random_state if self.shuffle else None, [self.target])
        return ranked.withColumn("fold", (F.col("rank") % self.n_splits).cast("bigint")).drop("rank", "total")

    def split(self, df: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
        yield from _sides(self.assign(df), self.n_splits)


def _sides(folded: DataFrame, k: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    for f in range(k):
        yield tuple(folded.where(c).drop("fold") for c in (F.col("fold") != f, F.col("fold") == f))


def cross_validated_r2(df: DataFrame, feature: str, target: str, fold: str = "fold") -> DataFrame:
    """(fold, r2) of a one-feature least-squares line for each fold, trained on the others.

    One aggregate by fold has all sums; a fold's training sums are the totals less its own.
    """
    x, y = F.col(feature).cast("double"), F.col(target).cast("double")
    # Shifted by the means, so that sums of squares do not cancel.
    means = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my")).first()
    dx, dy = x - F.lit(means["mx"]), y - F.lit(means["my"])
    sums = {"n": F.count(F.lit(1)).cast("double"), "sx": F.sum(dx), "sy": F.sum(dy), "sxx": F.sum(dx * dx), "sxy": F.sum(dx * dy), "syy": F.sum(dy * dy)}
    by = df.groupBy(fold).agg(*[v.alias(k) for k, v in sums.items()])
    total = by.agg(*[F.sum(k).alias(f"t_{k}") for k in sums])
    rows = by.crossJoin(F.broadcast(total))  # one row
    rest = {k: F.col(f"t_{k}") - F.col(k) for k in sums}
    slope = (rest["sxy"] - rest["sx"] * rest["sy"] / rest["n"]) / (rest["sxx"] - rest["sx"] * rest["sx"] / rest["n"])
    rows = rows.withColumns({"b": slope, "nr": rest["n"], "rx": rest["sx"], "ry": rest["sy"]}).withColumn("a", (F.col("ry") - F.col("b") * F.col("rx")) / F.col("nr"))
    residual = F.expr("syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx")
    spread = F.expr("syy - sy * sy / n")
    return rows.select(F.col(fold).alias("fold"), F.when(spread == 0, 1.0).otherwise(1 - residual / F.nullif(spread, F.lit(0.0))).alias("r2"))
