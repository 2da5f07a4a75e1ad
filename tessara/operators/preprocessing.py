"""Scalers, the label encoder and the row normaliser: one aggregate to fit, a projection to apply."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..base import Estimator, TransformerMixin
from ..functions.vectors import array_of, let, norm
from ..plans.ranks import with_rank
from .features import Features

#: Classes up to which the encoder broadcasts them.
BROADCAST_CLASSES = 1_000_000


class StandardScaler(TransformerMixin, Estimator):
    """(x - mean) / standard deviation, with the n - 1 divisor; a constant column is divided by 1.

    ``copy`` is accepted and has no effect: a DataFrame never changes.
    """

    def __init__(self, columns: str | Sequence[str], copy: bool = True, with_mean: bool = True, with_std: bool = True):
        self.columns, self.copy, self.with_mean, self.with_std = columns, copy, with_mean, with_std

    def fit(self, df: DataFrame) -> StandardScaler:
        n, stats = Features(self.columns).statistics(df, {"mean": F.avg, "var": F.var_samp})
        if n < 1 or not stats:
            raise ValueError("at least one row and one feature are needed")
        self.n_samples_seen_, self.n_features_in_ = n, len(stats)
        self.mean_ = [float("nan") if s["mean"] is None else s["mean"] for s in stats]
        self.var_ = [0.0 if n == 1 else float("nan") if s["var"] is None else s["var"] for s in stats]
        self.scale_ = [1.0 if v == 0 or math.isnan(v) else math.sqrt(v) for v in self.var_]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_is_fitted("scale_")

        def apply(x, pick):
            x = x - pick(self.mean_) if self.with_mean else x
            return x / pick(self.scale_) if self.with_std else x

        return Features(self.columns).map(df, apply, self.n_features_in_)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._check_is_fitted("scale_")

        def apply(x, pick):
            x = x * pick(self.scale_) if self.with_std else x
            return x + pick(self.mean_) if self.with_mean else x

        return Features(self.columns).map(df, apply, self.n_features_in_)


class MinMaxScaler(TransformerMixin, Estimator):
    """Maps each column's range to ``feature_range``; NaN is left out of the range and stays NaN.

    A constant column becomes the lower end, and its inverse is 0: what it was is lost.
    """

    def __init__(self, columns: str | Sequence[str], feature_range: tuple[float, float] = (0.0, 1.0), copy: bool = True, clip: bool = False):
        self.columns, self.feature_range, self.copy, self.clip = columns, feature_range, copy, clip

    def fit(self, df: DataFrame) -> MinMaxScaler:
        low, high = self.feature_range
        if not low < high:
            raise ValueError("feature_range must rise")
        present = lambda f: lambda c: f(F.when(~F.isnan(c), c))
        n, stats = Features(self.columns).statistics(df, {"lo": present(F.min), "hi": present(F.max)})
        if n < 1 or not stats:
            raise ValueError("at least one row and one feature are needed")
        self.n_samples_seen_, self.n_features_in_ = n, len(stats)
        # A column without a number keeps the empty range of a minimum above its maximum.
        self.data_min_ = [math.inf if s["lo"] is None else s["lo"] for s in stats]
        self.data_max_ = [-math.inf if s["hi"] is None else s["hi"] for s in stats]
        self.data_range_ = [b - a for a, b in zip(self.data_min_, self.data_max_)]
        self.scale_ = [0.0 if r == 0 else (high - low) / r for r in self.data_range_]
        self.min_ = [low - s * a for s, a in zip(self.scale_, self.data_min_)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_is_fitted("scale_")
        low, high = (F.lit(float(v)) for v in self.feature_range)

        def apply(x, pick):
            y = x * pick(self.scale_) + pick(self.min_)
            return F.when(F.isnan(y), y).otherwise(F.greatest(F.least(y, high), low)) if self.clip else y

        return Features(self.columns).map(df, apply, self.n_features_in_)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        self._check_is_fitted("scale_")
        return Features(self.columns).map(df, lambda x, pick: F.when(pick(self.scale_) != 0, (x - pick(self.min_)) / F.nullif(pick(self.scale_), F.lit(0.0))).otherwise(F.lit(0.0)), self.n_features_in_)


class LabelEncoder(TransformerMixin, Estimator):
    """Labels to their place among the distinct labels in numeric order, and back."""

    def __init__(self, column: str, output: str | None = None):
        self.column, self.output = column, output

    def fit(self, df: DataFrame) -> LabelEncoder:
        """``classes_`` is a DataFrame (code, class), one row per label; non-integral labels are refused."""
        y = F.col(self.column)
        labels = df.select(y.alias("class")).where("class is not null").distinct()
        odd = labels.where(F.isnan(F.col("class").cast("double")) | (F.col("class").cast("double") != F.floor(F.col("class").cast("double"))))
        if not odd.isEmpty():
            raise ValueError("labels must be whole numbers")
        self.classes_ = with_rank(labels, "class").select(F.col("rank").cast("int").alias("code"), "class")
        self.n_classes_ = labels.count()
        return self

    def _lookup(self, df: DataFrame, given: str, wanted: str, what: str) -> DataFrame:
        self._check_is_fitted("classes_")
        table = self.classes_.select(F.col(given).alias("__given"), F.col(wanted).alias("__wanted"))
        if self.n_classes_ <= BROADCAST_CLASSES:
            table = F.broadcast(table)
        out = df.join(table, F.col(self.column) == F.col("__given"), "left")
        value = F.when(F.col("__wanted").isNull(), F.raise_error(F.concat(F.lit(what), F.coalesce(F.col(self.column).cast("string"), F.lit("null"))))).otherwise(F.col("__wanted"))
        return out.withColumn(self.output or self.column, value).drop("__given", "__wanted")

    def transform(self, df: DataFrame) -> DataFrame:
        return self._lookup(df, "class", "code", "unseen label: ")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._lookup(df, "code", "class", "no such code: ")


class Normalizer(TransformerMixin, Estimator):
    """Each row divided by its l1, l2 or max norm; a row of norm 0 stays as it is. Needs no fit."""

    def __init__(self, columns: str | Sequence[str], norm: str = "l2", copy: bool = True, output: str | None = None):
        self.columns, self.norm, self.copy, self.output = columns, norm, copy, output

    def fit(self, df: DataFrame) -> Normalizer:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Array columns give an array; number columns stay columns, unless ``output`` names an array."""
        features = Features(self.columns)
        features.require(df)
        x = array_of(self.columns)
        size = norm(x, self.norm)
        size = F.when(size == 0, F.lit(1.0)).otherwise(size)
        if features.is_array or self.output:
            return df.withColumn(self.output or self.columns, let(size, lambda s: F.transform(x, lambda v: v / s)))
        return df.withColumns({c: F.col(c).cast("double") / size for c in features.columns})
