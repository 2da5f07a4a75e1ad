"""Checks of inputs: structure from the schema, the rest from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import Features


def check_counts(df: DataFrame, features: str | Sequence[str], target: str | None = None) -> DataFrame:
    """One row: n_rows, n_null, min_width, max_width. NaN and infinities are no faults."""
    f = Features(features)
    f.require(df)
    names = [f.columns] if f.is_array else f.columns
    null = F.lit(False)
    for c in [*names, *([target] if target else [])]:
        null = null | F.col(c).isNull()
    if f.is_array:
        null = null | F.exists(F.col(f.columns), lambda v: v.isNull())
        width = F.size(F.col(f.columns))
    else:
        width = F.lit(len(names))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(null).alias("n_null"), F.coalesce(F.min(width), F.lit(0)).cast("bigint").alias("min_width"), F.coalesce(F.max(width), F.lit(0)).cast("bigint").alias("max_width"))


def check_array(df: DataFrame, features: str | Sequence[str], min_samples: int = 1, min_features: int = 1, target: str | None = None) -> DataFrame:
    """``df`` itself; ValueError for too few rows or features, unequal widths, or nulls."""
    r = check_counts(df, features, target).first()
    if r["n_rows"] < min_samples:
        raise ValueError(f"{r['n_rows']} rows; at least {min_samples} are needed")
    if r["n_null"]:
        raise ValueError(f"{r['n_null']} rows hold nulls")
    if r["min_width"] != r["max_width"]:
        raise ValueError(f"rows have {r['min_width']} to {r['max_width']} features")
    if r["min_width"] < min_features:
        raise ValueError(f"{r['min_width']} features; at least {min_features} are needed")
    return df


def check_xy(df: DataFrame, features: str | Sequence[str], target: str) -> DataFrame:
    """check_array, and no null targets; features and target share a row, so their numbers agree."""
    if target not in df.columns:
        raise ValueError(f"missing columns: {[target]}")
    return check_array(df, features, target=target)


def num_features(df: DataFrame, features: str | Sequence[str]) -> int:
    return Features(features).width(df)


def check_features_consistency(a: DataFrame, b: DataFrame, features_a: str | Sequence[str], features_b: str | Sequence[str] | None = None) -> None:
    """ValueError if the two have different numbers of features."""
    n, m = num_features(a, features_a), num_features(b, features_a if features_b is None else features_b)
    if n != m:
        raise ValueError(f"{n} features, but {m} in the other")


def as_doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def as_integers(c: Column | str) -> Column:
    """Towards zero; a number beyond 32 bits is an error."""
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda v: v.cast("int"))


def sample_weight(df: DataFrame, weight: str | None) -> Column:
    """The weight column, or 1 without one; ValueError if there is no such column."""
    if weight is None:
        return F.lit(1.0)
    if weight not in df.columns:
        raise ValueError(f"missing columns: {[weight]}")
    return F.col(weight).cast("double")
