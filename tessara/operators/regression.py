"""Regression metrics as aggregate expressions, so that several share one pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _ratio(top: Column, below: Column, otherwise: float) -> Column:
    return F.when(below > 0, top / F.nullif(below, F.lit(0.0))).otherwise(F.lit(otherwise))


def mean_squared_error(y: Column | str, p: Column | str, weight: Column | str | None = None, squared: bool = True) -> Column:
    """Weighted mean of squared errors, or its root; 0 without weight."""
    w = _number(weight) if weight is not None else F.lit(1.0)
    d = _number(y) - _number(p)
    mean = _ratio(F.sum(w * d * d), F.sum(w), 0.0)
    return mean if squared else F.sqrt(mean)


def mean_absolute_error(y: Column | str, p: Column | str, weight: Column | str | None = None) -> Column:
    """Weighted mean of absolute errors; 0 without weight."""
    w = _number(weight) if weight is not None else F.lit(1.0)
    return _ratio(F.sum(w * F.abs(_number(y) - _number(p))), F.sum(w), 0.0)


def r2_score(y: Column | str, p: Column | str, weight: Column | str | None = None) -> Column:
    """1 - residual / total sum of squares; 1 where the total is 0, whatever the errors."""
    y, p = _number(y), _number(p)
    d = y - p
    if weight is None:
        residual, total = F.sum(d * d), F.count(y) * F.var_pop(y)
    else:
        w = _number(weight)
        residual = F.sum(w * d * d)
        # About the plain mean first: covariances are centred by Spark, so squares of large targets never cancel.
        n, mean = F.count(w * y), F.avg(F.when(w.isNotNull(), y))
        drift = n * F.covar_pop(w, y)
        total = n * F.covar_pop(w * y, y) - mean * drift - drift * drift / F.nullif(F.sum(F.when(y.isNotNull(), w)), F.lit(0.0))
    total = F.coalesce(total, F.lit(0.0))
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - residual / F.nullif(total, F.lit(0.0)))


def mean_absolute_percentage_error(y: Column | str, p: Column | str) -> Column:
    """Relative errors where the target is not 0, over the number of all rows; NaN without rows."""
    y, p = _number(y), _number(p)
    n = F.count(F.lit(1))
    total = F.sum(F.when(y != 0, F.abs((y - p) / F.nullif(y, F.lit(0.0)))).otherwise(F.lit(0.0)))
    return F.when(n > 0, total / F.nullif(n, F.lit(0))).otherwise(F.lit(float("nan")))


def explained_variance_score(y: Column | str, p: Column | str) -> Column:
    """1 - variance of the errors / variance of the target; 0 for a constant target, NaN without rows."""
    y, p = _number(y), _number(p)
    spread = F.var_pop(y)
    value = F.when(spread == 0, F.lit(0.0)).otherwise(1 - F.var_pop(y - p) / F.nullif(spread, F.lit(0.0)))
    return F.when(F.count(F.lit(1)) > 0, value).otherwise(F.lit(float("nan")))
