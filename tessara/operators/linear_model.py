"""Ordinary and ridge least squares: one aggregate of moments, a small solve on the driver, a lazy projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Estimator, RegressorMixin
from ..functions.linalg import add_diagonal, cholesky_solve
from ..functions.vectors import literal_array
from ..plans.moments import moments
from .features import Features
from .validation import check_xy

#: Added to the diagonal of the ordinary fit, as little as lets collinear features pass.
FLOOR = 1e-12


class _LeastSquares(RegressorMixin, Estimator):
    features: str | Sequence[str]
    target: str
    fit_intercept: bool

    def _solve(self, df: DataFrame, penalty: float) -> None:
        check_xy(df, self.features, self.target)
        m = moments(df, self.features, self.target, centred=self.fit_intercept)
        self.coef_ = cholesky_solve(add_diagonal(m.gram, penalty), m.cross)
        self.intercept_ = float(m.target_mean - self.coef_ @ m.mean) if self.fit_intercept else 0.0
        self.n_features_in_ = len(self.coef_)

    def expression(self) -> Column:
        """The prediction as an expression over the features."""
        self._check_is_fitted("coef_")
        features = Features(self.features)
        if features.is_array:
            terms = F.zip_with(features.checked(self.n_features_in_), literal_array(self.coef_), lambda x, c: x * c)
            return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v) + F.lit(self.intercept_)
        out = F.lit(self.intercept_)
        for name, c in zip(features.columns, self.coef_):
            out = out + F.col(name).cast("double") * F.lit(float(c))
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``prediction``; runs no job."""
        self._check_is_fitted("coef_")
        Features(self.features).require(df, self.n_features_in_)
        return df.withColumn("prediction", self.expression())


class LinearRegression(_LeastSquares):
    """Ordinary least squares. ``copy_X`` has no effect; ``positive`` is refused, as it would change the result."""

    def __init__(self, features: str | Sequence[str], target: str, fit_intercept: bool = True, copy_X: bool = True, positive: bool = False):
        self.features, self.target = features, target
        self.fit_intercept, self.copy_X, self.positive = fit_intercept, copy_X, positive

    def fit(self, df: DataFrame) -> LinearRegression:
        if self.positive:
            raise ValueError("positive=True is not supported")
        self._solve(df, FLOOR)
        self.rank_ = self.n_features_in_  # the number of features, not a numerical rank
        return self


class Ridge(_LeastSquares):
    """Least squares with ``alpha`` times the squared coefficients added; the intercept is not penalised.

    ``copy_X``, ``max_iter``, ``tol`` and ``solver`` have no effect: the solution is direct.
    """

    def __init__(self, features: str | Sequence[str], target: str, alpha: float = 1.0, fit_intercept: bool = True, copy_X: bool = True, max_iter: int = 1000, tol: float = 1e-4, solver: str = "auto"):
        self.features, self.target, self.alpha = features, target, alpha
        self.fit_intercept, self.copy_X, self.max_iter, self.tol, self.solver = fit_intercept, copy_X, max_iter, tol, solver

    def fit(self, df: DataFrame) -> Ridge:
        self._solve(df, self.alpha)
        self.n_iter_ = 1
        return self


def coefficients(model: _LeastSquares, df: DataFrame) -> DataFrame:
    """(term, coef) rows of a fitted model: the features, then ``intercept``."""
    model._check_is_fitted("coef_")
    names = [f"x{k}" for k in range(model.n_features_in_)] if isinstance(model.features, str) else list(model.features)
    rows = [(n, float(c)) for n, c in zip(names, np.asarray(model.coef_))]
    return df.sparkSession.createDataFrame([*rows, ("intercept", model.intercept_)], "term string, coef double")
