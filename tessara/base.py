"""The estimator protocol: parameters, fitted state, and score mix-ins."""

from __future__ import annotations

import inspect
from typing import Any

from pyspark.sql import DataFrame

from .errors import NotFittedError


class Estimator:
    """Parameters are the constructor's arguments; what fit() learns ends in an underscore."""

    @classmethod
    def _names(cls) -> list[str]:
        return [n for n, p in inspect.signature(cls.__init__).parameters.items() if n != "self" and p.kind not in (p.VAR_POSITIONAL, p.VAR_KEYWORD)]

    def get_params(self, deep: bool = True) -> dict[str, Any]:
        """Constructor parameters only; with ``deep``, estimators among them give their own."""
        values = {n: getattr(self, n) for n in self._names()}
        return {n: v.get_params() if deep and isinstance(v, Estimator) else v for n, v in values.items()}

    def set_params(self, **params: Any) -> Estimator:
        known = self._names()
        for name, value in params.items():
            if name not in known:
                raise ValueError(f"{type(self).__name__} has no parameter {name!r}; it has {known}")
            setattr(self, name, value)
        return self

    def _check_is_fitted(self, *attributes: str) -> None:
        check_is_fitted(self, attributes or None)


class ClassifierMixin:
    """score() is the accuracy of predict(); needs ``target``."""

    _estimator_type = "classifier"

    def score(self, df: DataFrame) -> float:
        from .operators.classification import accuracy_score

        return accuracy_score(self.predict(df), self.target, "prediction").first()["accuracy"]


class RegressorMixin:
    """score() is the R2 of predict(); needs ``target``."""

    _estimator_type = "regressor"

    def score(self, df: DataFrame) -> float:
        from .operators.regression import r2_score

        return self.predict(df).agg(r2_score(self.target, "prediction").alias("r2")).first()["r2"]


class TransformerMixin:
    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class ClusterMixin:
    _estimator_type = "clusterer"

    def fit_predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a column ``cluster``: from labels_ after fit, a function of the rows, or 0 without it."""
        from pyspark.sql import functions as F

        labels = getattr(self.fit(df), "labels_", None)
        return df.withColumn("cluster", F.lit(0) if labels is None else labels)


def clone(estimator: Estimator) -> Estimator:
    """A new, unfitted estimator with the same parameters."""
    return type(estimator)(**{n: clone(v) if isinstance(v, Estimator) else v for n, v in estimator.get_params(deep=False).items()})


def check_is_fitted(estimator: Estimator, attributes: tuple[str, ...] | list[str] | str | None = None) -> None:
    """NotFittedError if any of the attributes (by default: any that ends in an underscore) is missing."""
    if isinstance(attributes, str):
        attributes = [attributes]
    if attributes is None:
        fitted = [n for n, v in vars(estimator).items() if n.endswith("_") and not n.startswith("_") and v is not None]
        missing = not fitted
    else:
        missing = any(getattr(estimator, n, None) is None for n in attributes)
    if missing:
        raise NotFittedError(f"{type(estimator).__name__} is not fitted yet; call fit() first")
