"""Spark-native analytics and machine-learning toolkit."""

from . import functions, operators, plans, sources, streaming
from .base import ClassifierMixin, ClusterMixin, Estimator, RegressorMixin, TransformerMixin, check_is_fitted, clone
from .errors import ConvergenceWarning, DataDimensionalityWarning, EfficiencyWarning, NotFittedError, UndefinedMetricWarning
from .operators import *  # noqa: F403
