"""Errors and warnings. Bad arguments raise the built-in ValueError."""


class NotFittedError(ValueError):
    """An estimator was used before it was fitted."""


class ConvergenceWarning(UserWarning):
    """A solver stopped before it converged."""


class DataDimensionalityWarning(UserWarning):
    """The data's dimensions look wrong for the operation."""


class UndefinedMetricWarning(UserWarning):
    """A metric has no value for this input."""


class EfficiencyWarning(UserWarning):
    """The computation is not as efficient as it could be."""
