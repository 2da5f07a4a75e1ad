"""Column builders and small dense linear algebra."""

from .linalg import add_diagonal, back_substitution, cholesky, cholesky_solve, forward_substitution
from .vectors import array_of, dot, euclidean_distance, log_logistic, norm, row_norms, softmax

__all__ = ["add_diagonal", "array_of", "back_substitution", "cholesky", "cholesky_solve", "dot", "euclidean_distance", "forward_substitution", "log_logistic", "norm", "row_norms", "softmax"]
