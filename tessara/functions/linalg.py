"""Dense linear algebra on the driver, for matrices as large as the number of features."""

from __future__ import annotations

import numpy as np


def add_diagonal(a: np.ndarray, alpha: float) -> np.ndarray:
    return np.asarray(a, float) + alpha * np.eye(len(a))


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor of a positive semi-definite matrix, column by column.

    A pivot below 0 is taken as 0, and a pivot of 0 leaves its column 0.
    """
    a = np.asarray(a, float)
    lower = np.zeros_like(a)
    for k in range(len(a)):
        rest = a[k:, k] - lower[k:, :k] @ lower[k, :k]
        pivot = np.sqrt(max(rest[0], 0.0))
        lower[k, k] = pivot
        if pivot > 0:
            lower[k + 1 :, k] = rest[1:] / pivot
    return lower


def forward_substitution(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.zeros(len(b))
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(len(b)):
            x[k] = (b[k] - lower[k, :k] @ x[:k]) / lower[k, k]
    return x


def back_substitution(upper: np.ndarray, b: np.ndarray) -> np.ndarray:
    return forward_substitution(np.asarray(upper)[::-1, ::-1], np.asarray(b)[::-1])[::-1]


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with a x = b, for a symmetric positive semi-definite ``a``.

    Of a singular system, where a pivot is lost, the least-squares solution.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    lower = cholesky(a)
    diagonal = np.diag(lower)
    if len(a) and (diagonal <= 0).any():
        return np.linalg.lstsq(a, b, rcond=None)[0]
    return back_substitution(lower.T, forward_substitution(lower, b))
