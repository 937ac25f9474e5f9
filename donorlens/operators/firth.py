"""Logistic regression by Firth's penalised likelihood, finite also under separation.

The likelihood is penalised by half the log determinant of the information matrix.
The estimate solves ``sum x (y - p + h (1/2 - p)) = 0``, where ``h`` is a row's
leverage, ``p (1 - p) x' I^-1 x``. Two aggregates per step over the rows: the
information matrix (and the likelihood), then the score with the leverages that
follow from it. Each task sums its rows in Arrow batches; what reaches the driver
is one matrix and one vector of the number of columns, whatever the number of rows.

Columns are centred and scaled for the computation; the estimate does not depend
on it, so coefficients and their covariance are given on the original scale.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class FirthFit:
    """Coefficients (the intercept first) with their covariance, and how the fit ended."""

    names: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    penalised_log_likelihood: float
    iterations: int
    converged: bool


def _summed(rows: DataFrame, width: int, sums) -> np.ndarray:
    """``sums(x, y)``, a vector of ``width`` numbers, added up over all rows ``(x array<double>, y double)``."""
    def partial(batches):
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                total += sums(x, b.column(1).to_numpy(zero_copy_only=False))
        yield pa.record_batch([pa.array([total])], names=["s"])

    each = rows.mapInArrow(partial, "s array<double>").select(F.posexplode("s").alias("at", "v"))
    got = {r["at"]: r["v"] for r in each.groupBy("at").agg(F.sum("v").alias("v")).collect()}  # width rows
    return np.array([got.get(k, 0.0) for k in range(width)])


def _probability(eta: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(eta / 2))


def fit(rows: DataFrame, names: list[str], max_iter: int = 100, tolerance: float = 1e-9) -> FirthFit:
    """Fit on ``rows(x array<double>, y double)``; a constant column's coefficient is 0.

    A step is halved while it would lower the penalised likelihood. No row, or
    rows of one class, are no special case: the penalty keeps the estimate finite.
    """
    p, rows = len(names), rows.select("x", "y")
    s = _summed(rows, 1 + 2 * p, lambda x, y: np.r_[len(y), x.sum(0), (x * x).sum(0)])
    n = max(s[0], 1.0)
    mean = s[1:p + 1] / n
    # a second pass around the mean, so that large values cost no digits
    sd = np.sqrt(_summed(rows, p, lambda x, y: ((x - mean) ** 2).sum(0)) / n)
    used = sd > 1e-12 * np.maximum(np.abs(mean), 1)
    scale, k = np.where(used, sd, 1.0), int(used.sum()) + 1

    def design(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), ((x - mean) / scale)[:, used]])

    def state(beta: np.ndarray):
        """(penalised log likelihood, information matrix) at ``beta``."""
        def sums(x, y):
            z = design(x)
            eta = z @ beta
            w = _probability(eta) * _probability(-eta)
            loglik = (y * eta - np.logaddexp(0, eta)).sum()
            return np.r_[loglik, ((z * w[:, None]).T @ z).ravel()]

        got = _summed(rows, 1 + k * k, sums)
        info = got[1:].reshape(k, k)
        sign, logdet = np.linalg.slogdet(info)
        return (got[0] + logdet / 2 if sign > 0 else -np.inf), info

    def score(beta: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        def sums(x, y):
            z = design(x)
            prob = _probability(z @ beta)
            h = prob * (1 - prob) * np.einsum("ij,jk,ik->i", z, inverse, z)
            return z.T @ (y - prob + h * (0.5 - prob))

        return _summed(rows, k, sums)

    beta = np.zeros(k)
    value, info = state(beta)
    converged, steps = False, 0
    while s[0] and steps < max_iter and not converged and np.isfinite(value):
        steps += 1
        inverse = np.linalg.pinv(info)
        move = inverse @ score(beta, inverse)
        converged = bool(np.abs(move).max() < tolerance)
        for _ in range(30):
            new_value, new_info = state(beta + move)
            if converged or new_value >= value - 1e-10 * abs(value):
                break
            move /= 2
        beta, value, info = beta + move, new_value, new_info
    inner = np.linalg.pinv(info)
    # back to the original scale: beta_j / sd_j, and the intercept takes the means
    back = np.zeros((p + 1, k))
    back[0, 0] = 1
    for col, j in enumerate(np.flatnonzero(used), start=1):
        back[j + 1, col] = 1 / scale[j]
        back[0, col] = -mean[j] / scale[j]
    return FirthFit(["(Intercept)", *names], back @ beta, back @ inner @ back.T, float(value), steps, converged)
