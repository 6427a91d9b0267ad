"""Special functions and one-dimensional solvers, in numpy."""

from __future__ import annotations

import numpy as np

# Normal quantiles at .95 and .975.
Z95 = 1.6448536269514722
Z975 = 1.959963984540054
LN2 = float(np.log(2.0))
MAX_LOG2_PTR = 4.0


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, np.float64)
    shift = np.zeros_like(x)
    while (small := x < 6).any():
        shift[small] -= 1 / x[small]
        x[small] += 1
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def rate_of_mean_distance(mean: np.ndarray, steps: int = 60) -> np.ndarray:
    """The log2 ratio r in (0, 4] at which the expected circular distance from the peak is `mean`.

    The density falls as 2**(-2 r d) over d in [0, 1/2], so that 2 E[d] = 1/(r ln 2) - 2**-r / (1 - 2**-r), which
    falls in r. Bisection; beyond 4 the result is 4, and at means of 1/4 and more it is near 0.
    """
    mean = np.asarray(mean, np.float64)
    low, high = np.full(mean.shape, 1e-9), np.full(mean.shape, MAX_LOG2_PTR)
    for _ in range(steps):
        r = (low + high) / 2
        over = 1 / (r * LN2) - np.exp2(-r) / -np.expm1(-r * LN2) > 2 * mean
        low, high = np.where(over, r, low), np.where(over, high, r)
    return (low + high) / 2


def slope_of_counts(counts: np.ndarray, bound: float = 64.0, steps: int = 80) -> float:
    """The log2 slope r at which counts along 0..1 are most likely under probabilities in proportion to 2**(r x).

    The likelihood is concave; at its top the mean of x under the counts is that under the probabilities.
    """
    counts = np.asarray(counts, np.float64)
    if len(counts) < 2 or not counts.sum() > 0:
        return float("nan")
    x = np.linspace(0, 1, len(counts))
    mean, low, high = (counts * x).sum() / counts.sum(), -bound, bound
    for _ in range(steps):
        r = (low + high) / 2
        p = np.exp2(r * x - max(r, 0.0))
        low, high = (r, high) if (p * x).sum() / p.sum() < mean else (low, r)
    return (low + high) / 2
