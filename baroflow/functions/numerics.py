"""Small numpy helpers used inside tasks, on bounded inputs only."""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

# These helpers travel with the function that uses them, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def solve_tridiagonal(low: np.ndarray, diag: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Parallel cyclic reduction: every pass halves the coupling distance, all rows at once."""
    a, b, c, r = (np.array(v, dtype=np.float64) for v in (low, diag, up, rhs))
    n = len(b)
    a[0] = 0.0
    c[-1] = 0.0
    gap = 1
    while gap < n:
        left = np.zeros(n)
        right = np.zeros(n)
        left[gap:] = -a[gap:] / b[:-gap]
        right[:-gap] = -c[:-gap] / b[gap:]
        nb, nr = b.copy(), r.copy()
        na, nc = np.zeros(n), np.zeros(n)
        nb[gap:] += left[gap:] * c[:-gap]
        nb[:-gap] += right[:-gap] * a[gap:]
        nr[gap:] += left[gap:] * r[:-gap]
        nr[:-gap] += right[:-gap] * r[gap:]
        na[gap:] = left[gap:] * a[:-gap]
        nc[:-gap] = right[:-gap] * c[gap:]
        a, b, c, r = na, nb, nc, nr
        gap *= 2
    return r / b


def cubic_coefficients(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of ``y + b t + c t^2 + d t^3`` on each interval of an interpolating cubic.

    With m = y''/6 at the points, the interior rows are the usual continuity
    equations.  At each end the third derivative equals that of the cubic through the four
    outermost points (zero with three points).  The last entry continues the last cubic.
    """
    n = len(x)
    if n < 2:
        z = np.full(n, np.nan)
        return z, z, z
    h = np.diff(x)
    slope = np.diff(y) / h
    if n == 2:
        return np.repeat(slope, 2), np.zeros(2), np.zeros(2)
    low, diag, up, rhs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], up[1:-1] = h[:-1], h[1:]
    diag[1:-1] = 2.0 * (h[:-1] + h[1:])
    rhs[1:-1] = np.diff(slope)
    diag[0], up[0] = -h[0], h[0]
    diag[-1], low[-1] = -h[-1], h[-1]
    if n > 3:
        second = np.diff(slope) / (x[2:] - x[:-2])
        third = np.diff(second) / (x[3:] - x[:-3])
        rhs[0] = h[0] ** 2 * third[0]
        rhs[-1] = -(h[-1] ** 2) * third[-1]
    m = solve_tridiagonal(low, diag, up, rhs)
    b, c, d = np.empty(n), 3.0 * m, np.empty(n)
    b[:-1] = slope - h * (m[1:] + 2.0 * m[:-1])
    d[:-1] = np.diff(m) / h
    d[-1] = d[-2]
    b[-1] = slope[-1] + h[-1] * (m[-2] + 2.0 * m[-1])
    return b, c, d


def gamma_cdf(shape: np.ndarray, x: np.ndarray, upper: bool = False) -> np.ndarray:
    """Regularised lower incomplete gamma function P(shape, x), or 1 - P, elementwise."""
    a = np.asarray(shape, dtype=np.float64)
    x = np.asarray(x, dtype=np.float64)
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(x) & (a > 0)
    out[ok & (x <= 0)] = 1.0 if upper else 0.0
    kinds, back = np.unique(a[ok], return_inverse=True)
    lg = np.zeros(a.shape)
    lg[ok] = np.array([math.lgamma(v) for v in kinds])[back] if len(kinds) else 0.0
    small = ok & (x > 0) & (x < a + 1.0)
    large = ok & (x > 0) & ~small
    if small.any():
        s, z = a[small], x[small]
        term = 1.0 / s
        total = term.copy()
        k = s.copy()
        for _ in range(10000):
            k += 1.0
            term = term * z / k
            total += term
            if np.all(term <= total * 1e-16):
                break
        part = total * np.exp(-z + s * np.log(z) - lg[small])
        out[small] = 1.0 - part if upper else part
    if large.any():
        s, z = a[large], x[large]
        tiny = 1e-300
        b = z + 1.0 - s
        c = np.full(s.shape, 1.0 / tiny)
        d = 1.0 / b
        f = d.copy()
        for i in range(1, 10000):
            an = -i * (i - s)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            delta = c * d
            f *= delta
            if np.all(np.abs(delta - 1.0) < 1e-15):
                break
        part = np.exp(-z + s * np.log(z) - lg[large]) * f
        out[large] = part if upper else 1.0 - part
    return np.clip(out, 0.0, 1.0)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile; infinite at 0 and 1, missing for missing input.

    Rational starting value of about nine digits (published by P. J. Acklam), then one
    third-order correction, which squares away the remaining error.
    """
    # Coefficients, highest power first.
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01, 1.0]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00, 1.0]
    p = np.asarray(p, dtype=np.float64)
    out = np.full(p.shape, np.nan)
    out[p <= 0] = -np.inf
    out[p >= 1] = np.inf
    inside = (p > 0) & (p < 1)
    q = p[inside]
    tail = np.minimum(q, 1.0 - q)
    z = np.empty(q.shape)
    far = tail < 0.02425
    t = np.sqrt(-2.0 * np.log(tail[far]))
    z[far] = np.polyval(c, t) / np.polyval(d, t)
    u = tail[~far] - 0.5
    z[~far] = u * np.polyval(a, u * u) / np.polyval(b, u * u)
    # Lower-tail probability of z <= 0 through the incomplete gamma function.
    below = 0.5 * gamma_cdf(np.full(z.shape, 0.5), z * z / 2.0, upper=True)
    e = (below - tail) * math.sqrt(2.0 * math.pi) * np.exp(z * z / 2.0)
    z = z - e / (1.0 + z * e / 2.0)
    out[inside] = np.where(q <= 0.5, z, -z)
    return out
