"""Special functions in numpy: the incomplete beta function in log space."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def log_beta_inc(a, b, x) -> np.ndarray:
    """log of the regularised incomplete beta function I_x(a, b), at least -700, elementwise. By Lentz's continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0, -700.0, 0.0)
    inside = (x > 0) & (x < 1)
    a, b, x = a[inside], b[inside], x[inside]
    gamma = lambda v: np.array([math.lgamma(t) for t in v.tolist()])
    front = gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)
    near = x < (a + 1) / (a + b + 2)
    part = np.log(np.maximum(_fraction(np.where(near, a, b), np.where(near, b, a), np.where(near, x, 1 - x)), _TINY))
    low = np.maximum(-700.0, front + part - np.log(a))
    high = np.maximum(-700.0, np.log(np.maximum(-np.expm1(front + part - np.log(b)), _TINY)))
    out[inside] = np.where(near, low, high)
    return out


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    away = lambda v: np.where(np.abs(v) > _TINY, v, _TINY)
    c = np.ones_like(x)
    d = 1 / away(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + num * d)
            c = away(1 + num / c)
            h = h * c * d
        if not (np.abs(c * d - 1) >= 1e-14).any():
            break
    return h
