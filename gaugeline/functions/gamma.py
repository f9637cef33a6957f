"""Vectorised distribution functions for the standardised precipitation index."""

from __future__ import annotations

import math

import numpy as np


def _log_gamma(a: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.lgamma, a.tolist()), float, len(a))


def gamma_cdf(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(shape, x) for x >= 0."""
    a, x = np.broadcast_arrays(np.asarray(shape, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(x) & (a > 0) & (x >= 0)
    out[ok & (x == 0)] = 0.0
    work = ok & (x > 0)
    small = work & (x < a + 1)
    large = work & ~small
    with np.errstate(all="ignore"):
        if small.any():
            out[small] = _scale(a[small], x[small]) * _series(a[small], x[small])
        if large.any():
            out[large] = 1 - _scale(a[large], x[large]) * _fraction(a[large], x[large])
    return out


_STIRLING = 64.0   # from here on the asymptotic form has all digits


def _scale(a, x):
    """x^a e^-x / Gamma(a). Large shapes by Stirling's form, whose terms do not cancel."""
    far = (x - a) / a
    big = np.sqrt(a / (2 * np.pi)) * np.exp(-a * (far - np.log1p(far)) - 1 / (12 * a) + 1 / (360 * a ** 3) - 1 / (1260 * a ** 5))
    return np.where(a >= _STIRLING, big, np.exp(a * np.log(x) - x - _log_gamma(a)))


def _series(a, x):
    """Sum of x^k / (a (a+1) .. (a+k)). Terms fall from the start, as x < a + 1, so it always ends;
    values that have converged leave the loop."""
    out = np.empty_like(x)
    left = np.arange(len(x))
    term = 1 / a
    total, k = term.copy(), 0
    while len(left):
        k += 1
        term = term * x / (a + k)
        total = total + term
        done = np.abs(term) < np.abs(total) * 1e-17
        if not np.isfinite(term).all():
            raise ArithmeticError("the gamma series has left the range of doubles")
        out[left[done]] = total[done]
        left, a, x, term, total = (v[~done] for v in (left, a, x, term, total))
    return out


def _fraction(a, x):
    """Continued fraction of the upper part, evaluated from the front (Lentz), until it stands still."""
    tiny = 1e-300
    out = np.empty_like(x)
    left = np.arange(len(x))
    b = x + 1 - a
    c = np.full_like(x, 1 / tiny)
    d = 1 / b
    h, k = d.copy(), 0
    while len(left):
        k += 1
        step = -k * (k - a)
        b = b + 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + step / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if not np.isfinite(h).all():
            raise ArithmeticError("the continued fraction has left the range of doubles")
        done = np.abs(d * c - 1) < 4e-16
        out[left[done]] = h[done]
        left, a, b, c, d, h = (v[~done] for v in (left, a, b, c, d, h))
    return out


def normal_cdf(z: np.ndarray) -> np.ndarray:
    half = gamma_cdf(np.full(np.shape(z), 0.5), z * z / 2) / 2
    return np.where(z >= 0, 0.5 + half, 0.5 - half)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal: a rational start (Abramowitz and Stegun 26.2.23), then Newton steps."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    out[p <= 0], out[p >= 1] = -np.inf, np.inf
    ok = (p > 0) & (p < 1)
    q = np.minimum(p[ok], 1 - p[ok])
    t = np.sqrt(-2 * np.log(q))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    z = np.where(p[ok] < 0.5, -z, z)
    for _ in range(4):
        z = z - (normal_cdf(z) - p[ok]) * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
    out[ok] = z
    return out
