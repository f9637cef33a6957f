"""Seasonal-trend decomposition by LOESS (Cleveland et al., 1990) for one series."""

from __future__ import annotations

import numpy as np

_ROWS = 512  # evaluation points per block: bounds the weight matrix


def _fit(y, rw, at, left, q):
    """Local lines at positions ``at`` (1-based) over q points from ``left`` on.

    Returns the fit and whether any weight was left; robustness weights rw may be None.
    """
    n = len(y)
    span = min(q, n)
    reach = np.maximum(at - left, left + span - 1 - at).astype(float)
    if q > n:
        reach = reach + (q - n) // 2
    pos = left[:, None] + np.arange(span)[None, :]
    dist = np.abs(pos - at[:, None])
    w = np.where(dist <= 0.001 * reach[:, None], 1.0,
                 (1 - np.minimum(dist / reach[:, None], 1) ** 3) ** 3)
    w = np.where(dist <= 0.999 * reach[:, None], w, 0.0)
    if rw is not None:
        w = w * rw[pos - 1]
    total = w.sum(axis=1)
    ok = total > 0
    w = w / np.where(ok, total, 1)[:, None]
    centre = (w * pos).sum(axis=1)
    off = pos - centre[:, None]
    spread = (w * off * off).sum(axis=1)
    tilt = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / np.where(spread > 0, spread, 1), 0.0)
    return ((w * (1 + tilt[:, None] * off)) * y[pos - 1]).sum(axis=1), ok


def _left_edges(at, n, q):
    """First point of the q nearest ones, kept inside 1..n."""
    if q >= n:
        return np.ones(len(at), int)
    return np.clip(at - (q + 1) // 2 + 1, 1, n - q + 1).astype(int)


def loess(y: np.ndarray, q: int, rw=None) -> np.ndarray:
    n = len(y)
    if n < 2:
        return y.copy()
    out = np.empty(n)
    for start in range(0, n, _ROWS):
        at = np.arange(start + 1, min(start + _ROWS, n) + 1)
        fit, ok = _fit(y, rw, at, _left_edges(at, n, q), q)
        out[start:start + len(at)] = np.where(ok, fit, y[at - 1])
    return out


def _cycle_subseries(y, period, q, rw):
    """Smooth each phase and extend it by one period at both ends."""
    n = len(y)
    out = np.empty(n + 2 * period)
    for phase in range(period):
        part = y[phase::period]
        weights = None if rw is None else rw[phase::period]
        k = len(part)
        smooth = loess(part, q, weights)
        ends = np.array([0, k + 1])
        left = np.array([1, max(1, k - q + 1)])
        fit, ok = _fit(part, weights, ends, left, q)
        fit = np.where(ok, fit, smooth[[0, -1]])
        out[phase::period] = np.concatenate((fit[:1], smooth, fit[1:]))
    return out


def _mean_of(y, width):
    total = np.concatenate(([0.0], np.cumsum(y)))
    return (total[width:] - total[:-width]) / width


def _robustness(resid):
    r = np.abs(resid)
    limit = 6 * np.median(r)
    if limit == 0:
        return np.ones_like(r)
    w = (1 - np.minimum(r / limit, 1) ** 2) ** 2
    return np.where(r <= 0.001 * limit, 1.0, np.where(r <= 0.999 * limit, w, 0.0))


def _next_odd(x: float) -> int:
    k = int(np.ceil(x))
    return k if k % 2 else k + 1


def stl(y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True):
    """(trend, seasonal, residual) of a complete series of at least two periods."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * period:
        raise ValueError("a decomposition needs two full periods")
    trend_span = _next_odd(1.5 * period / (1 - 1.5 / seasonal))
    low_span = _next_odd(period + 1)
    trend, season, rw = np.zeros(n), np.zeros(n), None
    for outer in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            cycle = _cycle_subseries(y - trend, period, seasonal, rw)
            low = loess(_mean_of(_mean_of(_mean_of(cycle, period), period), 3), low_span)
            season = cycle[period:period + n] - low
            trend = loess(y - season, trend_span, rw)
        if robust and outer < 15:
            rw = _robustness(y - trend - season)
    return trend, season, y - trend - season
