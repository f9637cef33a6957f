"""Not-a-knot cubic interpolation, linear in the number of points."""

from __future__ import annotations

import numpy as np


def _second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = np.diff(x)
    slope = np.diff(y) / h
    # Continuity of the first derivative at inner points; the two end values are
    # eliminated by asking for one cubic over the first two and the last two spans.
    low, diag, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6 * np.diff(slope)
    first, last = h[0] / h[1], h[-1] / h[-2]
    diag[0] += h[0] * (1 + first)
    up[0] -= h[0] * first
    diag[-1] += h[-1] * (1 + last)
    low[-1] -= h[-1] * last
    # Plain floats: the two sweeps are sequential, and lists are faster element by element.
    lo, di, up_, r = low.tolist(), diag.tolist(), up.tolist(), rhs.tolist()
    for i in range(1, len(di)):
        w = lo[i] / di[i - 1]
        di[i] -= w * up_[i - 1]
        r[i] -= w * r[i - 1]
    r[-1] /= di[-1]
    for i in range(len(di) - 2, -1, -1):
        r[i] = (r[i] - up_[i] * r[i + 1]) / di[i]
    inner = np.array(r)
    head = (1 + first) * inner[0] - first * inner[1]
    tail = (1 + last) * inner[-1] - last * inner[-2]
    return np.concatenate(([head], inner, [tail]))


def cubic_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of the spline through at least four points (x ascending)."""
    curve = _second_derivatives(x, y)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    left, right = x[i + 1] - at, at - x[i]
    return ((curve[i] * left**3 + curve[i + 1] * right**3) / (6 * h)
            + (y[i] / h - curve[i] * h / 6) * left
            + (y[i + 1] / h - curve[i + 1] * h / 6) * right)
