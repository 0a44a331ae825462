"""Cubic spline with not-a-knot ends, for one run of points inside a task."""

from __future__ import annotations

import numpy as np


def second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivative at each knot; a line for 2 knots, a parabola for 3."""
    n = len(x)
    h = np.diff(x)
    slope = np.diff(y) / h
    if n == 2:
        return np.zeros(2)
    if n == 3:
        return np.full(3, 2.0 * (slope[1] - slope[0]) / (h[0] + h[1]))
    lower, upper = h[:-1].copy(), h[1:].copy()
    main = 2.0 * (h[:-1] + h[1:])
    rhs = 6.0 * np.diff(slope)
    # Equal third derivative across the second and the last but one knot removes
    # the two end unknowns.
    left, right = h[0] / h[1], h[-1] / h[-2]
    main[0] += h[0] * (1.0 + left)
    upper[0] -= h[0] * left
    main[-1] += h[-1] * (1.0 + right)
    lower[-1] -= h[-1] * right
    for i in range(1, n - 2):
        f = lower[i] / main[i - 1]
        main[i] -= f * upper[i - 1]
        rhs[i] -= f * rhs[i - 1]
    m = np.empty(n)
    m[n - 2] = rhs[-1] / main[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (rhs[i] - upper[i] * m[i + 2]) / main[i]
    m[0] = (1.0 + left) * m[1] - left * m[2]
    m[-1] = (1.0 + right) * m[-2] - right * m[-3]
    return m


def evaluate(x: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Spline value at ``at``; the end pieces also serve outside the knots."""
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = at - x[i]
    first = (y[i + 1] - y[i]) / h - h * (2.0 * m[i] + m[i + 1]) / 6.0
    return y[i] + t * (first + t * (m[i] / 2.0 + t * (m[i + 1] - m[i]) / (6.0 * h)))


def fill_gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y with NaN replaced by the spline through the rest; fewer than two known
    points leave it as it is."""
    have = ~np.isnan(y)
    if have.all() or have.sum() < 2:
        return y
    kx, ky = x[have], y[have]
    out = y.copy()
    out[~have] = evaluate(kx, ky, second_derivatives(kx, ky), x[~have])
    return out
