"""Augmented Dickey-Fuller statistic from centred sums of products.

The regression is dy(t) on a constant, y(t-1) and dy(t-1)..dy(t-p). With the
columns in that order all lag choices are nested, so one Cholesky factor of one
Gram matrix gives the residual sum of squares of every lag.
"""

from __future__ import annotations

import math

import numpy as np

# Response-surface coefficients for the constant-only case, from
# MacKinnon (1994) for p-values and MacKinnon (2010) for critical values.
P_TAU_MIN, P_TAU_STAR, P_TAU_MAX = -18.83, -1.61, 2.74
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
CRITICAL = {
    1: (-3.43035, -6.5393, -16.786, -79.433),
    5: (-2.86154, -2.8903, -4.234, -40.040),
    10: (-2.56677, -1.5384, -2.809, 0.0),
}


def lag_limit(n: int) -> int:
    """Largest lag tried for n points; negative when the series is too short."""
    return min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2)


def lag_rows(y: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Columns y(t-1), dy(t-1)..dy(t-lags), dy(t) for t = start .. len(y)-1."""
    dy = np.diff(y)
    stop = len(y)
    cols = [y[start - 1 : stop - 1]]
    cols += [dy[start - 1 - k : stop - 1 - k] for k in range(1, lags + 1)]
    cols.append(dy[start - 1 : stop - 1])
    return np.column_stack(cols)


def sums(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    return len(rows), rows.sum(axis=0), rows.T @ rows


def centred(n: int, s: np.ndarray, ss: np.ndarray) -> np.ndarray:
    return ss - np.outer(s, s) / n


def _factor(gram: np.ndarray) -> np.ndarray | None:
    scale = np.sqrt(np.diag(gram))
    if not np.all(np.isfinite(scale)) or scale.min() <= 0:
        return None
    try:
        low = np.linalg.cholesky(gram[:-1, :-1] / np.outer(scale[:-1], scale[:-1]))
    except np.linalg.LinAlgError:
        return None
    # A pivot of rounding size means a column the others already explain.
    if np.diag(low).min() < 1e-7:
        return None
    return low


def best_lag(n: int, gram: np.ndarray, lags: int) -> int | None:
    """Lag with the smallest AIC on the common sample, the shorter one on ties."""
    low = _factor(gram)
    if low is None:
        return None
    scale = np.sqrt(np.diag(gram))
    part = np.linalg.solve(low, gram[:-1, -1] / scale[:-1])
    ssr = gram[-1, -1] - np.cumsum(part**2)[: lags + 1]
    if np.any(ssr <= gram[-1, -1] * 1e-14):
        return None
    aic = n * np.log(ssr / n) + 2.0 * (np.arange(lags + 1) + 2)
    return int(np.argmin(aic))


def t_of_level(n: int, gram: np.ndarray) -> float | None:
    """t value of y(t-1), the first column."""
    low = _factor(gram)
    params = len(gram)
    if low is None or n <= params:
        return None
    scale = np.sqrt(np.diag(gram))
    inverse = np.linalg.inv(low.T) @ np.linalg.inv(low)
    beta = inverse @ (gram[:-1, -1] / scale[:-1])
    ssr = gram[-1, -1] - beta @ (gram[:-1, -1] / scale[:-1])
    if ssr <= gram[-1, -1] * 1e-14:
        return None
    return float(beta[0] / math.sqrt(ssr / (n - params) * inverse[0, 0]))


def from_sums(
    n: int, s: np.ndarray, ss: np.ndarray, head: np.ndarray, lags: int
) -> tuple[float, int, int] | None:
    """(statistic, lag used, rows used) from the sums over t > lags and the first
    lags + 1 values, which the refit at a shorter lag brings back in."""
    if n < 1:
        return None
    p = best_lag(n, centred(n, s, ss), lags)
    if p is None:
        return None
    keep = [*range(p + 1), len(s) - 1]
    s, ss = s[keep], ss[np.ix_(keep, keep)]
    if p < lags:
        more, s1, ss1 = sums(lag_rows(head, p, p + 1))
        n, s, ss = n + more, s + s1, ss + ss1
    stat = t_of_level(n, centred(n, s, ss))
    return None if stat is None else (stat, p, n)


def adf(y: np.ndarray) -> tuple[float, int, int] | None:
    """(statistic, lag used, rows used) of a whole series, None if undefined."""
    n = len(y)
    lags = lag_limit(n)
    if n < 4 or lags < 0 or np.ptp(y) == 0:
        return None
    y = y - y.mean()
    return from_sums(*sums(lag_rows(y, lags, lags + 1)), y[: lags + 1], lags)


def p_value(stat: float) -> float:
    if stat > P_TAU_MAX:
        return 1.0
    if stat < P_TAU_MIN:
        return 0.0
    coef = P_SMALL if stat <= P_TAU_STAR else P_LARGE
    z = sum(c * stat**k for k, c in enumerate(coef))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def critical_value(percent: int, nobs: int) -> float:
    return sum(c / nobs**k for k, c in enumerate(CRITICAL[percent]))
