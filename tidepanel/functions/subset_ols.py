"""Ridge/least-squares hold-out error of column subsets from product sums.

A product-sum matrix covers the columns 1, x_1 .. x_p, y. Any subset of the x
columns is then a sub-matrix, so scoring a subset never goes back to the rows.
"""

from __future__ import annotations

import numpy as np


def centre(products: np.ndarray) -> np.ndarray:
    """Products of x and y about their means (the constant is projected out)."""
    n = products[0, 0]
    return products[1:, 1:] - np.outer(products[0, 1:], products[0, 1:]) / n


def holdout_mse(train: np.ndarray, test: np.ndarray, columns: list[int], penalty: float) -> float:
    """Mean squared error on the test rows of a fit on the training rows.

    ``columns`` are 0-based x columns; the intercept carries no penalty.
    """
    n, m = train[0, 0], test[0, 0]
    if n < 1 or m < 1:
        return float("nan")
    c = centre(train)
    pick = np.asarray(columns, dtype=int)
    gram = c[np.ix_(pick, pick)] + penalty * np.eye(len(pick))
    beta = np.linalg.lstsq(gram, c[pick, -1], rcond=1e-12)[0] if len(pick) else np.zeros(0)
    intercept = (train[0, -1] - train[0, pick + 1] @ beta) / n
    full = np.concatenate([[intercept], beta])
    rows = np.concatenate([[0], pick + 1])
    fit = full @ test[np.ix_(rows, rows)] @ full - 2 * full @ test[rows, -1] + test[-1, -1]
    return float(max(fit, 0.0) / m)
