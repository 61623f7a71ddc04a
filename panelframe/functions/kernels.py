"""numpy kernels for what windows cannot express: recursive weights and regressions."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Windows handled in one round of numpy calls.
ROUND = 1 << 14


def decay(com=None, span=None, halflife=None, alpha=None) -> float:
    given = [x for x in (com, span, halflife, alpha) if x is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of com, span, halflife and alpha")
    if com is not None:
        if com < 0:
            raise ValueError("com must be at least 0")
        return 1 / (1 + com)
    if span is not None:
        if span < 1:
            raise ValueError("span must be at least 1")
        return 2 / (span + 1)
    if halflife is not None:
        if halflife <= 0:
            raise ValueError("halflife must be positive")
        return 1 - 0.5 ** (1 / halflife)
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return alpha


def ewm(values: np.ndarray, alpha: float, adjust: bool, ignore_na: bool, min_periods: int, bias: bool | None) -> np.ndarray:
    """Exponentially weighted mean (bias None) or variance, zero for a single value; missing rows stay missing."""
    weighted = pd.Series(values).ewm(alpha=alpha, adjust=adjust, ignore_na=ignore_na, min_periods=0)
    here = ~np.isnan(values)
    n = np.cumsum(here)
    out = weighted.mean().to_numpy() if bias is None else np.where(n == 1, 0.0, weighted.var(bias=bias).to_numpy())
    return np.where(here & (n >= max(min_periods, 1)), out, np.nan)


def rolling_rank(values: np.ndarray, window: int, least: int, share: bool) -> np.ndarray:
    """Average rank (or its share) of the last present value among the present values of each trailing window."""
    padded = np.concatenate((np.full(window - 1, np.nan), values))
    at = np.maximum.accumulate(np.where(np.isnan(padded), -1, np.arange(len(padded))))
    out = np.full(len(values), np.nan)
    for first in range(0, len(values), ROUND):  # bounds the memory of a long series
        view = np.lib.stride_tricks.sliding_window_view(padded[first : first + ROUND + window - 1], window)
        now = np.arange(first, first + len(view)) + window - 1
        last = np.where(at[now] > now - window, padded[at[now]], np.nan)[:, None]
        n = (~np.isnan(view)).sum(axis=1)
        rank = (view < last).sum(axis=1) + ((view == last).sum(axis=1) + 1) / 2
        out[first : first + len(view)] = np.where(n >= least, rank / np.maximum(n, 1) if share else rank, np.nan)
    return out


def residuals(y: np.ndarray, x: np.ndarray, intercept: bool) -> np.ndarray:
    """Least-squares residuals over the rows that are complete; others are missing."""
    out = np.full(len(y), np.nan)
    ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
    if ok.any():
        a = np.column_stack((np.ones(ok.sum()), x[ok])) if intercept else x[ok]
        out[ok] = y[ok] - a @ np.linalg.lstsq(a, y[ok], rcond=None)[0]
    return out


def _least_squares(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares of the least norm, for a stack of systems; rows of zeros do not count."""
    return (np.linalg.pinv(a, rcond=max(a.shape[1:]) * np.finfo(float).eps) @ y[..., None])[..., 0]


def _sums(a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turned = a.transpose(0, 2, 1)
    return turned @ a, (turned @ y[..., None])[..., 0]


def _ridge(alpha: float):
    def fit(a: np.ndarray, y: np.ndarray) -> np.ndarray:
        gram, target = _sums(a, y)
        free = np.arange(1, a.shape[2])  # the intercept has no penalty
        gram[:, free, free] += alpha
        singular = np.linalg.matrix_rank(gram, hermitian=True) < a.shape[2]
        out = np.empty_like(target)
        out[~singular] = np.linalg.solve(gram[~singular], target[~singular][..., None])[..., 0]
        out[singular] = (np.linalg.pinv(gram[singular], hermitian=True) @ target[singular][..., None])[..., 0]
        return out

    return fit


def _elastic(alpha: float, l1_ratio: float, max_iter: int, tolerance: float):
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)

    def fit(a: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cyclic coordinate descent on the Gram matrices, intercepts first; a system stops when its own steps are small."""
        gram, target = _sums(a, y)
        beta = np.zeros_like(target)
        beta[:, 0] = target[:, 0] / gram[:, 0, 0]
        going = np.arange(len(beta))
        for _ in range(max_iter):
            g, t, b = gram[going], target[going], beta[going]
            largest = np.zeros(len(going))
            for j in range(b.shape[1]):
                rho = t[:, j] - np.einsum("ij,ij->i", g[:, j], b) + g[:, j, j] * b[:, j]
                bottom = g[:, j, j] + (l2 if j else 0.0)
                top = np.sign(rho) * np.maximum(np.abs(rho) - l1, 0.0) if j else rho
                new = np.where(bottom != 0, top / np.where(bottom != 0, bottom, 1.0), np.nan)
                largest = np.fmax(largest, np.abs(new - b[:, j]))
                b[:, j] = new
            beta[going] = b
            going = going[largest > tolerance]
            if not len(going):
                break
        return beta

    return fit


FITS = {"ols": lambda: _least_squares, "ridge": _ridge, "elastic_net": _elastic}


def rolling_fit(y: np.ndarray, x: np.ndarray, window: int, fit) -> np.ndarray:
    """Prediction for each row from a fit (with intercept) on the complete rows among the window rows before it.

    The windows of many rows are one stack of systems; rows that are not complete are rows of zeros in it."""
    n, out = len(y), np.full(len(y), np.nan)
    usable = np.isfinite(x).all(axis=1)
    complete = usable & np.isfinite(y)
    a = np.column_stack((np.ones(n), np.where(usable[:, None], x, 0.0)))
    rows, right = np.where(complete[:, None], a, 0.0), np.where(complete, y, 0.0)
    seen = np.append(0, np.cumsum(complete))
    at = np.arange(window, n)
    at = at[usable[at] & (seen[at] > seen[at - window])]
    step = max(1, ROUND * 16 // (window * a.shape[1]))
    for first in range(0, len(at), step):
        now = at[first : first + step]
        which = now[:, None] - window + np.arange(window)
        out[now] = np.einsum("ij,ij->i", a[now], fit(rows[which], right[which]))
    return out
