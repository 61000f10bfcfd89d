"""Lag-selected unit-root test of one series by plain regressions: what the tests compare with."""

import numpy as np


def _ols(y: np.ndarray, X: np.ndarray):
    beta, _, rank, _ = np.linalg.lstsq(X, y, rcond=None)
    if rank < X.shape[1]:
        return None
    resid = y - X @ beta
    ssr = float(resid @ resid)
    nobs, k = X.shape
    llf = -nobs / 2.0 * (np.log(2 * np.pi) + np.log(ssr / nobs) + 1) if ssr > 0 else np.inf
    aic = -2 * llf + 2 * k
    dof = nobs - k
    if dof <= 0 or ssr <= 0:
        return beta, None, aic
    cov = ssr / dof * np.linalg.inv(X.T @ X)
    return beta, np.sqrt(np.diag(cov)), aic


def _lagged(x: np.ndarray, lags: int):
    """Rows t = lags+1..n-1: dx_t, [x_{t-1}, dx_{t-1}, ..., dx_{t-lags}]."""
    dx = np.diff(x)
    rows = len(dx) - lags
    y = dx[lags:]
    cols = [x[lags:lags + rows]]
    for j in range(1, lags + 1):
        cols.append(dx[lags - j:lags - j + rows])
    return y, np.column_stack(cols)


def adf_one(x: np.ndarray) -> tuple:
    """ADF with a constant, lag by AIC up to 12 (n/100)^(1/4): (stat, used_lag, nobs)."""
    n = len(x)
    maxlag = int(np.ceil(12.0 * (n / 100.0) ** 0.25))
    maxlag = max(0, min(n // 2 - 2, maxlag))
    # Lag choice on a common sample (the one the longest lag allows).
    y, Z = _lagged(x, maxlag)
    best, best_aic = 0, np.inf
    for lag in range(0, maxlag + 1):
        X = np.column_stack([np.ones(len(y)), Z[:, :lag + 1]])
        r = _ols(y, X)
        if r is not None and r[2] < best_aic:
            best, best_aic = lag, r[2]
    y, Z = _lagged(x, best)
    X = np.column_stack([Z, np.ones(len(y))])
    r = _ols(y, X)
    if r is None or r[1] is None or r[1][0] == 0:
        return None, best, len(y)
    return float(r[0][0] / r[1][0]), best, len(y)
