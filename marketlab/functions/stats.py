"""Distributions and tests that Spark has no expression for; small inputs on the driver or inside grouped kernels."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

GAMMA = 0.5772156649015329
_N = NormalDist()


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by Gauss-Legendre quadrature of the density from 0 to x; 0 or 1 beyond 8.5."""
    x = np.asarray(x, float)
    half = np.clip(x, -8.5, 8.5)[..., None] / 2
    at = half * (_NODES + 1)
    area = (np.exp(-0.5 * at * at) * _WEIGHTS).sum(axis=-1) * half[..., 0] / math.sqrt(2 * math.pi)
    return np.clip(0.5 + area, 0.0, 1.0)


def bet_sizes(p: np.ndarray) -> np.ndarray:
    """bet_size() of many probabilities; 0 for NaN."""
    p = np.asarray(p, float)
    q = np.clip(np.where(np.isnan(p), 0.5, p), 1e-5, 1 - 1e-5)
    return np.where(q > 0.5, 2 * normal_cdf((q - 0.5) / np.sqrt(q * (1 - q))) - 1, 0.0)


def expected_max_sharpe(n_trials: int, std: float, mean: float = 0.0) -> float:
    """Expected maximum of n_trials normal Sharpe ratios."""
    if n_trials < 2:
        return mean
    a, b = _N.inv_cdf(1 - 1 / n_trials), _N.inv_cdf(1 - 1 / (n_trials * math.e))
    return mean + std * ((1 - GAMMA) * a + GAMMA * b)


def deflated_sharpe(n: int, sharpe: float, skew: float, kurtosis: float, n_trials: int, std_of_trials: float, min_trials: int = 30) -> float:
    """Probability that the Sharpe ratio beats the expected maximum of the trials; 0 if there were too few trials."""
    if n_trials < min_trials:
        return 0.0
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    z = (sharpe - expected_max_sharpe(n_trials, std_of_trials)) / math.sqrt(max(spread, 1e-12) / (n - 1))
    return _N.cdf(z)


def bet_size(p: float) -> float:
    """2 Phi((p - 1/2) / sqrt(p (1 - p))) - 1, or 0 for p of a half or less."""
    if not p > 0.5:
        return 0.0
    p = min(max(p, 1e-5), 1 - 1e-5)
    return 2 * _N.cdf((p - 0.5) / math.sqrt(p * (1 - p))) - 1


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2) if x > 0 else 0.0


def f_quantile(q: float, d1: float, d2: float) -> float:
    lo, hi = 0.0, 1.0
    while f_cdf(hi, d1, d2) < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f_cdf(mid, d1, d2) < q else (lo, mid)
    return (lo + hi) / 2


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    half = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return half if t >= 0 else 1 - half


# Response surface of the Dickey-Fuller distribution with a constant, one series (MacKinnon, 1994).
_TAU_MIN, _TAU_STAR, _TAU_MAX = -18.83, -1.61, 2.74
_TAU_SMALL = (2.1659, 1.4412, 0.038269)
_TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(t: float) -> float:
    if t > _TAU_MAX:
        return 1.0
    if t < _TAU_MIN:
        return 0.0
    c = _TAU_SMALL if t <= _TAU_STAR else _TAU_LARGE
    return _N.cdf(sum(w * t**k for k, w in enumerate(c)))


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ b
    return b, rest, float(rest @ rest)


def adf_pvalue(series: np.ndarray, maxlag: int | None = None) -> float:
    """Augmented Dickey-Fuller with a constant; the lag is chosen by AIC on a common sample. Under 20 values raise ValueError."""
    y = np.asarray(series, float)
    y = y[np.isfinite(y)]
    n = len(y)
    if n < 20:
        raise ValueError("at least 20 values are needed")
    if np.ptp(y) == 0:
        return 1.0
    if maxlag is None:
        maxlag = max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))
    dy = np.diff(y)

    def design(lag: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(skip, len(dy))
        return np.column_stack([y[rows], *(dy[rows - k] for k in range(1, lag + 1)), np.ones(len(rows))]), dy[rows]

    best, chosen = math.inf, 0
    for lag in range(maxlag + 1):
        x, z = design(lag, maxlag)
        _, _, ssr = _ols(x, z)
        m = len(z)
        aic = m * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / m) + 1) + 2 * x.shape[1]
        if aic < best:
            best, chosen = aic, lag
    x, z = design(chosen, chosen)
    b, _, ssr = _ols(x, z)
    s2 = ssr / (len(z) - x.shape[1])
    var = s2 * np.linalg.pinv(x.T @ x)[0, 0]
    return mackinnon_p(float(b[0]) / math.sqrt(var)) if var > 0 else 1.0


def shapiro_p(x: np.ndarray) -> float:
    """Shapiro-Wilk p-value by Royston's approximation (1995), for 12 values or more."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([_N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    # Royston's polynomials.
    a_n = m[-1] / math.sqrt(mm) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    a_m = m[-2] / math.sqrt(mm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_n**2 - 2 * a_m**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = a_n, a_m, -a_n, -a_m
    ss = float(((x - x.mean()) ** 2).sum())
    if ss <= 0:
        return 1.0
    w = min(float(a @ x) ** 2 / ss, 1 - 1e-15)
    ln = math.log(n)
    mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
    sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return 1 - _N.cdf((math.log(1 - w) - mu) / sigma)
