"""Sequential kernels: recurrences that no window frame expresses, over ordered NumPy arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def tick_signs(mid: np.ndarray) -> np.ndarray:
    """Sign of each price change; no change carries the last sign, and the first is +1."""
    s = np.sign(np.diff(mid, prepend=mid[:1]))
    last = np.maximum.accumulate(np.where(s != 0, np.arange(len(s)), -1))
    return np.where(last >= 0, s[np.maximum(last, 0)], 1.0)


class InformationBars:
    """State of tick imbalance or run bars; feed() returns whether a bar closes at this tick.

    The first tick of a series belongs to the first bar but adds no sign.
    """

    def __init__(self, kind: str, expected_ticks: float = 100.0, prob_buy: float = 0.5, alpha_t: float = 0.05, alpha_p: float = 0.05, min_threshold: float = 1.0):
        self.kind, self.t, self.p = kind, float(expected_ticks), float(prob_buy)
        self.alpha_t, self.alpha_p, self.floor = alpha_t, alpha_p, min_threshold
        self.buys = self.sells = self.ticks = 0
        self.last, self.sign = None, 1.0

    def feed(self, mid: float) -> bool:
        self.ticks += 1
        if self.last is None:
            self.last = mid
            return False
        if mid != self.last:
            self.sign = 1.0 if mid > self.last else -1.0
        self.last = mid
        if self.sign > 0:
            self.buys += 1
        else:
            self.sells += 1
        n = self.ticks
        if self.kind == "imbalance":
            theta, expected = abs(self.buys - self.sells), self.t * abs(2 * self.p - 1)
        else:
            theta, expected = max(self.buys, self.sells), self.t * max(self.p, 1 - self.p)
        if theta < max(expected, self.floor):
            return False
        self.t = self.alpha_t * n + (1 - self.alpha_t) * self.t
        self.p = self.alpha_p * (self.buys / n) + (1 - self.alpha_p) * self.p
        self.buys = self.sells = self.ticks = 0
        return True


def bar_ids(mid: np.ndarray, kind: str, **options: float) -> np.ndarray:
    """The bar of each tick, from 0; ticks after the last closed bar get -1."""
    state, out, bar = InformationBars(kind, **options), np.empty(len(mid), np.int64), 0
    for i, x in enumerate(mid.tolist()):
        out[i] = bar
        bar += state.feed(x)
    if len(out):
        out[out == bar] = -1
    return out


def ewm_std(x: np.ndarray, span: int, min_periods: int | None = None) -> np.ndarray:
    """Bias-corrected exponentially weighted deviation, recursive weights; NaN before min_periods values."""
    return pd.Series(x).ewm(span=span, adjust=False, min_periods=span if min_periods is None else min_periods).std().to_numpy()


def cusum(returns: np.ndarray, h: np.ndarray) -> np.ndarray:
    """1 or -1 where a symmetric CUSUM breaches h, and both sums start anew; else 0. Rows without return or threshold are passed over."""
    up = down = 0.0
    out = np.zeros(len(returns), np.int8)
    for i, (r, t) in enumerate(zip(returns.tolist(), h.tolist())):
        if math.isnan(r) or math.isnan(t) or t <= 0:
            continue
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up >= t:
            out[i], up, down = 1, 0.0, 0.0
        elif down <= -t:
            out[i], up, down = -1, 0.0, 0.0
    return out


def lz_phrases(s: list[int] | str) -> int:
    """Phrases of the Lempel-Ziv (1976) parse: each the shortest that does not occur in what precedes its last symbol."""
    text = s if isinstance(s, str) else "".join(chr(65 + x) for x in s)
    n, at, phrases = len(text), 0, 0
    while at < n:
        length = 1
        while at + length <= n and text.find(text[at : at + length], 0, at + length - 1) >= 0:
            length += 1
        phrases += 1
        at += length
    return phrases


def lz_complexity(s: list[int] | str, n_bins: int) -> float:
    """Phrases, and one more, as a share of what a random sequence of that length over n_bins symbols has."""
    return (lz_phrases(s) + 1) * math.log(len(s)) / (math.log(n_bins) * len(s))


def ffd_weights(d: float, tol: float = 1e-5, max_window: int = 100_000) -> np.ndarray:
    """Weights of fractional differencing, newest first, cut where they fall below tol."""
    if not 0 < d <= 1:
        raise ValueError("d must be in (0, 1]")
    out, w = [1.0], 1.0
    for k in range(1, max_window):
        w = -w * (d - k + 1) / k
        if abs(w) < tol:
            break
        out.append(w)
    return np.array(out)


def ffd(x: np.ndarray, d: float, tol: float = 1e-5) -> np.ndarray:
    """Fixed-width fractional difference; as many values are dropped as there are weights."""
    w = ffd_weights(d, tol)
    return np.convolve(x, w, "valid")[1:] if len(x) > len(w) else np.zeros(0)


def adf_lag0_tstat(y: np.ndarray) -> float:
    """t statistic of the lagged level in a regression of differences with a constant; -inf if degenerate."""
    x, dy = y[:-1] - y.mean(), np.diff(y)
    n = len(x)
    sxx = float(((x - x.mean()) ** 2).sum()) if n > 2 else 0.0
    if sxx < 1e-12:
        return -math.inf
    b = float(((x - x.mean()) * (dy - dy.mean())).sum()) / sxx
    rest = dy - dy.mean() - b * (x - x.mean())
    s2 = float((rest**2).sum()) / (n - 2)
    return b / math.sqrt(s2 / sxx) if s2 > 1e-18 else -math.inf


def gsadf(y: np.ndarray, min_window_frac: float = 0.2) -> float:
    """Sup of the lag-0 ADF statistics over all windows of max(20, frac * n) values or more, by prefix sums."""
    n = len(y)
    least = max(20, int(min_window_frac * n))
    if n < least or float(np.var(y)) < 1e-10:
        return 0.0
    y = y - y.mean()
    x, d = y[:-1], np.diff(y)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (x, d, x * x, x * d, d * d)]
    best = -math.inf
    for first in range(0, n - least + 1):
        last = np.arange(first + least - 1, n)  # pairs first .. last - 1
        m = (last - first).astype(float)
        sx, sd, sxx, sxd, sdd = (s[last] - s[first] for s in sums)
        vxx, vxd, vdd = sxx - sx * sx / m, sxd - sx * sd / m, sdd - sd * sd / m
        ok = (vxx > 1e-12) & (m > 2)
        b = np.where(ok, vxd / np.where(ok, vxx, 1), 0)
        s2 = (vdd - b * vxd) / np.maximum(m - 2, 1)
        ok &= s2 > 1e-18
        t = np.where(ok, b / np.sqrt(np.where(ok, s2, 1) / np.where(ok, vxx, 1)), -math.inf)
        best = max(best, float(t.max()))
    return best if best > -math.inf else 0.0
