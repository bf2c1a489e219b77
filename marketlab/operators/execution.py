"""Bets, margin and a ledger: batches of signals sized together, dispatched in order of confidence, and the positions that follow."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions import stats
from marketlab.operators import validation as V

LEAST_TESTED = 20
MIN_MARGIN = 1e-9


def mixture(z: np.ndarray, steps: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, deviations) of two normals by expectation maximization, from the lower and upper half."""
    order = np.sort(z)
    half = len(z) // 2
    w, m = np.array([0.5, 0.5]), np.array([order[:half].mean(), order[half:].mean()])
    s = np.maximum(np.array([order[:half].std(), order[half:].std()]), 1e-3)
    last = -math.inf
    for _ in range(steps):
        dense = w * np.exp(-0.5 * ((z[:, None] - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) + 1e-300
        total = dense.sum(axis=1)
        share = dense / total[:, None]
        n = share.sum(axis=0)
        w, m = n / len(z), (share * z[:, None]).sum(axis=0) / n
        s = np.maximum(np.sqrt((share * (z[:, None] - m) ** 2).sum(axis=0) / n), 1e-3)
        now = float(np.log(total).sum())
        if now - last < tolerance * len(z):
            break
        last = now
    return w, m, s


def batch_sizes(p: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, bool, float]:
    """(sizes, whether a mixture was used, Shapiro-Wilk p-value) of a batch of probabilities; 0 at a half or less.

    With 20 active bets or more whose z scores are not normal at alpha, sizes come from a mixture of two normals instead of one.
    """
    active = p > 0.5
    sizes, value, mixed = np.zeros(len(p)), math.nan, False
    if not active.any():
        return sizes, mixed, value
    q = np.clip(p[active], 1e-5, 1 - 1e-5)
    z = (q - 0.5) / np.sqrt(q * (1 - q))
    if len(z) >= LEAST_TESTED and z.std() > 0:
        value = stats.shapiro_p(z)
        mixed = value < alpha
    if mixed:
        w, m, s = mixture(z)
        below = (w * stats.normal_cdf((z[:, None] - m) / s)).sum(axis=1)
    else:
        below = stats.normal_cdf(z)
    sizes[active] = np.clip(2 * below - 1, 0, 1)
    return sizes, mixed, value


def size_batches(signals: DataFrame, *keys: str, alpha: float = 0.05) -> DataFrame:
    """signals (keys, p) with size, used_mixture and shapiro_p; each batch is sized together, in one task. A null p is no bet; one outside [0, 1] raises."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf["p"].to_numpy(float)
        if ((p < 0) | (p > 1)).any():
            raise ValueError("probabilities must be in [0, 1]")
        known = ~np.isnan(p)
        sizes, mixed, value = batch_sizes(p[known], alpha)
        out = np.zeros(len(p))
        out[known] = sizes
        return pdf.assign(size=out, used_mixture=mixed, shapiro_p=value)

    names = ", ".join(f"`{n}` {t}" for n, t in signals.dtypes)
    return signals.groupBy(*keys).applyInPandas(run, f"{names}, size double, used_mixture boolean, shapiro_p double")


def execute_batch(signals: DataFrame, equity: float, committed: float = 0.0, c95: float = 1.0, buffer: float = 0.1, account: str = "account") -> DataFrame:
    """signals (account, batch, signal_id, asset, asset_class, side, p, price) with size, margin and status: filled, or skipped without margin.

    The most confident signals of an account take of its budget first, ties by signal_id. committed: margin of positions that are open already.
    """
    sized = size_batches(signals, account, "batch")
    risked = V.risk_margin(sized, "batch", F.desc("p"), "signal_id", equity=equity, c95=c95, buffer=buffer, committed=committed, account=account)
    return risked.withColumn("status", F.when(F.col("margin") > MIN_MARGIN, "filled").otherwise("skipped")).drop("max_leverage", "margin_fraction")


def ledger(orders: DataFrame) -> DataFrame:
    """orders (account, asset, seq, action open or close, side, size, price, margin) with entry_price, pnl and held, the margin held after each.

    An open replaces the position of its asset. A close realizes price - entry (long) or entry - price (short) times size; a close of nothing is null.
    """
    w = Window.partitionBy("account", "asset").orderBy("seq")
    opened = F.lag(F.when(F.col("action") == "open", F.struct("side", "size", "price", "margin"))).over(w)
    o = orders.withColumn("before", opened)
    sign = F.when(F.col("before.side") == "long", 1.0).otherwise(-1.0)
    close = (F.col("action") == "close") & F.col("before").isNotNull()
    o = o.withColumn("entry_price", F.when(close, F.col("before.price"))).withColumn("pnl", F.when(close, sign * (F.col("price") - F.col("before.price")) * F.col("before.size")))
    freed = F.coalesce(F.col("before.margin"), F.lit(0.0))
    change = F.when(F.col("action") == "open", F.col("margin") - freed).otherwise(-freed)
    return o.withColumn("held", F.sum(change).over(Window.partitionBy("account").orderBy("seq", "asset"))).drop("before")


def positions(orders: DataFrame) -> DataFrame:
    """(account, asset, side, size, entry_price, margin) of what is open after all orders."""
    last = orders.groupBy("account", "asset").agg(F.max_by(F.struct("action", "side", "size", "price", "margin"), "seq").alias("x")).where("x.action = 'open'")
    return last.select("account", "asset", "x.side", "x.size", F.col("x.price").alias("entry_price"), "x.margin")


def rehydrate(open_positions: DataFrame) -> DataFrame:
    """(account, n_open, committed): what an engine that starts anew has committed already."""
    return open_positions.groupBy("account").agg(F.count("*").alias("n_open"), F.sum("margin").alias("committed"))


def flatten(open_positions: DataFrame, prices: DataFrame) -> DataFrame:
    """(account, asset, side, size, entry_price, price, pnl): every position closed at prices (asset, price), at its entry where there is none."""
    p = open_positions.join(prices, "asset", "left").withColumn("price", F.coalesce("price", "entry_price"))
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    return p.select("account", "asset", F.when(F.col("side") == "long", "short").otherwise("long").alias("side"), "size", "entry_price", "price", (sign * (F.col("price") - F.col("entry_price")) * F.col("size")).alias("pnl"))
