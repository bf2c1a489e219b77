"""Bars: time, tick imbalance and tick run, and the choice among them. Input: ticks (asset, ts_us, tick_id, mid, bid_volume, ask_volume).

Output: asset, seq (from 1), ts_us, open, high, low, close, volume, n_ticks. Time bars are labelled by their start, the others by
their closing tick. An asset's ticks are ordered by (ts_us, tick_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.scans import BarMaker, scan

INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}


def seconds(interval: str) -> int:
    """Seconds of an interval such as 1m, 4h or 1d."""
    unit = {"s": 1, "m": 60, "h": 3600, "d": 86400}[interval[-1]]
    return int(interval[:-1]) * unit


def ohlcv(ticks: DataFrame, *keys: str) -> DataFrame:
    """One partial aggregate per key: nothing but sums, extremes and the first and last tick is shuffled."""
    at = F.struct("ts_us", "tick_id")
    return ticks.groupBy(*keys).agg(
        F.min_by("mid", at).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", at).alias("close"),
        F.sum(F.col("bid_volume") + F.col("ask_volume")).alias("volume"),
        F.count("*").alias("n_ticks"),
        F.max("ts_us").alias("last_us"),
    )


_ORDER = ("asset", "seq", "ts_us", "open", "high", "low", "close", "volume", "n_ticks")


def time_bars(ticks: DataFrame, interval: str = "1m") -> DataFrame:
    """Left-closed buckets aligned to the epoch; empty buckets give no bar."""
    width = seconds(interval) * 1_000_000
    start = F.col("ts_us") - F.pmod("ts_us", F.lit(width))
    bars = ohlcv(ticks.withColumn("start_us", start), "asset", "start_us").withColumnRenamed("start_us", "bar_us")
    w = Window.partitionBy("asset").orderBy("bar_us")
    return bars.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("ts_us", F.col("bar_us")).select(*_ORDER)


def _information_bars(ticks: DataFrame, kind: str, **options: float) -> DataFrame:
    """The recurrence makes the bars as an asset's ticks pass in order; ticks after the last closed bar give none."""
    src = ticks.select("asset", "ts_us", "tick_id", "mid", (F.col("bid_volume") + F.col("ask_volume")).alias("volume"))
    return scan(src, ["ts_us", "tick_id"], "asset string, seq long, ts_us long, open double, high double, low double, close double, volume double, n_ticks long", lambda: BarMaker(kind, **options))


def imbalance_bars(ticks: DataFrame, expected_ticks: float = 100, prob_buy: float = 0.5, alpha_t: float = 0.05, alpha_p: float = 0.05, min_threshold: float = 1) -> DataFrame:
    """A bar closes when |sum of signs| reaches max(E[T] |2P - 1|, min_threshold)."""
    return _information_bars(ticks, "imbalance", expected_ticks=expected_ticks, prob_buy=prob_buy, alpha_t=alpha_t, alpha_p=alpha_p, min_threshold=min_threshold)


def run_bars(ticks: DataFrame, expected_ticks: float = 100, prob_buy: float = 0.5, alpha_t: float = 0.05, alpha_p: float = 0.05, min_threshold: float = 1) -> DataFrame:
    """A bar closes when the more frequent sign reaches max(E[T] max(P, 1 - P), min_threshold)."""
    return _information_bars(ticks, "run", expected_ticks=expected_ticks, prob_buy=prob_buy, alpha_t=alpha_t, alpha_p=alpha_p, min_threshold=min_threshold)


def tick_signs(ticks: DataFrame) -> DataFrame:
    """(asset, ts_us, tick_id, sign): no change carries the last sign; the first is 1."""
    w = Window.partitionBy("asset").orderBy("ts_us", "tick_id")
    step = F.signum(F.col("mid") - F.lag("mid").over(w))
    known = ticks.select("asset", "ts_us", "tick_id", F.nullif(step, F.lit(0.0)).alias("s"))
    carried = F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return known.select("asset", "ts_us", "tick_id", F.coalesce(carried, F.lit(1.0)).cast("long").alias("sign"))


def log_returns(bars: DataFrame) -> DataFrame:
    """bars with ret, the log return of the close; null at the first bar."""
    w = Window.partitionBy("asset").orderBy("seq")
    return bars.withColumn("ret", F.log("close") - F.log(F.lag("close").over(w)))


def jarque_bera(returns: DataFrame, *keys: str, least: int = 10) -> DataFrame:
    """(keys, n, jb): n / 6 (S^2 + K^2 / 4) with population moments; null under ``least`` finite returns."""
    ok = returns.where(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") != float("inf")))
    jb = F.count("ret") / 6 * (F.pow(F.skewness("ret"), 2) + F.pow(F.kurtosis("ret"), 2) / 4)
    return ok.groupBy(*keys).agg(F.count("ret").alias("n"), F.when(F.count("ret") >= least, jb).alias("jb"))


def tournament(ticks: DataFrame, intervals: tuple[str, ...] = ("1m", "5m", "15m", "30m", "1h"), expected: tuple[float, ...] = (50, 100, 200, 400, 800), plateau_factor: float = 2.0) -> DataFrame:
    """The Jarque-Bera statistic of every candidate, whether it is stable, and its place: asset, bar_type, param, jb, stable, place.

    A candidate under 30 returns has none. It is stable if it has one and the neighbouring parameters of its type have one of at most
    plateau_factor times it. The winner (place 1) is the stable one of least statistic, or the least of all.
    """
    parts = [(time_bars(ticks, i), "time", float(seconds(i))) for i in intervals]
    parts += [(make(ticks, expected_ticks=e), name, float(e)) for make, name in ((imbalance_bars, "imbalance"), (run_bars, "run")) for e in expected]
    rows = None
    for bars, kind, param in parts:
        one = log_returns(bars.select("asset", "seq", "close")).select("asset", F.lit(kind).alias("bar_type"), F.lit(param).alias("param"), "ret")
        rows = one if rows is None else rows.unionByName(one)
    scored = rows.groupBy("asset", "bar_type", "param").agg(F.lit(1).alias("one")).drop("one").join(jarque_bera(rows, "asset", "bar_type", "param", least=30).drop("n"), ["asset", "bar_type", "param"], "left")
    near = Window.partitionBy("asset", "bar_type").orderBy("param")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (c <= plateau_factor * F.col("jb"))
    before, after = F.lag("jb").over(near), F.lead("jb").over(near)
    first, last = F.row_number().over(near) == 1, F.lead("param").over(near).isNull()
    stable = F.col("jb").isNotNull() & ~F.isnan("jb") & F.when(first, True).otherwise(fits(before)) & F.when(last, True).otherwise(fits(after))
    place = Window.partitionBy("asset").orderBy(F.col("stable").desc(), F.col("jb").asc_nulls_last(), "bar_type", "param")
    return scored.withColumn("stable", F.coalesce(stable, F.lit(False))).withColumn("place", F.row_number().over(place).cast("long"))
