"""Event detectors, volatility and triple-barrier labels over bars (asset, seq, ts_us, open, high, low, close, volume)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlab.functions.rolling import by_asset, correlation, rolling
from marketlab.functions.scans import Cusum, EwmStd, scan
from marketlab.operators.bars import log_returns

#: Detectors by family: bars -> events (asset, seq, ts_us, side).
DETECTORS: dict[str, Callable[..., DataFrame]] = {}
#: Other names of families, used by parameter grids.
ALIASES = {"bollinger": "bbands_meanrev", "donchian": "donchian_breakout"}


def register_alpha(family: str):
    """Register a detector; a name that is taken by another function raises ValueError."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if DETECTORS.get(family, f) is not f:
            raise ValueError(f"{family} is registered")
        DETECTORS[family] = f
        return f

    return add


def detector(family: str) -> Callable[..., DataFrame]:
    return DETECTORS[ALIASES.get(family, family)]


def ewm_volatility(bars: DataFrame, span: int = 100, min_periods: int | None = None, causal_shift: bool = True) -> DataFrame:
    """bars with ret and vol, the bias-corrected exponentially weighted deviation of log returns, shifted by one bar if causal."""

    src = log_returns(bars)
    out = ", ".join(f"`{n}` {t}" for n, t in [*src.dtypes, ("vol", "double")])
    vol = scan(src, ["seq"], out, lambda: EwmStd(span, min_periods, causal_shift))
    return vol.withColumn("vol", F.nanvl("vol", F.lit(None).cast("double"))).withColumn("ret", F.nanvl("ret", F.lit(None).cast("double")))


@register_alpha("cusum")
def cusum_events(bars: DataFrame, vol_span: int = 100, threshold_multiplier: float = 1.0) -> DataFrame:
    """Symmetric CUSUM of log returns against a multiple of their volatility."""

    with_vol = ewm_volatility(bars, vol_span).select("asset", "seq", "ts_us", "ret", "vol")
    hits = scan(with_vol, ["seq"], "asset string, seq long, ts_us long, hit int", lambda: Cusum(threshold_multiplier))
    return hits.select("asset", "seq", "ts_us", F.when(F.col("hit") > 0, "long").otherwise("short").alias("side"))


@register_alpha("bbands_meanrev")
def bollinger_events(bars: DataFrame, sma_span: int = 20, num_std: float = 2.0) -> DataFrame:
    """Crossings of bands over the sma_span closes before: below the lower one long, above the upper one short."""
    w = by_asset()
    mean, std = rolling(F.avg, F.col("close"), w, sma_span, 1), rolling(F.stddev_samp, F.col("close"), w, sma_span, 1)
    zone = bars.withColumn("below", F.coalesce(F.col("close") < mean - num_std * std, F.lit(False))).withColumn("above", F.coalesce(F.col("close") > mean + num_std * std, F.lit(False)))
    known = F.row_number().over(w) > sma_span + 1
    was = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    side = F.when(F.col("below") & ~was("below"), "long").when(F.col("above") & ~was("above"), "short")
    return zone.withColumn("side", F.when(known, side)).where("side is not null").select("asset", "seq", "ts_us", "side")


@register_alpha("donchian_breakout")
def donchian_events(bars: DataFrame, window: int = 20) -> DataFrame:
    """Breakouts of the channel of the window bars before; no repeat until the close is back inside or breaks the other way."""
    w = by_asset()
    top, low = rolling(F.max, F.col("high"), w, window, 1), rolling(F.min, F.col("low"), w, window, 1)
    state = F.when(F.col("close") > top, 1).when(F.col("close") < low, -1).otherwise(0)
    s = bars.withColumn("state", state)
    fired = s.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(0))).where("state <> 0 and state <> before")
    return fired.select("asset", "seq", "ts_us", F.when(F.col("state") > 0, "long").otherwise("short").alias("side"))


def merged_events(bars: DataFrame, families: tuple[str, ...] = ("cusum", "bbands_meanrev", "donchian_breakout"), **options: dict) -> DataFrame:
    """Events of all families, one per bar; the family named first wins. Adds plugin_family."""
    rows = None
    for rank, family in enumerate(families):
        one = detector(family)(bars, **options.get(family, {})).withColumns({"plugin_family": F.lit(family), "rank": F.lit(rank)})
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy("asset", "seq").orderBy("rank")
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "rank")


def triple_barrier(bars: DataFrame, events: DataFrame, vol_span: int = 100, profit_take: float = 1.0, stop_loss: float = 1.0, vertical_bars: int = 20, vol: DataFrame | None = None) -> DataFrame:
    """The first barrier that each event's next vertical_bars bars touch.

    Columns: asset, seq, ts_us, side, entry_price, upper_price, lower_price, barrier_hit (upper, lower, vertical), exit_seq, exit_us,
    exit_price, return_pct, signed_return, label. A bar that touches both barriers is a stop. Events without a positive
    volatility are skipped. return_pct is not signed by side; signed_return is. vol: (asset, seq, vol), by default ewm_volatility.

    Bars meet events through buckets of vertical_bars bars, so the join is an equi-join of at most two buckets for each event.
    """
    vol = (ewm_volatility(bars, vol_span) if vol is None else vol).select("asset", "seq", "vol")
    last = bars.groupBy("asset").agg(F.max("seq").alias("max_seq"))
    e = (
        events.join(bars.select("asset", "seq", F.col("close").alias("entry_price")), ["asset", "seq"])
        .join(vol.where("vol > 0"), ["asset", "seq"])
        .join(last, "asset")
        .select(
            "asset",
            "seq",
            "ts_us",
            "side",
            "entry_price",
            (F.col("entry_price") * (1 + profit_take * F.col("vol"))).alias("upper_price"),
            (F.col("entry_price") * (1 - stop_loss * F.col("vol"))).alias("lower_price"),
            F.least(F.col("seq") + vertical_bars, F.col("max_seq")).alias("end_seq"),
        )
    )
    bucket = lambda c: F.expr(f"({c}) div {vertical_bars}")
    path = bars.select("asset", F.col("seq").alias("b_seq"), F.col("ts_us").alias("b_us"), F.col("high").alias("b_high"), F.col("low").alias("b_low"), F.col("close").alias("b_close"), bucket("seq").alias("bucket"))
    keyed = e.withColumn("bucket", F.explode(F.sequence(bucket("seq"), bucket("end_seq"))))
    # an event on the last bar ends at once, at its own close
    met = keyed.join(path, ["asset", "bucket"]).where(((F.col("b_seq") > F.col("seq")) | (F.col("end_seq") == F.col("seq"))) & (F.col("b_seq") <= F.col("end_seq")) & (F.col("b_seq") >= F.col("seq")))
    up, down = F.col("b_high") >= F.col("upper_price"), F.col("b_low") <= F.col("lower_price")
    stop = F.when(F.col("side") == "long", "lower").otherwise("upper")
    inside = F.col("b_seq") > F.col("seq")
    hit = F.when(inside & up & down, stop).when(inside & up, "upper").when(inside & down, "lower")
    price = F.when(F.col("hit") == "upper", F.col("upper_price")).when(F.col("hit") == "lower", F.col("lower_price"))
    met = met.withColumn("hit", hit).withColumn("both", inside & up & down).withColumn("price", price)
    keys = ["asset", "seq", "ts_us", "side", "entry_price", "upper_price", "lower_price"]
    first = met.groupBy(*keys).agg(
        F.min(F.when(F.col("hit").isNotNull(), F.struct("b_seq", "b_us", "hit", "both", "price"))).alias("touch"),
        F.max(F.struct("b_seq", "b_us", "b_close")).alias("end"),
    )
    touched = F.col("touch").isNotNull()
    out = first.select(
        *keys,
        F.coalesce("touch.hit", F.lit("vertical")).alias("barrier_hit"),
        F.coalesce("touch.b_seq", "end.b_seq").alias("exit_seq"),
        F.coalesce("touch.b_us", "end.b_us").alias("exit_us"),
        F.coalesce("touch.price", "end.b_close").alias("exit_price"),
        F.when(touched & ~F.col("touch.both") & (F.col("touch.hit") == F.when(F.col("side") == "long", "upper").otherwise("lower")), 1).otherwise(0).alias("label"),
    )
    ret = F.try_divide(F.col("exit_price") - F.col("entry_price"), "entry_price")
    return out.withColumn("return_pct", ret).withColumn("signed_return", F.when(F.col("side") == "long", ret).otherwise(-ret))


def label_balance(labels: DataFrame) -> DataFrame:
    """(asset, n, n_positive, label_rate)."""
    return labels.groupBy("asset").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), F.avg("label").alias("label_rate"))


def max_correlation(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(max_abs_corr): the largest |correlation| of a signal (i, value) with existing ones (name, i, value); 0 if none has one."""
    pairs = existing.join(new.withColumnRenamed("value", "x"), "i")
    per = pairs.groupBy("name").agg(correlation("x", "value").alias("r"), F.count("*").alias("n")).where("n >= 2 and r is not null and not isnan(r)")
    return per.agg(F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("max_abs_corr"))


def is_orthogonal(new: DataFrame, existing: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(max_abs_corr, orthogonal): strictly below the threshold."""
    return max_correlation(new, existing).withColumn("orthogonal", F.col("max_abs_corr") < threshold)
