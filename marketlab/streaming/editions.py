"""Streaming editions of the stateful operators. On a finished stream they give what the batch operators give."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketlab.functions.kernels import InformationBars
from marketlab.functions.scans import Cusum, EwmStd

#: Event payloads by channel, each with the envelope event_id, occurred_at, producer.
CHANNELS = {
    "bar_generated": "asset string, ts_us long, close double",
    "event_triggered": "asset string, ts_us long, side string, plugin_family string",
    "label_computed": "asset string, ts_us long, label int, return_pct double",
    "model_trained": "experiment_id string, asset string, family string, brier double",
    "strategy_validated": "experiment_id string, pbo double, dsr double, passed boolean",
    "bet_sized": "asset string, side string, probability double, size double",
    "order_dispatched": "asset string, side string, size double, margin double",
    "regime_break": "asset string, kind string, statistic double, critical double",
    "concept_drift": "experiment_id string, rho double",
    "approval": "experiment_id string, approved boolean, signer string",
    "emergency_flatten": "reason string, signer string",
    "heartbeat": "agent string, status string, metrics map<string,double>",
}


def decode(messages: DataFrame, channel: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a channel from messages (channel, value), and those whose value cannot be read."""
    schema = f"event_id string, occurred_at timestamp, producer string, {CHANNELS[channel]}"
    own = messages.where(F.col("channel") == channel).withColumn("x", F.from_json("value", schema))
    readable = F.col("x").isNotNull() & F.col("x.event_id").isNotNull()
    return own.where(readable).select("x.*"), own.where(~F.coalesce(readable, F.lit(False))).select("channel", "value")


def encode(rows: DataFrame, channel: str) -> DataFrame:
    """(channel, value) of rows that have the channel's columns and the envelope."""
    names = ["event_id", "occurred_at", "producer", *(c.split()[0] for c in CHANNELS[channel].split(", "))]
    return rows.select(F.lit(channel).alias("channel"), F.to_json(F.struct(*names)).alias("value"))


def stream_time_bars(ticks: DataFrame, interval: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of ticks (asset, ts timestamp, tick_id, mid, bid_volume, ask_volume); later ticks than ``late`` are dropped."""
    at = F.struct("ts", "tick_id")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("asset", F.window("ts", interval))
        .agg(F.min_by("mid", at).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", at).alias("close"), F.sum(F.col("bid_volume") + F.col("ask_volume")).alias("volume"), F.count("*").alias("n_ticks"))
        .select("asset", F.unix_micros(F.col("window.start")).alias("ts_us"), "open", "high", "low", "close", "volume", "n_ticks")
    )


_BAR = "asset string, seq long, ts_us long, open double, high double, low double, close double, volume double, n_ticks long"
_STATE = "t double, p double, buys long, sells long, ticks long, last double, sign double, seq long, open double, high double, low double, volume double"


def stream_information_bars(ticks: DataFrame, kind: str = "imbalance", **options: float) -> DataFrame:
    """Imbalance or run bars as ticks (asset, ts_us, tick_id, mid, bid_volume, ask_volume) arrive.

    Ticks of one micro-batch are put in order; batches must come in order of time. The state is the recurrence and the open bar.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule, seq, bar = InformationBars(kind, **options), 1, None
        if state.exists:
            rule.t, rule.p, rule.buys, rule.sells, rule.ticks, rule.last, rule.sign, seq, *bar = state.get
            bar = bar if rule.ticks else None
        pdf = pd.concat(list(frames)).sort_values(["ts_us", "tick_id"])
        out = []
        for r in pdf.itertuples():
            x, v = float(r.mid), float(r.bid_volume + r.ask_volume)
            bar = [x, x, x, v] if bar is None else [bar[0], max(bar[1], x), min(bar[2], x), bar[3] + v]
            n = rule.ticks + 1
            if rule.feed(x):
                out.append((key[0], seq, int(r.ts_us), bar[0], bar[1], bar[2], x, bar[3], n))
                seq, bar = seq + 1, None
        b = bar or [0.0, 0.0, 0.0, 0.0]
        state.update((rule.t, rule.p, rule.buys, rule.sells, rule.ticks, rule.last, rule.sign, seq, *b))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _BAR.split(", ")])

    return ticks.groupBy("asset").applyInPandasWithState(step, _BAR, _STATE, "append", GroupStateTimeout.NoTimeout)


_CUSUM_STATE = "up double, down double, last double, mean double, cov double, weight double, squares double, old double, seen long, before double"


def stream_cusum(bars: DataFrame, threshold: float | None = None, vol_span: int = 100, threshold_multiplier: float = 1.0) -> DataFrame:
    """CUSUM events of bars (asset, seq, ts_us, close) as they arrive in order, against a multiple of the volatility before each bar, as in the batch
    operator; or against a fixed threshold."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        vol, sums, last = EwmStd(vol_span, None, True), Cusum(threshold_multiplier), None
        if state.exists:
            sums.up, sums.down, last, vol.mean, vol.cov, vol.weight, vol.squares, vol.old, vol.seen, vol.before = state.get
        rows = pd.concat(list(frames)).sort_values("seq")
        log = np.log(rows["close"].to_numpy(float))
        rows = rows.assign(ret=np.diff(log, prepend=math.log(last) if last is not None else math.nan))
        rows = vol.feed(rows) if threshold is None else rows.assign(vol=threshold / threshold_multiplier)
        hits = sums.feed(rows)
        state.update((sums.up, sums.down, float(rows["close"].iloc[-1]), vol.mean, vol.cov, vol.weight, vol.squares, vol.old, int(vol.seen), vol.before))
        yield hits.assign(side=np.where(hits["hit"] > 0, "long", "short"))[["asset", "seq", "ts_us", "side"]]

    return bars.groupBy("asset").applyInPandasWithState(step, "asset string, seq long, ts_us long, side string", _CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)
