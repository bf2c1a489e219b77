"""Recurrences over the rows of an asset in order, a batch at a time: what is held is a batch and a state, however long the history."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from marketlab.functions.kernels import InformationBars, lz_complexity


def scan(df: DataFrame, order: list[str], schema: str, fresh: Callable[[], object], key: str = "asset") -> DataFrame:
    """Feed the rows of each key, in order, to the feed(frame) of a state of its own, which gives frames of schema.

    One exchange by key and one sort, which spills. A recurrence runs in the task that has its key; nothing is gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, None
        for pdf in batches:
            names = pdf[key].to_numpy()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(pdf)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if state is None or names[a] != now:
                    state, now = fresh(), names[a]
                out = state.feed(pdf.iloc[a:b])
                if len(out):
                    yield out

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class BarMaker:
    """Imbalance or run bars from ticks (asset, ts_us, tick_id, mid, volume): a row for each bar that closes."""

    def __init__(self, kind: str, **options: float):
        self.rule, self.seq, self.open = InformationBars(kind, **options), 0, None

    def feed(self, ticks: pd.DataFrame) -> pd.DataFrame:
        mid, volume = ticks["mid"].to_numpy(float), ticks["volume"].to_numpy(float)
        feed = self.rule.feed
        ends = [i for i, x in enumerate(mid.tolist()) if feed(x)]
        starts = [0, *(i + 1 for i in ends)]
        parts = []
        for a, b in zip(starts, [*(i + 1 for i in ends), len(mid)]):
            if a == b:
                continue
            part = [mid[a], mid[a:b].max(), mid[a:b].min(), mid[b - 1], float(volume[a:b].sum()), b - a]
            if self.open is not None:
                o = self.open
                part = [o[0], max(o[1], part[1]), min(o[2], part[2]), part[3], o[4] + part[4], o[5] + part[5]]
            self.open = part
            if b - 1 in ends[len(parts) : len(parts) + 1]:
                parts.append(part)
                self.open = None
        out = pd.DataFrame(parts, columns=["open", "high", "low", "close", "volume", "n_ticks"])
        out.insert(0, "asset", ticks["asset"].iloc[0])
        out.insert(1, "seq", np.arange(self.seq + 1, self.seq + 1 + len(parts)))
        out.insert(2, "ts_us", ticks["ts_us"].to_numpy()[ends])
        self.seq += len(parts)
        return out


class EwmStd:
    """Adds vol to rows with ret: the bias-corrected exponentially weighted deviation with recursive weights, of the rows before if causal."""

    def __init__(self, span: int, min_periods: int | None, causal: bool):
        self.alpha, self.least, self.causal = 2 / (span + 1), span if min_periods is None else min_periods, causal
        self.mean, self.cov, self.weight, self.squares, self.old, self.seen, self.before = math.nan, 0.0, 1.0, 1.0, 1.0, 0, math.nan

    def _next(self, x: float) -> float:
        a = self.alpha
        known = not math.isnan(x)
        self.seen += known
        if not math.isnan(self.mean):
            # a row without a return ages what came before
            self.weight, self.squares, self.old = self.weight * (1 - a), self.squares * (1 - a) ** 2, self.old * (1 - a)
            if known:
                mean = self.mean if self.mean == x else (self.old * self.mean + a * x) / (self.old + a)
                self.cov = (self.old * (self.cov + (self.mean - mean) ** 2) + a * (x - mean) ** 2) / (self.old + a)
                self.mean = mean
                total = self.old + a
                self.weight, self.squares, self.old = (self.weight + a) / total, (self.squares + a * a) / total**2, 1.0
        elif known:
            self.mean = x
        if self.seen < max(self.least, 1):
            return math.nan
        spread = self.weight**2 - self.squares
        return math.sqrt(self.weight**2 / spread * self.cov) if spread > 0 else math.nan

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        std = [self._next(x) for x in rows["ret"].to_numpy(float).tolist()]
        vol = [self.before, *std[:-1]] if self.causal else std
        self.before = std[-1]
        return rows.assign(vol=vol)


class Cusum:
    """Rows (asset, seq, ts_us, hit) where a symmetric CUSUM of ret breaches a multiple of vol, and both sums start anew."""

    def __init__(self, multiple: float):
        self.multiple, self.up, self.down = multiple, 0.0, 0.0

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        hits = np.zeros(len(rows), np.int32)
        for i, (r, v) in enumerate(zip(rows["ret"].to_numpy(float).tolist(), rows["vol"].to_numpy(float).tolist())):
            level = self.multiple * v
            if math.isnan(r) or math.isnan(level) or level <= 0:
                continue
            self.up, self.down = max(0.0, self.up + r), min(0.0, self.down + r)
            if self.up >= level or self.down <= -level:
                hits[i] = 1 if self.up >= level else -1
                self.up = self.down = 0.0
        return rows.assign(hit=hits).loc[hits != 0, ["asset", "seq", "ts_us", "hit"]]


class Entropies:
    """Adds x_bin{n} and x_lz{n} to rows with x_ret, for each window n.

    x_bin: the rank of the return among the n up to it, in bins from 0; null where there are fewer rows, the return is null or under two of them are
    known. x_lz: Lempel-Ziv complexity of the n bins before the row; null unless all are known. Held are the last returns and bins.
    """

    def __init__(self, windows: Sequence[int], bins: int):
        self.windows, self.bins = tuple(windows), bins
        self.values = np.zeros(0)
        self.texts = dict.fromkeys(self.windows, "")

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        # to 12 digits, so that ties don't hang on the last bit of a logarithm
        x = np.round(rows["x_ret"].to_numpy(float), 12)
        every, out = np.concatenate([self.values, x]), {}
        for n in self.windows:
            bins = np.full(len(x), -1, np.int64)
            first = max(0, n - 1 - len(self.values))
            if first < len(x):
                frames = np.lib.stride_tricks.sliding_window_view(every, n)[-(len(x) - first) :]
                own = x[first:]
                known = (~np.isnan(frames)).sum(axis=1)
                rank = (frames < own[:, None]).sum(axis=1)
                good = ~np.isnan(own) & (known >= 2)
                bins[first:] = np.where(good, np.minimum(rank * self.bins // np.maximum(known, 1), self.bins - 1), -1)
            # a letter for each bin, a dot for none
            text = self.texts[n] + "".join(chr(65 + k) if k >= 0 else "." for k in bins.tolist())
            before = len(self.texts[n])
            lz = [math.nan] * len(x)
            for i in range(len(x)):
                frame = text[max(0, before + i - n) : before + i]
                if len(frame) == n and "." not in frame:
                    lz[i] = lz_complexity(frame, self.bins)
            self.texts[n] = text[-n:]
            out[f"x_bin{n}"] = pd.Series(bins, index=rows.index).where(bins >= 0).astype("Int64")
            out[f"x_lz{n}"] = lz
        self.values = every[-(max(self.windows) - 1) :]
        return rows.assign(**out)
