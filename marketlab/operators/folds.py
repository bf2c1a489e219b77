"""Leakage-safe splits and label uniqueness over horizons (event_id, t0, t1), closed intervals [t0, t1].

Splits need the rank of each label by t0. It is made without a window over one partition: counts of ranges of t0, a thousand and more in a large table, are
summed on the driver (a bounded number of rows), and ranks within a range are local.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES, MOST_RANGES, A_RANGE = 1024, 1 << 20, 1_000_000


def _width(low: int, high: int, n: int) -> int:
    """Of ranges of time: RANGES of them, and more if a range would hold over A_RANGE rows on average."""
    ranges = min(MOST_RANGES, max(RANGES, n // A_RANGE))
    return max(1, -(-(high - low + 1) // ranges))


def ranked(h: DataFrame) -> tuple[DataFrame, int]:
    """h with pos, the place from 0 in order of (t0, event_id), and the number of rows. Raises ValueError if a t1 is before its t0."""
    low, high, n, wrong = h.agg(F.min("t0"), F.max("t0"), F.count("*"), F.sum(F.when(F.col("t1") < F.col("t0"), 1).otherwise(0))).first()
    if wrong:
        raise ValueError(f"{wrong} labels end before they start")
    if not n:
        return h.withColumn("pos", F.lit(0).cast("long")), 0
    width = _width(low, high, n)
    keyed = h.withColumn("range", F.expr(f"(t0 - {low}) div {width}"))
    counts = keyed.groupBy("range").agg(F.count("*").alias("n")).toPandas().sort_values("range")  # at most MOST_RANGES rows
    counts["before"] = counts["n"].cumsum() - counts["n"]
    before = h.sparkSession.createDataFrame(counts[["range", "before"]].astype("int64"))
    w = Window.partitionBy("range").orderBy("t0", "event_id")
    return keyed.join(F.broadcast(before), "range").withColumn("pos", F.col("before") + F.row_number().over(w) - 1).drop("range", "before"), n


def _roles(rows: DataFrame, folds: list[tuple[int, list[tuple[int, int]]]], embargo: int, groups: list[list[int]] | None = None) -> DataFrame:
    """(fold, event_id, pos, role): role of every row in every fold. A fold is its number and its test blocks [start, stop) by pos.

    A row outside the blocks is purged if its interval meets the span of a block, embargoed if it is among the
    embargo rows after one, and train otherwise.
    """
    spark = rows.sparkSession
    blocks = sorted({b for _, bs in folds for b in bs})
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(blocks)], "block int, a long, b long")
    spans = (
        rows.join(F.broadcast(table), (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")))
        .groupBy("block").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi")).toPandas()  # one row a block
    )
    lo_hi = {int(r.block): (int(r.lo), int(r.hi)) for r in spans.itertuples()}
    number = {b: i for i, b in enumerate(blocks)}
    flat = [(fold, *b, *lo_hi[number[b]]) for fold, bs in folds for b in bs]
    each = spark.createDataFrame(flat, "fold int, a long, b long, lo long, hi long")
    # the fold table is small whatever the data: folds times test blocks
    state = F.when((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")), 3).when((F.col("t0") <= F.col("hi")) & (F.col("t1") >= F.col("lo")), 2).when((F.col("pos") >= F.col("b")) & (F.col("pos") < F.col("b") + embargo), 1).otherwise(0)
    wide = rows.join(F.broadcast(each)).select("fold", "event_id", "pos", state.alias("state"))
    worst = wide.groupBy("fold", "event_id", "pos").agg(F.max("state").alias("state")) if any(len(bs) > 1 for _, bs in folds) else wide
    return worst.select("fold", "event_id", "pos", F.element_at(F.array(F.lit("train"), F.lit("embargo"), F.lit("purged"), F.lit("test")), F.col("state") + 1).alias("role"))


def purged_kfold(h: DataFrame, n_splits: int = 5, embargo_pct: float = 0.01) -> DataFrame:
    """(fold, event_id, pos, role) of contiguous folds by t0."""
    rows, n = ranked(h)
    if n < n_splits:
        raise ValueError("fewer labels than folds")
    edges = [i * n // n_splits for i in range(n_splits + 1)]
    return _roles(rows, [(k, [(edges[k], edges[k + 1])]) for k in range(n_splits)], int(n * embargo_pct))


def cpcv_folds(h: DataFrame, n_groups: int = 6, n_test_groups: int = 2, embargo_pct: float = 0.01) -> DataFrame:
    """(fold, event_id, pos, role) for every choice of test groups; purge and embargo apply to each contiguous block."""
    rows, n = ranked(h)
    edges = [i * n // n_groups for i in range(n_groups + 1)]
    folds = []
    for fold, chosen in enumerate(combinations(range(n_groups), n_test_groups)):
        blocks: list[list[int]] = []
        for g in chosen:
            if blocks and blocks[-1][1] == edges[g]:
                blocks[-1][1] = edges[g + 1]
            else:
                blocks.append([edges[g], edges[g + 1]])
        folds.append((fold, [(a, b) for a, b in blocks]))
    return _roles(rows, folds, int(n * embargo_pct))


def n_splits(n_groups: int, n_test_groups: int) -> int:
    return comb(n_groups, n_test_groups)


def n_paths(n_groups: int, n_test_groups: int) -> int:
    return comb(n_groups - 1, n_test_groups - 1)


def cpcv_paths(spark, n_groups: int = 6, n_test_groups: int = 2) -> DataFrame:
    """(fold, grp, path): path p takes, for each group, the pth fold that tests it."""
    rows = [(f, g) for f, c in enumerate(combinations(range(n_groups), n_test_groups)) for g in c]
    w = Window.partitionBy("grp").orderBy("fold")
    return spark.createDataFrame(rows, "fold long, grp long").withColumn("path", (F.row_number().over(w) - 1).cast("long"))


def oos_paths(predictions: DataFrame, n_groups: int = 6, n_test_groups: int = 2) -> DataFrame:
    """(path, event_id, value) from predictions (fold, grp, event_id, value)."""
    paths = cpcv_paths(predictions.sparkSession, n_groups, n_test_groups)
    return predictions.join(F.broadcast(paths), ["fold", "grp"]).select("path", "event_id", "value")


def walk_forward(h: DataFrame, n_splits: int = 5, embargo_pct: float = 0.01, train_fraction: float = 0.3, embargo_units: str = "rows") -> DataFrame:
    """(fold, event_id, pos, role): folds tile what follows the first train_fraction; train rows are earlier and end, with
    the embargo added, before the fold's first t0. embargo_units rows adds the number of embargo rows to t1 as it is; time adds
    that share of the whole span."""
    rows, n = ranked(h)
    edges = np.linspace(int(n * train_fraction), n, n_splits + 1).astype(int).tolist()
    blocks = h.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(n_splits)], "fold int, a long, b long")
    first = rows.join(F.broadcast(blocks), (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b"))).groupBy("fold", "a", "b").agg(F.min("t0").alias("lo"))
    if embargo_units == "rows":
        gap = int(n * embargo_pct)
    else:
        low, high = h.agg(F.min("t0"), F.max("t1")).first()
        gap = int((high - low) * embargo_pct)
    role = F.when((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")), "test").when((F.col("pos") < F.col("a")) & (F.col("t1") + gap < F.col("lo")), "train")
    return rows.join(F.broadcast(first)).select("fold", "event_id", "pos", role.alias("role")).where("role is not null")


def concurrency(h: DataFrame) -> DataFrame:
    """(t, c): how many horizons cover each point of the grid of all t0 and t1.

    A sweep: +1 at t0, -1 after t1, summed in order, so no interval meets the grid in a join. Sums go by ranges of time first.
    """
    edges = h.select(F.col("t0").alias("t"), F.lit(1).alias("opens"), F.lit(0).alias("closes")).unionByName(h.select(F.col("t1").alias("t"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))
    grid = edges.groupBy("t").agg(F.sum("opens").alias("opens"), F.sum("closes").alias("closes"))
    return _running(grid, "opens", "closes")


def _ranges(grid: DataFrame) -> DataFrame:
    low, high, n = grid.agg(F.min("t"), F.max("t"), F.count("*")).first()
    width = _width(low or 0, high or 0, n)
    return grid.withColumn("range", F.expr(f"(t - {low or 0}) div {width}"))


def _running(grid: DataFrame, opens: str, closes: str) -> DataFrame:
    """Running sums over t, by ranges: sums of ranges are few, sums within a range are local."""
    g = _ranges(grid)
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = g.groupBy("range").agg(F.sum(F.col(opens) - F.col(closes)).alias("d")).withColumn("base", F.coalesce(F.sum("d").over(by_range), F.lit(0)))  # at most MOST_RANGES rows
    w = Window.partitionBy("range").orderBy("t")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("base") + F.sum(opens).over(upto) - F.coalesce(F.sum(closes).over(before), F.lit(0))
    return g.join(F.broadcast(sums.select("range", "base")), "range").select("t", c.alias("c"))


def average_uniqueness(h: DataFrame) -> DataFrame:
    """(event_id, u): the mean of 1 / concurrency over the grid points in the horizon, by prefix sums of 1 / c."""
    c = concurrency(h)
    g = _ranges(c.withColumn("inv", 1 / F.col("c")))
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = g.groupBy("range").agg(F.sum("inv").alias("s"), F.count("*").alias("k")).withColumn("base", F.coalesce(F.sum("s").over(by_range), F.lit(0.0))).withColumn("kbase", F.coalesce(F.sum("k").over(by_range), F.lit(0)))
    w = Window.partitionBy("range").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    prefix = g.join(F.broadcast(sums.select("range", "base", "kbase")), "range").select("t", "inv", (F.col("base") + F.sum("inv").over(w)).alias("p"), (F.col("kbase") + F.count("*").over(w)).alias("k"))
    a = prefix.select(F.col("t").alias("t0"), (F.col("p") - F.col("inv")).alias("p0"), (F.col("k") - 1).alias("k0"))
    b = prefix.select(F.col("t").alias("t1"), F.col("p").alias("p1"), F.col("k").alias("k1"))
    return h.join(a, "t0").join(b, "t1").select("event_id", ((F.col("p1") - F.col("p0")) / (F.col("k1") - F.col("k0"))).alias("u"))


def normalized_weights(weights: DataFrame) -> DataFrame:
    """weights (event_id, w) scaled to a mean of 1; all 1 if their sum is not positive."""
    total = weights.agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    return weights.join(F.broadcast(total)).select("event_id", F.when(F.col("s") > 0, F.col("w") * F.col("n") / F.col("s")).otherwise(1.0).alias("w"))
