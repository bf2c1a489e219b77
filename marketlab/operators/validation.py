"""Overfitting statistics, scores, plateaus, sizing and drift: aggregates and windows over small and large tables alike."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from marketlab.functions import stats
from marketlab.functions.rolling import correlation


RANGES = 1024


def average_rank(c: str, *keys: str) -> Column:
    """Rank from 1 within keys, ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2


def pbo(performance: DataFrame, epsilon: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """From (split, strategy, is_perf, oos_perf): per split (split, strategy, logit) of the best in sample, and (pbo, n_splits).

    Splits with a missing value are left out. The first strategy wins ties in sample.
    """
    bad = performance.where(F.col("is_perf").isNull() | F.col("oos_perf").isNull() | F.isnan("is_perf") | F.isnan("oos_perf")).select("split").distinct()
    p = performance.join(bad, "split", "left_anti")
    best = Window.partitionBy("split").orderBy(F.desc("is_perf"), "strategy")
    r = p.withColumns({"place": F.row_number().over(best), "rank": average_rank("oos_perf", "split"), "n": F.count("*").over(Window.partitionBy("split"))})
    share = F.least(F.greatest((F.col("rank") - 0.5) / F.col("n"), F.lit(epsilon)), F.lit(1 - epsilon))
    logits = r.where("place = 1").select("split", "strategy", F.log(share / (1 - share)).alias("logit"))
    return logits, logits.agg(F.avg(F.when(F.col("logit") <= 0, 1.0).otherwise(0.0)).alias("pbo"), F.count("*").alias("n_splits"))


def sharpe_moments(returns: DataFrame, *keys: str, annual: float = 252.0) -> DataFrame:
    """(keys, n, mean, std, sharpe, annual_sharpe, skew, kurtosis) of column ret: std with n - 1, moments of z scores by that std."""
    m = returns.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.skewness("ret").alias("g"), F.kurtosis("ret").alias("k"))
    shrink = (F.col("n") - 1) / F.col("n")
    flat = F.col("std") < 1e-12
    sharpe = F.when(~flat, F.col("mean") / F.col("std"))
    return m.select(*keys, "n", "mean", "std", sharpe.alias("sharpe"), (sharpe * annual**0.5).alias("annual_sharpe"), F.when(~flat, F.col("g") * F.pow(shrink, 1.5)).alias("skew"), F.when(~flat, (F.col("k") + 3) * F.pow(shrink, 2)).alias("kurtosis"))


def deflated_sharpe(returns: DataFrame, n_trials: int, std_of_trials: float, *keys: str, min_trials: int = 30) -> DataFrame:
    """(keys, sharpe, dsr, quarantined). std_of_trials has no default: it decides the result."""
    @pandas_udf("double")
    def dsr(n: pd.Series, sharpe: pd.Series, skew: pd.Series, kurt: pd.Series) -> pd.Series:
        return pd.Series([0.5 if pd.isna(s) else stats.deflated_sharpe(int(a), s, g, k, n_trials, std_of_trials, min_trials) for a, s, g, k in zip(n, sharpe, skew, kurt)])

    m = sharpe_moments(returns, *keys)
    return m.select(*keys, "sharpe", dsr("n", "sharpe", "skew", "kurtosis").alias("dsr"), F.lit(n_trials < min_trials).alias("quarantined"))


def bonferroni(alpha: float, n: int) -> float:
    return alpha / n


def holm(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p_values (name, p) with threshold and rejected: step-down, strict, stops at the first failure.

    Ranks come from the counts of 1,024 ranges of p and windows within a range; the first failure is a minimum over all, so no window holds every hypothesis.
    """
    keyed = p_values.withColumn("range", F.least(F.greatest(F.floor(F.col("p") * RANGES), F.lit(0)), F.lit(RANGES - 1)).cast("int"))
    counts = keyed.groupBy("range").agg(F.count("*").alias("n"))  # at most RANGES rows
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("m", F.sum("n").over(Window.partitionBy())).drop("n")
    w = Window.partitionBy("range").orderBy("p", "name")
    r = keyed.join(F.broadcast(placed), "range").withColumn("k", F.col("before") + F.row_number().over(w)).withColumn("threshold", alpha / (F.col("m") - F.col("k") + 1))
    first = r.agg(F.min(F.when(F.col("p") < F.col("threshold"), None).otherwise(F.col("k"))).alias("failed"))
    return r.join(F.broadcast(first)).select("name", "p", "threshold", (F.col("failed").isNull() | (F.col("k") < F.col("failed"))).alias("rejected"))


def scores(predictions: DataFrame, *keys: str, clip: float = 1e-6) -> DataFrame:
    """(keys, n, brier, log_loss, naive_brier) of (p, y); naive: the share of y as the prediction."""
    q = F.least(F.greatest("p", F.lit(clip)), F.lit(1 - clip))
    loss = -(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))
    share = F.avg(F.col("y").cast("double"))
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(loss).alias("log_loss"), (share * (1 - share)).alias("naive_brier"))


def plateau(surface: DataFrame, delta: float = 0.1, floor: float = 0.0, tie: float = 1e-9) -> DataFrame:
    """The centre of the widest stable neighbourhood of a score surface (i, j, score): (i, j, robust, component, best).

    robust is the least score of the full 3 x 3 neighbourhood; points without one, or with an invalid (null or -inf) neighbour, are
    not eligible. component: points within delta of the best robust score that are connected, counted over the few grid points.
    Ties go to the larger component, then the smaller i + j, then the smaller (i, j). No row if the best is below floor.
    """
    ok = surface.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") > float("-inf")))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    # each point tells its neighbours its score: an equi-aggregate, no self join
    told = ok.select(F.explode(steps).alias("s"), "i", "j", "score").select((F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "score")
    robust = told.groupBy("i", "j").agg(F.min("score").alias("robust"), F.count("*").alias("n")).where("n = 9").join(ok.select("i", "j"), ["i", "j"])
    rows = robust.select("i", "j", "robust").toPandas()  # a parameter grid: tens of points
    spark = surface.sparkSession
    schema = "i long, j long, robust double, component long, best boolean"
    if not len(rows):
        return spark.createDataFrame([], schema)
    top = rows["robust"].max()
    near = {(int(r.i), int(r.j)) for r in rows.itertuples() if r.robust >= top - delta}
    size: dict[tuple[int, int], int] = {}
    for p in near:
        if p not in size:
            seen, todo = {p}, [p]
            while todo:
                i, j = todo.pop()
                for q in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if q in near and q not in seen:
                        seen.add(q)
                        todo.append(q)
            size |= dict.fromkeys(seen, len(seen))
    tied = [r for r in rows.itertuples() if r.robust >= top - tie]
    best = min(tied, key=lambda r: (-size[(int(r.i), int(r.j))], r.i + r.j, r.i, r.j)) if top >= floor else None
    return spark.createDataFrame([(int(r.i), int(r.j), float(r.robust), size.get((int(r.i), int(r.j)), 0), best is not None and (r.i, r.j) == (best.i, best.j)) for r in rows.itertuples()], schema)


def bet_size(p: Column | str) -> Column:
    """Bet size of a probability; 0 at a half or less, and for null."""

    @pandas_udf("double")
    def size(p: pd.Series) -> pd.Series:
        return pd.Series(stats.bet_sizes(p.to_numpy(float)), index=p.index)

    return size(p)


#: Leverage by asset class.
LEVERAGE = {"fx": 30.0, "index": 20.0, "metal": 20.0, "crypto": 2.0}


def margin_fractions(spark: SparkSession) -> DataFrame:
    """(asset_class, max_leverage, margin_fraction)."""
    return spark.createDataFrame([(k, v, 1 / v) for k, v in LEVERAGE.items()], "asset_class string, max_leverage double, margin_fraction double")


def risk_margin(signals: DataFrame, *order: Column | str, equity: float, c95: float = 1.0, buffer: float = 0.1, committed: float = 0.0, account: str = "account") -> DataFrame:
    """signals (account, asset_class, size) with desired and margin: each takes what it wants of what is left of (1 - buffer) * equity.

    A running sum is exact: once a signal is cut, nothing is left for later ones.
    """
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    desired = F.col("size") / c95 * F.col("margin_fraction") * equity
    s = signals.join(F.broadcast(margin_fractions(signals.sparkSession)), "asset_class").withColumn("desired", F.greatest(desired, F.lit(0.0)))
    left = F.lit((1 - buffer) * equity - committed) - F.coalesce(F.sum("desired").over(w), F.lit(0.0))
    return s.withColumn("margin", F.greatest(F.lit(0.0), F.least("desired", left)))


def spearman(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, rho) of columns a and b; 0 if either is constant."""
    r = pairs.select(*keys, average_rank("a", *keys).alias("ra"), average_rank("b", *keys).alias("rb"))
    rho = correlation("ra", "rb")
    return r.groupBy(*keys).agg(F.coalesce(F.nanvl(rho, F.lit(0.0)), F.lit(0.0)).alias("rho"))


def concept_drift(pairs: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """spearman() of training and live importances with drift: below the threshold."""
    return spearman(pairs, *keys).withColumn("drift", F.col("rho") < threshold)


def chow(series: DataFrame, breakpoint_frac: float = 0.5) -> DataFrame:
    """(asset, n, breakpoint, f_stat): Chow's F for a break in the regression of changes on levels of series (asset, seq, value).

    Residual sums come from the moments of the pairs of each part: plain aggregates.
    """
    w = Window.partitionBy("asset").orderBy("seq")
    s = series.select("asset", "value", F.row_number().over(w).alias("row"), F.lead("value").over(w).alias("next"))
    n = s.groupBy("asset").agg(F.count("*").alias("n"), F.floor(F.count("*") * breakpoint_frac).alias("bp"), F.avg("value").alias("level"))
    s = s.join(n, "asset").select("asset", "n", "bp", "row", (F.col("value") - F.col("level")).alias("x"), (F.col("next") - F.col("value")).alias("d")).where("d is not null")
    # a pair of the first part ends within it
    first, second = F.col("row") < F.col("bp"), F.col("row") > F.col("bp")
    ssr = lambda ok: (lambda y, x: F.regr_syy(y, x) - F.coalesce(F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)), F.lit(0.0)))(F.when(ok, F.col("d")), F.when(ok, F.col("x")))
    a = s.groupBy("asset", "n", F.col("bp").alias("breakpoint")).agg(ssr(F.lit(True)).alias("pooled"), (ssr(first) + ssr(second)).alias("split"))
    return a.select("asset", "n", "breakpoint", F.try_divide((F.col("pooled") - F.col("split")) / 2, F.try_divide("split", F.col("n") - 4)).alias("f_stat"))


def chow_test(series: DataFrame, breakpoint_frac: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """chow() with critical and is_break."""
    @pandas_udf("double")
    def critical(n: pd.Series) -> pd.Series:
        return n.map({k: stats.f_quantile(1 - alpha, 2, k - 4) for k in n.unique()})

    return chow(series, breakpoint_frac).withColumn("critical", critical("n")).withColumn("is_break", F.col("f_stat") > F.col("critical"))


def oos_sharpe(folds: DataFrame, annual: Sequence[float] | float = 1.0) -> DataFrame:
    """(objective): the median over folds of mean / std * sqrt(periods a year) of bet * side * ret; folds of one event or no spread are left out."""
    r = F.col("bet") * F.col("side_sign") * F.col("ret")
    per = folds.groupBy("fold").agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s")).where("n >= 2 and s >= 1e-12")
    return per.agg(F.median(F.col("m") / F.col("s") * F.lit(float(annual) ** 0.5)).alias("objective"))


def signal_returns(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """predictions (p, ret) with strategy_ret: ret where p is above the threshold, else 0."""
    return predictions.withColumn("strategy_ret", F.when(F.col("p") > threshold, F.col("ret")).otherwise(0.0))
