"""Fractional differencing, stationarity and causality checks over series (asset, seq, value)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.functions.kernels import ffd, ffd_weights
from marketlab.functions.rolling import by_asset
from marketlab.functions.stats import adf_pvalue
from marketlab.operators import features as X

GRID = tuple(round(0.05 * i, 2) for i in range(1, 21))


def ffd_series(series: DataFrame, d: float, tol: float = 1e-5, longest: int = 512) -> DataFrame:
    """(asset, seq, value): fixed-width fractional differences; an asset's first len(weights) rows are dropped.

    Up to ``longest`` weights the sum is one expression over a frame; beyond it is a convolution per asset.
    """
    weights = ffd_weights(d, tol)
    n = len(weights)
    if n <= longest:
        w = by_asset()
        values = F.collect_list("value").over(w.rowsBetween(-(n - 1), 0))
        pairs = F.zip_with(values, F.array(*[F.lit(float(x)) for x in weights[::-1]]), lambda a, b: a * b)
        total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
        return series.withColumn("row", F.row_number().over(w)).select("asset", "seq", F.when(F.col("row") > n, total).alias("value")).where("value is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf.iloc[n:].assign(value=ffd(pdf["value"].to_numpy(float), d, tol)) if len(pdf) > n else pdf.iloc[:0]

    return series.select("asset", "seq", "value").groupBy("asset").applyInPandas(run, "asset string, seq long, value double")


def _adf(values: np.ndarray) -> float | None:
    try:
        return adf_pvalue(values)
    except ValueError:
        return None


def adf(series: DataFrame, *keys: str) -> DataFrame:
    """(keys, p_value): augmented Dickey-Fuller; null under 20 values."""
    keys = keys or ("asset",)
    kinds = dict(series.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), _adf(pdf.sort_values("seq")["value"].to_numpy(float))]], columns=[*keys, "p_value"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", p_value double"
    return series.select(*keys, "seq", "value").groupBy(*keys).applyInPandas(run, schema)


def find_optimal_d(series: DataFrame, grid: Sequence[float] = GRID, alpha: float = 0.05, tol: float = 1e-5) -> DataFrame:
    """(asset, d, p_value, chosen): every d of the grid, one task each, and which is the least that passes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, d = pdf.sort_values("seq"), float(pdf["d"].iloc[0])
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "d": [d], "p_value": [_adf(ffd(pdf["value"].to_numpy(float), d, tol))]})

    wide = series.select("asset", "seq", "value").withColumn("d", F.explode(F.array(*[F.lit(float(d)) for d in grid])))
    swept = wide.groupBy("asset", "d").applyInPandas(run, "asset string, d double, p_value double")
    best = swept.where(F.col("p_value") < alpha).groupBy("asset").agg(F.min("d").alias("best"))
    return swept.join(best, "asset", "left").select("asset", "d", "p_value", F.coalesce(F.col("d") == F.col("best"), F.lit(False)).alias("chosen"))


def stationarity_gate(features: DataFrame, alpha: float = 0.05, tol: float = 1e-5, fit_until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature columns made stationary, and a report (asset, feature, verdict, d): passed, rescued by differencing, or dropped.

    A constant column passes. fit_until: the last seq on which verdicts are based, so that they don't look ahead.
    The features come back long, (asset, seq, feature, value), differenced where rescued, without dropped ones.
    """
    names = [c for c in features.columns if c not in ("asset", "seq", "ts_us")]
    long = features.select("asset", "seq", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "value"))

    def verdict(x: np.ndarray) -> tuple[str, float | None]:
        if np.ptp(x) == 0 if len(x) else True:
            return "passed", None
        p = _adf(x)
        if p is not None and p < alpha:
            return "passed", None
        for d in GRID:
            p = _adf(ffd(x, d, tol))
            if p is not None and p < alpha:
                return "rescued", d
        return "dropped", None

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        fit = pdf if fit_until is None else pdf[pdf["seq"] <= fit_until]
        v, d = verdict(fit["value"].to_numpy(float))
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "feature": [pdf["feature"].iloc[0]], "verdict": [v], "d": [d]})

    report = long.groupBy("asset", "feature").applyInPandas(judge, "asset string, feature string, verdict string, d double")

    def change(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, d = pdf.sort_values("seq"), pdf["d"].iloc[0]
        if not pd.isna(d):
            x = ffd(pdf["value"].to_numpy(float), float(d), tol)
            pdf = pdf.iloc[len(pdf) - len(x) :].assign(value=x)
        return pdf[["asset", "seq", "feature", "value"]]

    kept = long.join(report.where("verdict <> 'dropped'"), ["asset", "feature"])
    return kept.groupBy("asset", "feature").applyInPandas(change, "asset string, seq long, feature string, value double"), report


def compute_features(
    bars: DataFrame, events: DataFrame | None = None, windows: Sequence[int] = X.WINDOWS, entropy: Sequence[int] = X.ENTROPY_WINDOWS, ffill_limit: int = 5, enforce: bool = True, alpha: float = 0.05, fit_until: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The feature matrix (asset, seq, ts_us, features), and the report of stationarity_gate(); no report without enforce.

    Features are built, filled and trimmed, made stationary or dropped, trimmed to the rows that all of an asset's
    features have, and judged once more on what is left: a feature that fails then is dropped too. A column is kept if any asset keeps it, and is null
    where an asset does not. events: only the rows of their bars are returned.
    """
    f = X.clean(X.raw_features(bars, windows, entropy), ffill_limit)
    report = None
    if enforce:
        long, report = stationarity_gate(f, alpha, fit_until=fit_until)
        kept = report.where("verdict <> 'dropped'").groupBy("asset").agg(F.count("*").alias("features"))
        whole = long.groupBy("asset", "seq").agg(F.count("value").alias("n")).join(kept, "asset").where(F.col("n") == F.col("features")).select("asset", "seq")
        long = long.join(whole, ["asset", "seq"], "left_semi")
        fit = long if fit_until is None else long.where(F.col("seq") <= fit_until)
        spread = fit.groupBy("asset", "feature").agg((F.max("value") - F.min("value")).alias("spread"))
        again = adf(fit, "asset", "feature").join(spread, ["asset", "feature"]).where((F.col("spread") > 0) & (F.col("p_value").isNull() | (F.col("p_value") >= alpha)))
        failed = again.select("asset", "feature", F.lit(True).alias("late"))
        report = report.join(failed, ["asset", "feature"], "left").select("asset", "feature", F.when(F.col("late"), "dropped").otherwise(F.col("verdict")).alias("verdict"), F.when(F.col("late").isNull(), F.col("d")).alias("d"))
        names = [c for c in f.columns if c not in ("asset", "seq", "ts_us")]
        wide = long.join(failed, ["asset", "feature"], "left_anti").groupBy("asset", "seq").pivot("feature", names).agg(F.first("value"))
        # a row for each feature
        stay = {r["feature"] for r in report.where("verdict <> 'dropped'").select("feature").distinct().collect()}
        f = f.select("asset", "seq", "ts_us").join(wide.select("asset", "seq", *[c for c in names if c in stay]), ["asset", "seq"])
    return (f if events is None else X.at_events(f, events)), report


def truncation_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(asset, hash): SHA-256 over the named columns of each asset in order of seq, for equality of whole series."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct("seq", row.alias("row"))))
    return df.groupBy("asset").agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["row"]), "\n"), 256).alias("hash"))


def leaks(full: DataFrame, truncated: DataFrame, until: int) -> DataFrame:
    """Rows (asset, seq) up to ``until`` on which a series built from all data and one built from its beginning differ."""
    both = full.where(F.col("seq") <= until).select("asset", "seq", F.col("value").alias("a")).join(
        truncated.where(F.col("seq") <= until).select("asset", "seq", F.col("value").alias("b")), ["asset", "seq"], "full_outer"
    )
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("asset", "seq")


def assert_no_leakage(full: DataFrame, truncated: DataFrame, until: int) -> None:
    """Raise AssertionError with the first row on which the two differ."""
    if row := leaks(full, truncated, until).orderBy("asset", "seq").first():
        raise AssertionError(f"series differ first at {row['asset']}, {row['seq']}")
