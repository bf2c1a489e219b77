"""Structural breaks: GSADF with simulated critical values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions.kernels import gsadf
from marketlab.functions.trees import Forest
from marketlab.operators.validation import chow_test, concept_drift


def gsadf_statistic(series: DataFrame, min_window_frac: float = 0.2) -> DataFrame:
    """(asset, n, gsadf) of series (asset, seq, value); 0 for short or constant series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("seq")["value"].to_numpy(float)
        return pd.DataFrame({"asset": [pdf["asset"].iloc[0]], "n": [len(y)], "gsadf": [gsadf(y, min_window_frac)]})

    return series.select("asset", "seq", "value").groupBy("asset").applyInPandas(run, "asset string, n long, gsadf double")


def gsadf_critical(spark: SparkSession, n: int, simulations: int = 199, quantile: float = 0.95, seed: int = 0, min_window_frac: float = 0.2) -> DataFrame:
    """(critical): quantile of the statistic over Gaussian random walks of n steps, one row of work for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"stat": [gsadf(np.cumsum(np.random.default_rng([seed, int(i)]).standard_normal(n)), min_window_frac) for i in pdf["id"]]})

    walks = spark.range(0, simulations, 1, min(simulations, spark.sparkContext.defaultParallelism)).mapInPandas(run, "stat double")
    return walks.agg(F.percentile("stat", F.lit(quantile)).alias("critical"))


def check_regime(series: DataFrame, simulations: int = 199, quantile: float = 0.95, seed: int = 0, min_window_frac: float = 0.2, producer: str = "monitor") -> tuple[DataFrame, DataFrame]:
    """(checks, events) of series (asset, seq, value), each against the critical value of its own length.

    checks: asset, n, gsadf, critical, bubble, and Chow's f_stat, chow_critical and is_break beside it, null for series too short. events: producer and the
    columns of the regime_break channel, for bubbles only. One task of simulations for each distinct length and walk.
    """
    found = gsadf_statistic(series, min_window_frac)
    lengths = found.select(F.col("n").alias("length")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            walks = [gsadf(np.cumsum(np.random.default_rng([seed, int(i)]).standard_normal(int(n))), min_window_frac) for i, n in zip(pdf["walk"], pdf["length"])]
            yield pd.DataFrame({"length": pdf["length"], "stat": walks})

    walks = lengths.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).repartition(series.sparkSession.sparkContext.defaultParallelism, "length", "walk")
    critical = walks.mapInPandas(run, "length long, stat double").groupBy("length").agg(F.percentile("stat", F.lit(quantile)).alias("critical"))
    long_enough = series.join(found.where("n > 8").select("asset"), "asset", "left_semi")
    chow = chow_test(long_enough).select("asset", "f_stat", F.col("critical").alias("chow_critical"), "is_break")
    checks = found.join(critical, F.col("n") == F.col("length")).drop("length").withColumn("bubble", F.col("gsadf") > F.col("critical")).join(chow, "asset", "left")
    events = checks.where("bubble").select(F.lit(producer).alias("producer"), "asset", F.lit("gsadf").alias("kind"), F.col("gsadf").alias("statistic"), "critical")
    return checks, events


def shap_importance(data: DataFrame, columns: list[str], *keys: str, n_estimators: int = 50, max_depth: int | None = 5, min_leaf: int = 5, seed: int = 0) -> DataFrame:
    """(keys, feature, train, live): mean absolute Shapley values of a forest, over its train rows and over live ones.

    data: keys, event_id, role train or live, y and columns. One forest and one task for each key; none where train holds one class.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        train, live = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "live"]
        out = pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "feature": columns, "train": 0.0, "live": 0.0})
        if train["y"].nunique() < 2:
            return out.iloc[:0]
        forest = Forest(n_estimators, max_depth, min_leaf, seed=seed).fit(train[columns].to_numpy(float), train["y"].to_numpy(float))
        of = lambda part: np.abs(forest.shapley(part[columns].to_numpy(float))).mean(axis=0) if len(part) else np.zeros(len(columns))
        return out.assign(train=of(train), live=of(live))

    kinds = dict(data.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "feature string, train double, live double"])
    rows = data.where("role in ('train', 'live')").select(*keys, "event_id", "role", "y", *columns)
    return rows.groupBy(*keys).applyInPandas(run, schema)


def check_drift(importances: DataFrame, *keys: str, threshold: float = 0.5, producer: str = "monitor") -> tuple[DataFrame, DataFrame]:
    """(checks, events) of importances (keys, feature, train, live): the rank correlation, and an event of producer, keys and rho where it is below the threshold."""
    checks = concept_drift(importances.select(*keys, F.col("train").alias("a"), F.col("live").alias("b")), *keys, threshold=threshold)
    return checks, checks.where("drift").select(F.lit(producer).alias("producer"), *keys, "rho")


def detect_bubble(series: DataFrame, n: int, **options) -> DataFrame:
    """gsadf_statistic() with critical and bubble: above the critical value for series of n values."""
    crit = gsadf_critical(series.sparkSession, n, **options)
    return gsadf_statistic(series).crossJoin(F.broadcast(crit)).withColumn("bubble", F.col("gsadf") > F.col("critical"))  # crit is one row
