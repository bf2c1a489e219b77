"""Feature selection: correlation distance, clusters, clustered and single-feature importance under purged splits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlab.functions.stats import t_sf
from marketlab.functions.trees import Forest

EDGES = "fi string, fj string, rho double, d double"


def _cross_sums(columns: list[str], means: list[float]):
    """(i, j, n, sx, sy, sxx, syy, sxy) for i < j: sums over a partition's rows that have both columns, less their means; four matrix products a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(columns)
        sums = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float) - means
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            m = m.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        i, j = np.triu_indices(k, 1)
        n, one, square, cross = sums
        values = [i.astype(np.int32), j.astype(np.int32), n[i, j], one[i, j], one[j, i], square[i, j], square[j, i], cross[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    return run


def correlation_distance(df: DataFrame, columns: list[str], min_std: float = 1e-12) -> DataFrame:
    """(fi, fj, rho, d) for fi < fj: d = sqrt((1 - rho) / 2); a column without spread has rho 0. Rows count for a pair if they have both.

    One aggregate of means and spreads, and one pass of matrix products; a partition sends a row for each pair.
    """
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    flat = [i for i in range(len(columns)) if not (row[f"s{i}"] or 0.0) > min_std]
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sums = numbers.mapInArrow(_cross_sums(columns, means), "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    both = F.sqrt((F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")))
    rho = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), both)
    rho = F.when(F.col("i").isin(flat) | F.col("j").isin(flat), 0.0).otherwise(F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0)))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    return total.select(name("i").alias("fi"), name("j").alias("fj"), rho.alias("rho")).withColumn("d", F.sqrt(0.5 * (1 - F.col("rho"))))


def _matrix(edges: pd.DataFrame, names: list[str]) -> np.ndarray:
    at, d = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for e in edges.itertuples():
        d[at[e.fi], at[e.fj]] = d[at[e.fj], at[e.fi]] = e.d
    return d


def _average_linkage(d: np.ndarray) -> list[list[list[int]]]:
    """Clusterings of every size, from one cluster per item down to one: closest mean distance first, then lowest indices."""
    clusters = [[i] for i in range(len(d))]
    out = [[list(c) for c in clusters]]
    while len(clusters) > 1:
        a, b = min(combinations(range(len(clusters)), 2), key=lambda p: (round(float(d[np.ix_(clusters[p[0]], clusters[p[1]])].mean()), 12), p))
        merged = sorted(clusters[a] + clusters[b])
        clusters = sorted([c for k, c in enumerate(clusters) if k not in (a, b)] + [merged])
        out.append([list(c) for c in clusters])
    return out


def silhouette(d: np.ndarray, clusters: list[list[int]]) -> float:
    """Mean silhouette; items alone in their cluster count 0."""
    total = 0.0
    for c in clusters:
        for i in c:
            if len(c) > 1:
                a = d[i, c].sum() / (len(c) - 1)
                b = min(d[i, o].mean() for o in clusters if o is not c)
                total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(d)


def cluster_features(edges: DataFrame, names: list[str], k_min: int = 2, plateau_eps: float = 0.02) -> DataFrame:
    """(feature, cluster): the fewest clusters whose silhouette is within plateau_eps of the best. The features are few; the edges are collected."""
    d = _matrix(edges.toPandas(), names)
    by_size = {len(c): c for c in _average_linkage(d)}
    score = {k: silhouette(d, by_size[k]) for k in range(k_min, len(names)) if k in by_size}
    if score:
        best = max(score.values())
        chosen = by_size[min(k for k, s in score.items() if s >= best - plateau_eps)]
    else:
        chosen = by_size[len(names)]
    rows = [(names[i], k) for k, c in enumerate(chosen) for i in c]
    return edges.sparkSession.createDataFrame(rows, "feature string, cluster int")


def _log_loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _fold_rows(data: DataFrame, roles: DataFrame) -> DataFrame:
    return data.join(roles.where("role in ('train', 'test')").select("fold", "event_id", "role"), "event_id")


def clustered_mda(data: DataFrame, roles: DataFrame, columns: list[str], clusters: DataFrame, significance: float = 0.05, n_estimators: int = 60, max_depth: int = 5, min_leaf: int = 5, seed: int = 0) -> DataFrame:
    """(cluster, importance, p_value, kept): rise of the log loss when a cluster's columns are permuted together; one task a fold.

    data: event_id, y and columns; roles: of a purged split. A fold with one class scores 0. A one-sided t-test over folds decides.
    """
    groups: dict[int, list[int]] = {}
    for r in clusters.collect():  # one row a feature
        groups.setdefault(int(r["cluster"]), []).append(columns.index(r["feature"]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, fold = pdf.sort_values("event_id"), int(pdf["fold"].iloc[0])
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        ok = train["y"].nunique() == 2 and len(test)
        rows = []
        if ok:
            forest = Forest(n_estimators, max_depth, min_leaf, seed=seed + fold).fit(train[columns].to_numpy(float), train["y"].to_numpy(float))
            x, y, r = test[columns].to_numpy(float), test["y"].to_numpy(float), np.random.default_rng([seed, fold])
            base = _log_loss(y, forest.predict(x))
        for c, own in groups.items():
            gain = 0.0
            if ok:
                z = x.copy()
                z[:, own] = z[r.permutation(len(z))][:, own]
                gain = _log_loss(y, forest.predict(z)) - base
            rows.append((fold, c, gain))
        return pd.DataFrame(rows, columns=["fold", "cluster", "gain"])

    gains = _fold_rows(data.select("event_id", "y", *columns), roles).groupBy("fold").applyInPandas(run, "fold int, cluster int, gain double")
    per = gains.groupBy("cluster").agg(F.avg("gain").alias("importance"), F.stddev_samp("gain").alias("s"), F.count("*").alias("n")).toPandas()

    def p_value(r) -> float:
        if not r.s > 0:
            return 0.0 if r.importance > 0 else 1.0
        return t_sf(r.importance / (r.s / math.sqrt(r.n)), r.n - 1)

    rows = [(int(r.cluster), float(r.importance), p := p_value(r), bool(p <= significance and r.importance > 0)) for r in per.itertuples()]
    return data.sparkSession.createDataFrame(rows, "cluster int, importance double, p_value double, kept boolean")


def single_feature_importance(data: DataFrame, roles: DataFrame, columns: list[str], least: float = 1e-3, n_estimators: int = 30, max_depth: int = 5, min_leaf: int = 5, seed: int = 0) -> DataFrame:
    """(feature, improvement, survives): mean gain in log loss over the class prior of a forest on one feature; one task a fold and feature."""
    long = data.select("event_id", "y", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, fold = pdf.sort_values("event_id"), int(pdf["fold"].iloc[0])
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        gain = None
        if train["y"].nunique() == 2 and len(test):
            forest = Forest(n_estimators, max_depth, min_leaf, seed=seed + fold).fit(train[["x"]].to_numpy(float), train["y"].to_numpy(float))
            y = test["y"].to_numpy(float)
            gain = _log_loss(y, np.full(len(y), train["y"].mean())) - _log_loss(y, forest.predict(test[["x"]].to_numpy(float)))
        return pd.DataFrame({"fold": [fold], "feature": [pdf["feature"].iloc[0]], "gain": [gain]})

    gains = _fold_rows(long, roles).groupBy("fold", "feature").applyInPandas(run, "fold int, feature string, gain double")
    return gains.groupBy("feature").agg(F.avg("gain").alias("improvement")).withColumn("survives", F.coalesce(F.col("improvement") >= least, F.lit(False)))


def select_features(data: DataFrame, roles: DataFrame, columns: list[str], cap: float = 0.8, **options) -> tuple[list[str], bool]:
    """(surviving features, halted): clustered importance; if it drops under a fifth, also the single-feature filter, capped at cap of the columns."""
    edges = correlation_distance(data, columns)
    clusters = cluster_features(edges, columns).cache()
    mda = clustered_mda(data, roles, columns, clusters, **options)
    kept = clusters.join(mda.where("kept"), "cluster").select("feature", "importance").toPandas()
    names = [c for c in columns if c in set(kept["feature"])]
    if not names:
        return [], True
    if len(names) > 0.8 * len(columns):
        sfi = {r["feature"] for r in single_feature_importance(data, roles, columns).where("survives").collect()}
        both = [c for c in names if c in sfi]
        rank = dict(zip(kept["feature"], kept["importance"]))
        names = sorted(both, key=lambda c: (-rank[c], columns.index(c)))[: int(cap * len(columns))]
    return names, not names
