"""Meta-models: uniqueness-weighted sequential bootstrap forests, boosted trees and probability calibration."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions.trees import Forest, sequential_bootstrap, sequential_draw, uniform_draw

__all__ = ["boosted", "calibrate", "out_of_fold", "sequential_bootstrap", "target_shuffling"]


def own_tasks(spark: SparkSession, units: list[tuple], schema: str) -> DataFrame:
    """units with task, a number by whose hash repartition(len(units), "task") deals each unit to a partition of its own; adaptive execution joins none of these."""
    n = max(1, len(units))
    keys = {r["at"]: r["id"] for r in spark.range(0, 32 * n + 64, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).collect()}
    return spark.createDataFrame([(*u, keys.get(i, -1 - i)) for i, u in enumerate(units)], f"{schema}, task long")


def out_of_fold(data: DataFrame, roles: DataFrame, columns: list[str], sequential: bool = True, n_estimators: int = 50, max_depth: int | None = 5, min_leaf: int = 5, bootstrap_fraction: float = 1.0, seed: int = 0, weight: str | None = None) -> DataFrame:
    """(fold, event_id, y, p): test predictions of a forest for each fold. Folds with one class in train are skipped.

    One task a fold, or several that fit some of its trees each, where the cluster has cores for them.

    data: event_id, t0, t1, y, columns; roles (fold, event_id, role). weight: a column of data; it multiplies the uniqueness of
    a sequential draw, and weighs the rows of a uniform one.
    """
    spark = data.sparkSession
    roles = roles.where("role in ('train', 'test')").select("fold", "event_id", "role")
    folds = sorted(r["fold"] for r in roles.select("fold").distinct().collect())  # a row for each fold
    parts = max(1, min(n_estimators, spark.sparkContext.defaultParallelism // max(1, len(folds))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fold, part = int(pdf["fold"].iloc[0]), int(pdf["part"].iloc[0])
        pdf = pdf.sort_values("event_id" if pdf["event_id"].is_unique else ["event_id", "t0", "t1", "y", *columns, "_weight", "role"])  # the same places in all parts
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        out = pd.DataFrame({"fold": fold, "event_id": test["event_id"], "y": test["y"].astype("int32"), "part": part, "nth": np.arange(len(test)), "s": 0.0})
        if train["y"].nunique() < 2 or test.empty:
            return out.iloc[:0]
        w = train["_weight"].to_numpy(float)
        draw = sequential_draw(train["t0"].to_numpy(float), train["t1"].to_numpy(float), w, bootstrap_fraction) if sequential else uniform_draw(w)
        own = range(part * n_estimators // parts, (part + 1) * n_estimators // parts)
        forest = Forest(n_estimators, max_depth, min_leaf, seed=seed + fold).fit(train[columns].to_numpy(float), train["y"].to_numpy(float), draw, own)
        return out.assign(s=np.sum([t.predict(test[columns].to_numpy(float)) for t in forest.trees], axis=0))

    own = (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_weight")
    tasks = own_tasks(spark, [(fold, part) for fold in folds for part in range(parts)], "fold int, part int")
    rows = data.select("event_id", "t0", "t1", "y", *columns, own).join(roles, "event_id").join(F.broadcast(tasks), "fold")
    made = rows.repartition(max(1, len(folds) * parts), "task").groupBy("task").applyInPandas(run, "fold int, event_id long, y int, part int, nth long, s double")
    if parts > 1:  # sums of parts in their order, whatever the order they come in
        made = made.groupBy("fold", "event_id", "y", "nth").agg(reduce(add, [F.sum(F.when(F.col("part") == k, F.col("s"))) for k in range(parts)]).alias("s"))
    return made.select("fold", "event_id", "y", (F.col("s") / n_estimators).alias("p"))


def boosted(data: DataFrame, roles: DataFrame, columns: list[str], fold: int, rounds: int = 20, depth: int = 3, seed: int = 0) -> DataFrame:
    """(fold, event_id, y, p) of gradient-boosted trees for one fold, the stand-in for the second model of comparisons."""
    rows = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(data.join(roles.where(F.col("fold") == fold).select("event_id", "role"), "event_id"))
    model = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed).fit(rows.where("role = 'train'"))
    return model.transform(rows.where("role = 'test'")).select(F.lit(fold).alias("fold"), "event_id", F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


def calibrate(fit_on: DataFrame, apply_to: DataFrame) -> tuple[DataFrame, str]:
    """apply_to (p) with calibrated, by isotonic regression or a logistic on the logit, whichever has the lower Brier score on fit_on (a tie: isotonic)."""
    logit = F.log(F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))))
    prep = lambda df: VectorAssembler(inputCols=["x_logit"], outputCol="x_features").transform(df.withColumns({"x_logit": logit, "x_y": F.col("y").cast("double") if "y" in df.columns else F.lit(0.0)}))
    fitted, wanted = prep(fit_on), prep(apply_to)
    iso = IsotonicRegression(featuresCol="p", labelCol="x_y", predictionCol="iso").fit(fitted)
    platt = LogisticRegression(featuresCol="x_features", labelCol="x_y", regParam=0.0, probabilityCol="x_prob", rawPredictionCol="x_raw", predictionCol="x_pred").fit(fitted)
    both = lambda df: platt.transform(iso.transform(df)).withColumn("platt", vector_to_array("x_prob")[1])
    brier = both(fitted).agg(F.avg(F.pow(F.col("iso") - F.col("x_y"), 2)).alias("i"), F.avg(F.pow(F.col("platt") - F.col("x_y"), 2)).alias("p")).first()
    name = "isotonic" if brier["i"] <= brier["p"] else "platt"
    q = F.col("iso" if name == "isotonic" else "platt")
    return both(wanted).select(*apply_to.columns, F.least(F.greatest(q, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("calibrated")), name


def target_shuffling(data: DataFrame, roles: DataFrame, columns: list[str], n_shuffles: int = 30, seed: int = 0, **forest) -> DataFrame:
    """(real, p_value): Brier score out of fold, and the share of label permutations that reach it; one task a (shuffle, fold)."""
    options = {"n_estimators": 10, "max_depth": 3, "min_leaf": 5} | forest

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, fold, shuffle = pdf.sort_values("event_id"), int(pdf["fold"].iloc[0]), int(pdf["shuffle"].iloc[0])
        y = pdf["y"].to_numpy(float)
        if shuffle:
            y = np.random.default_rng([seed, shuffle]).permutation(y)
        train, test = (pdf["role"] == "train").to_numpy(), (pdf["role"] == "test").to_numpy()
        x = pdf[columns].to_numpy(float)
        if len(np.unique(y[train])) < 2 or not test.any():
            return pd.DataFrame({"shuffle": [], "se": [], "n": []}).astype({"shuffle": "int32", "se": float, "n": "int64"})
        f = Forest(options["n_estimators"], options["max_depth"], options["min_leaf"], seed=seed).fit(x[train], y[train])
        return pd.DataFrame({"shuffle": [shuffle], "se": [float(((f.predict(x[test]) - y[test]) ** 2).sum())], "n": [int(test.sum())]})

    rows = data.select("event_id", "y", *columns).join(roles.where("role in ('train', 'test')").select("fold", "event_id", "role"), "event_id")
    many = rows.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(n_shuffles))))
    per = many.groupBy("shuffle", "fold").applyInPandas(run, "shuffle int, se double, n long").groupBy("shuffle").agg((F.sum("se") / F.sum("n")).alias("b"))
    real = per.agg(F.max(F.when(F.col("shuffle") == 0, F.col("b"))).alias("real"))
    return per.where("shuffle > 0").join(F.broadcast(real)).groupBy("real").agg(F.avg((F.col("b") <= F.col("real")).cast("double")).alias("p_value"))
