"""From events to a verdict: walk-forward meta-models with purged calibration, cohorts of candidates, the validation gate, trials and certification."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions import calibrators as K
from marketlab.operators import bars as B
from marketlab.operators import features as X
from marketlab.operators import folds as C
from marketlab.operators import labels as L
from marketlab.operators import models as M
from marketlab.operators import selection as S
from marketlab.operators import stationarity as D
from marketlab.operators import validation as V
from marketlab.plans import research as R

LEAST_CLASS = 2
#: What becomes of a certification.
CERTIFIED, REJECTED, HALTED, TOO_FEW, LEAKING, DEGENERATE = "certified", "rejected", "halted_at_mda", "insufficient_events", "data_leakage", "degenerate_cpcv"
_MICROS_A_YEAR = 365.25 * 24 * 3600 * 1e6


@dataclass(frozen=True)
class Candidate:
    """A model of a cohort."""

    name: str
    kind: str = "forest"
    options: dict = field(default_factory=dict)


def train_meta(
    data: DataFrame, columns: list[str], n_splits: int = 5, embargo_pct: float = 0.01, train_fraction: float = 0.3, inner_splits: int = 3, kind: str = "sequential", compare: str | None = "boosted", seed: int = 0, **options
) -> DataFrame:
    """(fold, event_id, y, raw, p, method, model, n_train, naive, train_t1_max, t0): calibrated probabilities out of sample for each walk-forward fold.

    data: event_id, t0, t1, y and columns. Rows are weighted by average uniqueness. In each fold the model, and the one to compare with, are
    calibrated on purged out-of-fold probabilities of the train rows; the lower Brier score on the test rows wins, the first on a tie.
    Folds with fewer than two train rows of a class, or one class in test, give no rows. One task a fold, model and inner fold, and
    another a fold to calibrate and choose. No columns raise ValueError.
    """
    if not columns:
        raise ValueError("no columns to train on")
    events = data.select("event_id", "t0", "t1", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
    horizons = events.select("event_id", "t0", "t1")
    rows = events.join(C.average_uniqueness(horizons), "event_id").join(C.walk_forward(horizons, n_splits, embargo_pct, train_fraction).select("fold", "event_id", "role"), "event_id")

    spark, folds, names = data.sparkSession, range(n_splits), [name for name in (kind, compare) if name]
    # the longest fits first
    units = [(fold, nth, step) for fold in reversed(folds) for step in reversed(range(inner_splits + 1)) for nth in range(len(names))]
    tasks = M.own_tasks(spark, units, "fold int, nth int, step int")
    rows = rows.join(F.broadcast(tasks), "fold").where((F.col("role") == "train") | (F.col("step") == inner_splits))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """The model of a fold for its test rows, or one for an inner fold of its train rows."""
        fold, nth, step = (int(pdf[c].iloc[0]) for c in ("fold", "nth", "step"))
        pdf = pdf.sort_values(["t0", "event_id"] if pdf["event_id"].is_unique else ["t0", "event_id", "t1", "y", *columns, "u"])  # the same places in all tasks
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        x, y, w, t0, t1 = given = (train[columns].to_numpy(), train["y"].to_numpy(), train["u"].to_numpy(), train["t0"].to_numpy(), train["t1"].to_numpy())
        out = pd.DataFrame({"fold": fold, "nth": nth, "step": step, "place": 0, "event_id": pdf["event_id"], "y": pdf["y"], "p": 0.0, "n_train": len(y), "naive": 0.0, "train_t1_max": 0, "t0": pdf["t0"]})
        try:
            if step < inner_splits:
                at, p = K.inner_fold(names[nth], given, options, inner_splits, int(len(y) * embargo_pct), seed + fold, step)
                return out.iloc[at].assign(place=at, p=p)
            if len(train) < 2 or len(test) < 2 or min(np.bincount(y.astype(int), minlength=2)) < LEAST_CLASS or test["y"].nunique() < 2:
                return out.iloc[:0]
            p = K.fitted(names[nth], x, y, K.normalized(w), (t0, t1), options, seed + fold).predict(test[columns].to_numpy())
        except ValueError:
            if not nth:
                raise
            return out.iloc[:0]
        return out[(pdf["role"] == "test").to_numpy()].assign(place=np.arange(len(test)), p=p, naive=float(y.mean()), train_t1_max=int(t1.max()))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nth", "place"])
        hold = pdf[pdf["step"] == inner_splits]
        test, best = hold[hold["nth"] == 0], None
        for nth, name in enumerate(names):
            raw, inner = hold[hold["nth"] == nth], pdf[(pdf["step"] < inner_splits) & (pdf["nth"] == nth)]
            if raw.empty:
                continue
            try:
                got = K.chosen(inner["p"].to_numpy(), inner["y"].to_numpy(), raw["p"].to_numpy(), raw["y"].to_numpy())
            except ValueError:
                if not nth:
                    raise
                continue
            if best is None or got["brier"] < best[0]["brier"]:
                best = got, name
        out = test.assign(y=test["y"].astype("int32"), raw=0.0, method="", model="")
        if best is not None:
            out = out.assign(raw=best[0]["raw"], p=best[0]["p"], method=best[0]["method"], model=best[1])
        return out[["fold", "event_id", "y", "raw", "p", "method", "model", "n_train", "naive", "train_t1_max", "t0"]]

    made = rows.repartition(len(units), "task").groupBy("task").applyInPandas(fit, "fold int, nth int, step int, place long, event_id long, y double, p double, n_train long, naive double, train_t1_max long, t0 long")
    made = made.join(F.broadcast(M.own_tasks(spark, [(fold,) for fold in folds], "fold int")), "fold")
    return made.repartition(n_splits, "task").groupBy("task").applyInPandas(choose, "fold int, event_id long, y int, raw double, p double, method string, model string, n_train long, naive double, train_t1_max long, t0 long")


def fold_diagnostics(predictions: DataFrame, embargo: int = 0) -> DataFrame:
    """Of train_meta(), one row a fold: Brier scores raw, calibrated and of the naive share, whether train ends before test begins with the embargo between, and whether calibration beats naive."""
    score = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    d = predictions.groupBy("fold", "method", "model", "n_train", "train_t1_max").agg(
        F.count("*").alias("n_holdout"), score("raw").alias("brier_raw"), score("p").alias("brier"), score("naive").alias("brier_naive"), F.min("t0").alias("holdout_t0_min")
    )
    return d.withColumns({"separated": F.col("train_t1_max") + embargo < F.col("holdout_t0_min"), "beats_naive": F.col("brier") < F.col("brier_naive")})


def cohort_predictions(data: DataFrame, roles: DataFrame, columns: list[str], cohort: list[Candidate], seed: int = 0) -> DataFrame:
    """(fold, strategy, nth, event_id, role, y, p) of every candidate in every fold, train and test rows; one task a fold and candidate."""
    table = data.sparkSession.createDataFrame([(i, c.name) for i, c in enumerate(cohort)], "nth int, strategy string")
    rows = data.select("event_id", "t0", "t1", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
    rows = rows.join(roles.where("role in ('train', 'test')").select("fold", "event_id", "role"), "event_id").join(F.broadcast(table))  # a row for each candidate

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "event_id"])
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        out = pdf[["fold", "strategy", "nth", "event_id", "role", "y"]].assign(p=0.0)
        counts = [np.bincount(part["y"].astype(int), minlength=2).min() for part in (train, test)]
        if min(counts) < LEAST_CLASS:
            return out.iloc[:0]
        c = cohort[int(pdf["nth"].iloc[0])]
        model = K.fitted(c.kind, train[columns].to_numpy(), train["y"].to_numpy(), np.ones(len(train)), (train["t0"].to_numpy(), train["t1"].to_numpy()), c.options, seed)
        return out.assign(p=model.predict(pdf[columns].to_numpy()))

    return rows.groupBy("fold", "nth").applyInPandas(run, "fold int, strategy string, nth int, event_id long, role string, y double, p double")


def cohort_performance(predictions: DataFrame) -> DataFrame:
    """(split, strategy, is_perf, oos_perf): negative Brier scores in and out of sample, of cohort_predictions()."""
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    of = lambda role: -F.avg(F.when(F.col("role") == role, F.pow(q - F.col("y"), 2)))
    return predictions.groupBy(F.col("fold").alias("split"), F.col("strategy"), "nth").agg(of("train").alias("is_perf"), of("test").alias("oos_perf"))


@dataclass(frozen=True)
class Gate:
    """Thresholds of the verdict."""

    pbo: float = 0.05
    dsr: float = 0.95
    leak: float = 0.05
    min_trials: int = 30


def validate_strategy(
    data: DataFrame, columns: list[str], cohort: list[Candidate], n_trials: int, n_groups: int = 6, n_test_groups: int = 2, embargo_pct: float = 0.01, n_shuffles: int = 30, bet_threshold: float = 0.5,
    std_of_trials: float = 1.0, periods_per_year: float = 252, gate: Gate = Gate(), seed: int = 0,
) -> DataFrame:
    """One row: incumbent, pbo, n_splits, sharpe, dsr, quarantined, real_brier, p_value, passes.

    data: event_id, t0, t1, y, ret and columns. Every candidate is fitted in every combinatorial purged fold; the one of best mean score out of sample is
    the incumbent. Its probabilities, averaged over the folds that test an event, give returns; the deflated Sharpe ratio and a test with
    shuffled labels follow. Too few trials fail the gate whatever the rest.
    """
    if len(cohort) < 2:
        raise ValueError("a cohort has two candidates or more")
    spark = data.sparkSession
    horizons = data.select("event_id", "t0", "t1")
    made = cohort_predictions(data, C.cpcv_folds(horizons, n_groups, n_test_groups, embargo_pct), columns, cohort, seed).persist()
    try:
        performance = cohort_performance(made)
        whole = performance.groupBy("split").agg(F.count("is_perf").alias("k"), F.count("oos_perf").alias("j")).where((F.col("k") == len(cohort)) & (F.col("j") == len(cohort)))
        performance = performance.join(whole.select("split"), "split")
        # a row for each candidate
        mean = performance.groupBy("nth", "strategy").agg(F.avg("oos_perf").alias("mean")).orderBy(F.desc("mean"), "nth").first()
        if mean is None:
            raise ValueError("no fold has both classes on both sides")
        # ties in sample go to the first candidate, so names are ordered as given
        ordered = performance.select("split", F.format_string("%05d", "nth").alias("strategy"), "is_perf", "oos_perf")
        verdict = V.pbo(ordered)[1].first()
        bets = made.where((F.col("nth") == mean["nth"]) & (F.col("role") == "test")).groupBy("event_id").agg(F.avg("p").alias("p"))
        returns = V.signal_returns(data.select("event_id", "ret").join(bets, "event_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0))), bet_threshold)
        dsr = V.deflated_sharpe(returns.select(F.lit("all").alias("grp"), F.col("strategy_ret").alias("ret")), n_trials, std_of_trials, "grp", min_trials=gate.min_trials).first()
    finally:
        made.unpersist()
    chosen = cohort[mean["nth"]]
    leak = M.target_shuffling(data, C.purged_kfold(horizons, max(n_groups - n_test_groups, 2), embargo_pct), columns, n_shuffles, seed, **{k: v for k, v in chosen.options.items() if k in ("n_estimators", "max_depth", "min_leaf")}).first()
    passes = not dsr["quarantined"] and verdict["pbo"] < gate.pbo and dsr["dsr"] > gate.dsr and leak["p_value"] < gate.leak
    row = (chosen.name, float(verdict["pbo"]), int(verdict["n_splits"]), dsr["sharpe"], float(dsr["dsr"]), bool(dsr["quarantined"]), float(leak["real"]), float(leak["p_value"]), bool(passes))
    return spark.createDataFrame([row], "incumbent string, pbo double, n_splits long, sharpe double, dsr double, quarantined boolean, real_brier double, p_value double, passes boolean")


def run_detectors(bars: DataFrame, families: dict[str, dict], registry: R.Registry | None = None, **barrier) -> DataFrame:
    """Labels of each family's events, with plugin_family; families without events give none. Each asset's run of a family is recorded, once."""
    rows = None
    for family, options in families.items():
        events = L.detector(family)(bars, **options)
        one = L.triple_barrier(bars, events, **barrier).withColumn("plugin_family", F.lit(family))
        if registry is not None:
            ran = events.groupBy("asset").agg(F.count("*").alias("n"))  # a row for each asset
            params = F.create_map(*[x for k, v in sorted(options.items()) for x in (F.lit(k), F.lit(float(v)))]) if options else F.expr("cast(map() as map<string,double>)")
            registry.record(ran.select("asset", F.lit(family).alias("family"), params.alias("params"), F.lit("completed").alias("status"), F.col("n").cast("double").alias("metric")))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def periods_per_year(events: DataFrame) -> DataFrame:
    """(asset, periods): events a year of events (asset, ts_us), at least 1; 252 for one event or none of any span."""
    e = events.groupBy("asset").agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("span"))
    return e.select("asset", F.when((F.col("n") < 2) | (F.col("span") <= 0), 252.0).otherwise(F.greatest(F.lit(1.0), F.col("n") * _MICROS_A_YEAR / F.col("span"))).alias("periods"))


@dataclass(frozen=True)
class Precomputed:
    """What a sweep of one asset shares: bars of the regime's granularity and the order of differencing."""

    asset: str
    bars: DataFrame
    bar_type: str
    bar_parameter: float
    jarque_bera: float | None
    n_bars: int
    vertical_bars: int
    ffd_d: float | None


def precompute(ticks: DataFrame, asset: str, regime: R.HoldingRegime) -> Precomputed:
    """Time bars of the regime's length, and imbalance and run bars of about their number; the least Jarque-Bera statistic wins."""
    own = ticks.where(F.col("asset") == asset)
    minutes = max(1, round(regime.bar_hours * 60))
    time = B.time_bars(own, f"{minutes}m")
    counts = own.agg(F.count("*").alias("n")).first()["n"], time.count()
    expected = max(counts[0] / max(counts[1], 1), 2.0)
    made = {"time": time, "imbalance": B.imbalance_bars(own, expected_ticks=expected), "run": B.run_bars(own, expected_ticks=expected)}
    won = B.tournament(own, (f"{minutes}m",), (expected,)).where("place = 1").first()
    bars = made[won["bar_type"]]
    # a row for each order of the grid
    d = D.find_optimal_d(bars.select("asset", "seq", F.col("close").alias("value"))).where("chosen").first()
    return Precomputed(asset, bars, won["bar_type"], float(won["param"]), won["jb"], bars.count(), regime.vertical_bars, d["d"] if d else None)


def event_dataset(pc: Precomputed, family: str, options: dict, profit_take: float = 2.0, vol_span: int = 50, windows: tuple = (10, 20, 30, 50), entropy_windows: tuple = (50, 100), least: int = 500, most: int = 6000, enforce: bool = True) -> tuple[DataFrame | None, int, str]:
    """(data, events, detail): data (event_id, asset, ts_us, t0, t1, y, ret, side_sign, features) of a family's labelled events that have all features, thinned to about ``most``; None under ``least``."""
    options = dict(options)
    vertical = int(options.pop("vertical_bars", pc.vertical_bars))
    events = L.detector(family)(pc.bars, **options)
    n = events.count()
    if n < least:
        return None, n, f"too few events ({n} < {least})"
    labels = L.triple_barrier(pc.bars, events, vol_span=vol_span, profit_take=profit_take, vertical_bars=vertical)
    ready, _ = D.compute_features(pc.bars, events, windows, entropy_windows, enforce=enforce)
    names = [c for c in ready.columns if c not in ("asset", "seq", "ts_us")]
    data = labels.join(ready.select("asset", "seq", *names), ["asset", "seq"])
    data = data.select(
        F.col("seq").alias("event_id"), "asset", "ts_us", F.col("seq").alias("t0"), F.col("exit_seq").alias("t1"), F.col("label").alias("y"), F.col("return_pct").alias("ret"),
        F.when(F.col("side") == "long", 1).otherwise(-1).alias("side_sign"), *names,
    )
    kept = data.count()
    if kept < least:
        return None, n, "too few events with all features"
    if most and kept > most:
        data = X.thin(data.withColumn("seq", F.col("event_id")), most).drop("seq")
    return data, n, "ok"


def run_trial(pc: Precomputed, family: str, options: dict, registry: R.Registry | None = None, n_splits: int = 5, n_estimators: int = 100, kind: str = "forest", seed: int = 0, **dataset) -> dict:
    """One configuration: events, labels, features, selection, walk-forward models, objective; recorded if a registry is given. valid: beats the naive score, with a finite objective."""
    out = {"asset": pc.asset, "family": family, "options": options, "objective": None, "valid": False, "brier": None, "brier_naive": None}
    data, n, detail = event_dataset(pc, family, options, **dataset)
    if data is None:
        return out | {"status": "invalid", "n_events": n, "detail": detail}
    names = data.columns[8:]
    roles = C.purged_kfold(data.select("event_id", "t0", "t1"), n_splits)
    chosen, halted = S.select_features(data, roles, names, n_estimators=n_estimators, seed=seed)
    if halted:
        _record(registry, pc.asset, family, options, "failed_mda", None)
        return out | {"status": "failed_mda", "n_events": n, "detail": "no feature survives"}
    made = train_meta(data, chosen, n_splits, kind=kind, compare=None, seed=seed, n_estimators=n_estimators)
    per = fold_diagnostics(made).agg(F.avg("brier").alias("brier"), F.avg("brier_naive").alias("naive")).first()
    periods = periods_per_year(data).first()["periods"]
    bets = made.join(data.select("event_id", "ret", "side_sign"), "event_id").withColumn("bet", V.bet_size("p"))
    objective = V.oos_sharpe(bets, periods).first()["objective"]
    valid = per["brier"] is not None and per["brier"] < per["naive"] and objective is not None and bool(np.isfinite(objective))
    _record(registry, pc.asset, family, options, "completed", per["brier"])
    return out | {"status": "completed", "n_events": n, "detail": "ok" if valid else "completed, not valid", "objective": objective, "valid": valid, "brier": per["brier"], "brier_naive": per["naive"], "features": chosen}


def _record(registry: R.Registry | None, asset: str, family: str, options: dict, status: str, metric: float | None) -> None:
    if registry is not None:
        row = (asset, family, {k: float(v) for k, v in options.items()}, status, metric)
        registry.record(registry.spark.createDataFrame([row], "asset string, family string, params map<string,double>, status string, metric double"))


#: Depths of the certification cohort's forests; a boosted model joins them.
DEPTHS = (3, 5, 8, None)


def certify(pc: Precomputed, family: str, options: dict, registry: R.Registry, experiment_id: str | None = None, depths: tuple = DEPTHS, n_estimators: int = 100, n_splits: int = 5, seed: int = 0, dataset: dict | None = None, **gate) -> dict:
    """The gate on one configuration, with the trials that the registry has of its asset and family. A failure on the way is a status, not an error."""
    data, n, detail = event_dataset(pc, family, options, **(dataset or {}))
    out = {"asset": pc.asset, "family": family, "options": options, "n_events": n, "detail": detail}
    if data is None:
        return out | {"status": TOO_FEW}
    names = data.columns[8:]
    chosen, halted = S.select_features(data, C.purged_kfold(data.select("event_id", "t0", "t1"), n_splits), names, n_estimators=n_estimators, seed=seed)
    if halted:
        return out | {"status": HALTED}
    cohort = [Candidate(f"forest_{d or 'full'}", "forest", {"n_estimators": n_estimators, "max_depth": d}) for d in depths]
    cohort.append(Candidate("boosted", "boosted", {"n_estimators": n_estimators, "max_depth": max([d for d in depths if d] or [6])}))
    trials = cohort_trials(registry, pc.asset, family)
    try:
        verdict = validate_strategy(data, chosen, cohort, trials, periods_per_year=max(1, round(periods_per_year(data).first()["periods"])), seed=seed, **gate).first().asDict()
    except ValueError as e:
        return out | {"status": DEGENERATE, "detail": str(e)}
    if experiment_id is not None:
        registry.update(experiment_id, status="validated" if verdict["passes"] else "failed_validation", metric=verdict["dsr"])
    return out | verdict | {"status": CERTIFIED if verdict["passes"] else LEAKING if verdict["p_value"] >= gate.get("gate", Gate()).leak else REJECTED, "n_trials": trials, "features": chosen}


def cohort_trials(registry: R.Registry, asset: str, family: str) -> int:
    """How many experiments the registry has of an asset and family."""
    return registry.trials(asset=asset, family=family).count()


def sweep_and_certify(pc: Precomputed, family: str, registry: R.Registry, axes: tuple | None = None, trial: dict | None = None, **certification) -> dict:
    """Every point of a family's grid as a trial, the plateau of their objectives, and the gate on its centre, if there is one."""
    (na, va), (nb, vb) = axes or R.GRIDS[family]
    found, points = [], {}
    for i, a in enumerate(va):
        for j, b in enumerate(vb):
            got = run_trial(pc, family, {na: a, nb: b}, registry, **(trial or {}))
            points[i, j] = got
            found.append((i, j, float(got["objective"]) if got["valid"] else None))
    surface = registry.spark.createDataFrame(found, "i long, j long, score double")
    best = V.plateau(surface).where("best").first()
    out = {"trials": list(points.values()), "plateau": None, "certification": None}
    if best is None:
        return out
    won = points[best["i"], best["j"]]
    return out | {"plateau": won, "certification": certify(pc, family, won["options"], registry, **certification)}
