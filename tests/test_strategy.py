"""Recurrences in batches, meta-models, the gate, execution, monitoring and trials."""

import math
import re
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlab.functions import calibrators as K
from marketlab.functions import kernels, scans, stats, trees
from marketlab.functions.trees import Forest, Tree
from marketlab.operators import execution as E
from marketlab.operators import folds as C
from marketlab.operators import models as M
from marketlab.operators import monitoring as G
from marketlab.operators import selection as S
from marketlab.operators import stationarity as D
from marketlab.operators import validation as V
from marketlab.plans import research as R
from marketlab.plans import strategy as T
from marketlab.sources import views


def in_parts(state, frame, sizes):
    out, at = [], 0
    for n in sizes:
        out.append(state.feed(frame.iloc[at : at + n]))
        at += n
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("kind", ["imbalance", "run"])
def test_bars_in_batches_equal_the_whole(kind):
    r = np.random.default_rng(1)
    mid = 100 + np.cumsum(r.choice([-1, 0, 1], 3000)) / 100
    ticks = pd.DataFrame({"asset": "a", "ts_us": np.arange(3000), "tick_id": np.arange(3000), "mid": mid, "volume": r.uniform(0, 2, 3000)})
    ids = kernels.bar_ids(mid, kind, expected_ticks=20)
    got = in_parts(scans.BarMaker(kind, expected_ticks=20), ticks, [1, 7, 1000, 3, 989, 1000])
    want = ticks.assign(bar=ids)[ids >= 0].groupby("bar").agg(open=("mid", "first"), high=("mid", "max"), low=("mid", "min"), close=("mid", "last"), volume=("volume", "sum"), n_ticks=("mid", "size"), ts_us=("ts_us", "last"))
    assert len(got) == len(want) > 20 and got["seq"].tolist() == list(range(1, len(got) + 1))
    for c in want:
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float))


def test_volatility_and_cusum_in_batches_equal_the_whole():
    r = np.random.default_rng(2)
    ret = r.standard_normal(600) / 100
    ret[[0, 5, 6, 300]] = np.nan
    rows = pd.DataFrame({"asset": "a", "seq": np.arange(600), "ts_us": np.arange(600), "ret": ret})
    for least in (None, 1, 2):
        got = in_parts(scans.EwmStd(20, least, True), rows, [1, 2, 300, 297])
        assert np.allclose(got["vol"], pd.Series(kernels.ewm_std(ret, 20, least)).shift(1), equal_nan=True)
    got = in_parts(scans.Cusum(1.5), got, [10, 1, 589])
    hits = kernels.cusum(ret, 1.5 * pd.Series(kernels.ewm_std(ret, 20, 2)).shift(1).to_numpy())
    assert got["seq"].tolist() == np.flatnonzero(hits).tolist() and got["hit"].tolist() == hits[hits != 0].tolist()


def test_ticks_are_filtered_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(datetime(2024, 1, d), 1.0, 1.1, 1.0, 1.0, d) for d in range(1, 20)]
    spark.createDataFrame(rows, "timestamp timestamp, bid double, ask double, bid_volume double, ask_volume double, extra int").write.parquet(path)
    found = views.load_ticks(spark, path, date(2024, 1, 5), date(2024, 1, 8), ["timestamp", "bid"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3 and "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan and "extra" not in plan
    a = views.Asset("EURUSD", "fx")
    assert a.data_path("s3a://x/") == "s3a://x/asset=EURUSD" and a.oos_data_path("/d").startswith("/d/out_of_sample")
    health = {r.check: r.ok for r in R.doctor(spark, {"here": path, "gone": path + "x"}, max_window=-500).collect()}
    assert health == {"here": True, "gone": False}


def test_calibrators():
    r = np.random.default_rng(3)
    p = r.uniform(0, 1, 400)
    y = (r.uniform(0, 1, 400) < p**2).astype(float)
    iso, sig = K.isotonic(p, y), K.platt(p, y)
    q = np.linspace(0, 1, 50)
    assert (np.diff(iso(q)) >= -1e-12).all() and (np.diff(sig(q)) > 0).all()
    assert K.brier(iso(p), y) <= K.brier(sig(p), y) < K.brier(p, y)
    # of all monotone fits of few values, the best
    assert np.allclose(K.isotonic(np.array([1.0, 2, 3, 3]), np.array([1.0, 0, 1, 0]))(np.array([0, 1, 2, 3, 9])), 0.5)
    assert K.isotonic(np.array([1.0, 2]), np.array([0.0, 1]))(np.array([1.5]))[0] == 0.5


def test_purged_folds_of_arrays_equal_those_of_frames(spark):
    r = np.random.default_rng(4)
    t0 = np.sort(r.choice(2000, 120, replace=False))
    t1 = t0 + r.integers(0, 60, 120)
    df = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(t0, t1))], "event_id long, t0 long, t1 long")
    want = {}
    for x in C.purged_kfold(df, 4, 0.02).where("role in ('train', 'test')").collect():
        want.setdefault((x.fold, x.role), set()).add(x.event_id)
    for k, (train, test) in enumerate(K.purged_folds(t0, t1, 4, int(120 * 0.02))):
        assert set(train.tolist()) == want[k, "train"] and set(test.tolist()) == want[k, "test"]


def test_shapley_values_are_exact():
    from itertools import combinations

    r = np.random.default_rng(5)
    x = r.integers(0, 4, (200, 4)).astype(float)
    y = ((x[:, 0] > 1) ^ (x[:, 1] > 2)).astype(float)
    tree = Tree(3, 5, None, np.random.default_rng(0)).fit(x, y, np.ones(200))
    feature, cut, left, right, value = tree.arrays

    def known(row, s, node=0):
        if feature[node] < 0:
            return value[node]
        f = feature[node]
        if f in s:
            return known(row, s, left[node] if row[f] <= cut[node] else right[node])
        return sum(known(row, s, c) * tree.covers[c] for c in (left[node], right[node])) / tree.covers[node]

    got = tree.shapley(x[:10])
    for row, phi in zip(x[:10], got):
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (known(row, {*s, f}) - known(row, set(s))) for k in range(4) for s in combinations(rest, k))
            assert phi[f] == pytest.approx(want)
    forest = Forest(5, 4, 5).fit(x, y)
    assert forest.shapley(x).shape == (200, 4)


def test_sample_weights_reach_the_forest(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal(120)
    rows = [(k, k, k + 1, int(x[k] > 0) if k % 2 else int(x[k] <= 0), float(x[k]), 1000.0 if k % 2 else 0.001) for k in range(120)]
    df = spark.createDataFrame(rows, "event_id long, t0 long, t1 long, y int, x double, w double")
    roles = C.purged_kfold(df.select("event_id", "t0", "t1"), 3)
    for sequential in (True, False):
        got = M.out_of_fold(df, roles, ["x"], sequential=sequential, n_estimators=15, weight="w").toPandas()
        # rows of even ids say the opposite and weigh nothing
        assert np.mean((got["p"] > 0.5) == (x[got["event_id"]] > 0)) > 0.75


def test_draws_of_many_trees_are_those_of_one_at_a_time(monkeypatch):
    r = np.random.default_rng(16)
    starts = np.sort(r.integers(0, 900, 300))
    # in order and not, of one length and of several, few that meet and many, one event
    for t0, length in ((np.arange(300), 5), (starts, r.integers(0, 40, 300)), (r.permutation(starts), r.integers(0, 9, 300)), (r.permutation(starts), r.integers(0, 90, 300)), (starts, 800), (np.array([3]), 2)):
        many, one = ([np.random.default_rng([1, k]) for k in range(3)] for _ in range(2))
        rows, unique = trees.sequential_bootstraps(t0, t0 + length, 350, many)
        for k, rng in enumerate(one):
            want, u = trees.sequential_bootstrap(t0, t0 + length, 350, rng)
            assert (rows[k] == want).all() and np.allclose(unique[k], u) and many[k].random() == rng.random()
    # a forest no longer makes all chances anew for each draw
    monkeypatch.setattr(trees, "sequential_bootstrap", None)
    t, x = np.arange(2000), r.standard_normal((2000, 2))
    draw = trees.sequential_draw(t, t + 5, None, 1.0)
    whole = Forest(4, 3).fit(x, (x[:, 0] > 0).astype(float), draw)
    monkeypatch.setattr(trees, "CELLS", 4000)  # two generators at a time
    parts = [Forest(4, 3).fit(x, (x[:, 0] > 0).astype(float), draw, part).trees for part in (range(1), range(1, 4))]
    assert [a.predict(x).tolist() for a in whole.trees] == [b.predict(x).tolist() for b in sum(parts, [])]


def test_folds_have_tasks_of_their_own(spark):
    r = np.random.default_rng(17)
    x = r.standard_normal(240)
    df = spark.createDataFrame([(k, k, k + 3, int(x[k] + r.standard_normal() > 0), float(x[k])) for k in range(240)], "event_id long, t0 long, t1 long, y int, x double")
    pdf = df.toPandas()
    for n_folds in (2, 4):  # on four cores: two tasks a fold, or one
        roles = C.purged_kfold(df.select("event_id", "t0", "t1"), n_folds)
        made = M.out_of_fold(df, roles, ["x"], n_estimators=7)
        got = made.toPandas().sort_values("event_id")
        assert got["event_id"].tolist() == list(range(240))
        for fold, part in roles.toPandas().groupby("fold"):
            train, test = (pdf[pdf["event_id"].isin(part.loc[part["role"] == role, "event_id"])] for role in ("train", "test"))
            draw = trees.sequential_draw(train["t0"].to_numpy(float), train["t1"].to_numpy(float), None, 1.0)
            want = Forest(7, 5, 5, seed=int(fold)).fit(train[["x"]].to_numpy(float), train["y"].to_numpy(float), draw).predict(test[["x"]].to_numpy(float))
            assert np.allclose(got[got["fold"] == fold]["p"], want, atol=1e-12)
    assert made.select(F.spark_partition_id()).distinct().count() == 4
    again = M.out_of_fold(df.unionByName(df.where("event_id = 5")), C.purged_kfold(df.select("event_id", "t0", "t1"), 2), ["x"], n_estimators=7)
    assert again.where("event_id = 5").count() == 2


@pytest.fixture(scope="module")
def events(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((400, 3))
    y = (x[:, 0] + 0.3 * r.standard_normal(400) > 0).astype(int)
    rows = [(k, 10 * k, 10 * k + int(r.integers(1, 40)), int(y[k]), float(0.01 * (2 * y[k] - 1) + 0.002 * r.standard_normal()), *map(float, x[k])) for k in range(400)]
    return spark.createDataFrame(rows, "event_id long, t0 long, t1 long, y int, ret double, a double, b double, c double").cache()


def test_meta_models_beat_the_naive_share_out_of_sample(events):
    made = T.train_meta(events, ["a", "b", "c"], n_splits=3, n_estimators=15)
    per = T.fold_diagnostics(made, embargo=4).collect()
    assert len(per) == 3 and all(r.separated and r.beats_naive and r.brier < r.brier_naive and r.method in ("isotonic", "sigmoid") and r.model in ("sequential", "boosted") for r in per)
    one = events.withColumn("y", F.lit(1))
    assert T.train_meta(one, ["a"], n_splits=3, n_estimators=5).count() == 0
    with pytest.raises(ValueError):
        T.train_meta(events, [])


def test_walk_forward_fits_have_tasks_of_their_own(events):
    columns, options = ["a", "b", "c"], {"n_estimators": 6}
    made = T.train_meta(events, columns, n_splits=3, inner_splits=2, **options)
    assert made.select(F.spark_partition_id()).distinct().count() == 3
    # three folds, two models, two inner folds and the whole
    assert re.search(r"hashpartitioning\(task#\d+L?, 18\)", made._jdf.queryExecution().toString())
    got = made.toPandas().sort_values("event_id")
    horizons = events.select("event_id", "t0", "t1")
    rows = events.join(C.average_uniqueness(horizons), "event_id").join(C.walk_forward(horizons, 3).select("fold", "event_id", "role"), "event_id").toPandas().sort_values("t0")
    assert got["event_id"].tolist() == sorted(rows.loc[rows["role"] == "test", "event_id"])
    for fold, pdf in rows.groupby("fold"):
        train, test = (pdf[pdf["role"] == role] for role in ("train", "test"))
        given = (train[columns].to_numpy(), train["y"].to_numpy(float), train["u"].to_numpy(), train["t0"].to_numpy(), train["t1"].to_numpy())
        both = {name: K.calibrated(name, given, (test[columns].to_numpy(), test["y"].to_numpy(float)), options, 2, int(len(train) * 0.01), int(fold)) for name in ("sequential", "boosted")}
        name = min(both, key=lambda k: both[k]["brier"])
        own = got[got["fold"] == fold]
        assert np.allclose(own["p"], both[name]["p"]) and np.allclose(own["raw"], both[name]["raw"])
        assert set(own["model"]) == {name} and set(own["method"]) == {both[name]["method"]} and set(own["n_train"]) == {len(train)} and set(own["train_t1_max"]) == {train["t1"].max()}
    # a fold whose test rows are of one class gives no rows
    late = T.train_meta(events.withColumn("y", F.when(F.col("event_id") >= 306, 1).otherwise(F.col("y"))), columns, n_splits=3, n_estimators=3)
    assert {r.fold for r in late.select("fold").distinct().collect()} == {0, 1}


def test_trees_that_share_sorted_rows_are_the_same():
    r = np.random.default_rng(18)
    x, y, w = np.round(r.standard_normal((300, 4)), 1), r.random(300), r.random(300)
    for depth in (1, 4, None):
        a, b = Tree(depth, 5).fit(x, y, w), Tree(depth, 5).fit(x, y, w, trees.sorted_rows(x))
        assert all((p == q).all() for p, q in zip(a.arrays, b.arrays))


def test_the_gate(events):
    cohort = [T.Candidate("deep", "forest", {"n_estimators": 12, "max_depth": 5}), T.Candidate("stump", "forest", {"n_estimators": 12, "max_depth": 1})]
    good = T.validate_strategy(events, ["a", "b", "c"], cohort, n_trials=40, std_of_trials=0.05, n_shuffles=10).first()
    assert good.incumbent == "deep" and good.n_splits == 15 and good.pbo < 0.5 and good.dsr > 0.95 and good.p_value == 0 and not good.quarantined
    few = T.validate_strategy(events, ["a", "b", "c"], cohort, n_trials=5, std_of_trials=0.05, n_shuffles=5).first()
    assert few.quarantined and few.dsr == 0 and not few.passes
    made = T.cohort_predictions(events, C.cpcv_folds(events.select("event_id", "t0", "t1")), ["a"], cohort)
    assert T.cohort_performance(made).where("is_perf is null or oos_perf is null").count() == 0
    with pytest.raises(ValueError):
        T.validate_strategy(events, ["a"], cohort[:1], 40)


def test_batches_of_bets(spark):
    r = np.random.default_rng(8)
    p = np.where(r.uniform(size=200) < 0.5, r.uniform(0.5, 0.55, 200), r.uniform(0.95, 0.999, 200))
    sizes, mixed, value = E.batch_sizes(p)
    assert mixed and value < 0.05 and ((sizes >= 0) & (sizes <= 1)).all() and sizes[p > 0.95].min() > sizes[p < 0.55].max()
    few, mixed, value = E.batch_sizes(np.array([0.2, 0.5, 0.7]))
    assert few[:2].tolist() == [0, 0] and few[2] == pytest.approx(stats.bet_size(0.7)) and not mixed and math.isnan(value)
    w, m, s = E.mixture(np.concatenate([r.normal(-3, 0.5, 3000), r.normal(2, 1, 1000)]))
    assert np.allclose(w, [0.75, 0.25], atol=0.02) and np.allclose(m, [-3, 2], atol=0.1) and np.allclose(s, [0.5, 1], atol=0.1)
    df = spark.createDataFrame([("x", 1, k, "EURUSD", "fx", "long", v, 1.0) for k, v in enumerate([0.6, 0.9, 0.4, None])], "account string, batch int, signal_id long, asset string, asset_class string, side string, p double, price double")
    got = {x.signal_id: x for x in E.execute_batch(df, equity=10.0).collect()}
    assert got[1].status == got[0].status == "filled" and got[2].status == got[3].status == "skipped" and got[1].size > got[0].size
    assert got[1].margin == pytest.approx(got[1].size / 30 * 10) and E.execute_batch(df, equity=10.0, committed=9.0).where("status = 'filled'").count() == 0


def test_ledger_and_positions(spark):
    rows = [("x", "a", 1, "open", "long", 2.0, 10.0, 1.0), ("x", "b", 2, "open", "short", 1.0, 5.0, 2.0), ("x", "a", 3, "close", None, None, 12.0, None), ("x", "a", 4, "close", None, None, 9.0, None), ("x", "b", 5, "open", "long", 3.0, 6.0, 4.0)]
    orders = spark.createDataFrame(rows, "account string, asset string, seq long, action string, side string, size double, price double, margin double")
    got = {x.seq: (x.pnl, x.held) for x in E.ledger(orders).collect()}
    assert got == {1: (None, 1.0), 2: (None, 3.0), 3: (4.0, 2.0), 4: (None, 2.0), 5: (None, 4.0)}
    left = E.positions(orders)
    assert [tuple(x) for x in left.collect()] == [("x", "b", "long", 3.0, 6.0, 4.0)] and E.rehydrate(left).first().committed == 4.0
    closed = E.flatten(left, spark.createDataFrame([("b", 7.0)], "asset string, price double")).first()
    assert closed.pnl == 3.0 and closed.side == "short" and E.flatten(left, spark.createDataFrame([], "asset string, price double")).first().pnl == 0


def test_regime_and_drift(spark):
    r = np.random.default_rng(9)
    walk = np.cumsum(r.standard_normal(120))
    bubble = np.concatenate([walk[:80], walk[79] + 2 * 1.12 ** np.arange(40)])
    rows = [(n, k, float(v)) for n, s in (("walk", walk), ("bubble", bubble), ("short", walk[:6])) for k, v in enumerate(s)]
    checks, found = G.check_regime(spark.createDataFrame(rows, "asset string, seq long, value double"), simulations=60)
    checks = {x.asset: x for x in checks.collect()}
    assert checks["bubble"].bubble and not checks["short"].bubble and checks["short"].f_stat is None and checks["walk"].f_stat is not None
    assert {"bubble"} <= {x.asset for x in found.collect()} and checks["walk"].critical == checks["bubble"].critical
    one = G.detect_bubble(spark.createDataFrame([x for x in rows if x[0] == "bubble"], "asset string, seq long, value double"), 120, simulations=60).first()
    assert one.bubble
    x = r.standard_normal((300, 4))
    data = [(g, k, "train" if k < 200 else "live", int(x[k, 0] + 0.5 * x[k, 1] > 0), *map(float, x[k] if g == "same" or k < 200 else x[k] * [0, 0, 5, 9])) for g in ("same", "moved") for k in range(300)]
    shap = G.shap_importance(spark.createDataFrame(data, "grp string, event_id long, role string, y int, a double, b double, c double, d double"), list("abcd"), "grp", n_estimators=10)
    by = {(s.grp, s.feature): s for s in shap.collect()}
    assert by["same", "a"].train > by["same", "b"].train > by["same", "c"].train
    checks, alerts = G.check_drift(shap, "grp")
    assert {c.grp: c.drift for c in checks.collect()}["same"] is False and alerts.columns == ["producer", "grp", "rho"]


def test_features_composed_and_judged_twice(spark):
    r = np.random.default_rng(10)
    close = 100 + np.cumsum(r.standard_normal(400)) / 10
    bars = spark.createDataFrame([("a", k + 1, k * 60_000_000, float(c), float(c + 0.1), float(c - 0.1), float(c), 10.0 + k % 7) for k, c in enumerate(close)], "asset string, seq long, ts_us long, open double, high double, low double, close double, volume double")
    f, report = D.compute_features(bars, windows=(10,), entropy=(20,))
    judged = {x.feature: x.verdict for x in report.collect()}
    stay = sorted(k for k, v in judged.items() if v != "dropped")
    assert sorted(c for c in f.columns if c not in ("asset", "seq", "ts_us")) == stay and len(judged) == 8 and f.count() > 100
    assert f.dropna().count() == f.count()
    events = bars.where("seq % 50 = 0").select("asset", "seq")
    at, none = D.compute_features(bars, events, (10,), (20,), enforce=False)
    assert none is None and at.count() < 9


def test_selection_and_other_odds(spark, events):
    roles = C.purged_kfold(events.select("event_id", "t0", "t1"), 3)
    chosen, halted = S.select_features(events, roles, ["a", "b", "c"], n_estimators=15)
    assert not halted and "a" in chosen
    assert V.bonferroni(0.05, 10) == 0.005 and C.n_splits(6, 2) == 15 and C.n_paths(6, 2) == 5
    paths = C.oos_paths(spark.createDataFrame([(0, 0, 7, 1.5)], "fold long, grp long, event_id long, value double"), 4, 2)
    assert [tuple(x) for x in paths.collect()] == [(0, 7, 1.5)]
    bets = spark.createDataFrame([(0, 1.0, 1, 0.1), (0, 1.0, 1, 0.3), (1, 1.0, 1, 0.2)], "fold int, bet double, side_sign int, ret double")
    assert V.oos_sharpe(bets).first().objective == pytest.approx(0.2 / (0.02**0.5))
    assert R.REGIMES["day"].bar_hours == 1.5 and R.REGIMES["day"].vertical_bars == 16
    with pytest.raises(ValueError):
        R.HoldingRegime("x", 1, 2, 1, 2)
    p = np.array([0.2, 0.5, 0.51, 0.9, 1.0, np.nan])
    assert np.allclose(stats.bet_sizes(p)[:5], [stats.bet_size(v) for v in p[:5]], atol=1e-12) and stats.bet_sizes(p)[5] == 0
    text = R.report(spark.createDataFrame([(1, 2.0)], "a int, b double"), "Run", spark.createDataFrame([("x",)], "name string"))
    assert text.startswith("# Run") and "## Survivors" in text


def test_holm_in_ranges_equals_one_pass(spark):
    r = np.random.default_rng(11)
    p = np.concatenate([r.uniform(0, 1e-4, 40), r.uniform(0, 1, 200), [1e-5, 1e-5, 1.0, 0.0]])
    got = {x.name: (x.threshold, x.rejected) for x in V.holm(spark.createDataFrame([(f"{k:03d}", float(v)) for k, v in enumerate(p)], "name string, p double")).collect()}
    order, going = sorted(range(len(p)), key=lambda k: (p[k], f"{k:03d}")), True
    for place, k in enumerate(order):
        level = 0.05 / (len(p) - place)
        going = going and p[k] < level
        assert got[f"{k:03d}"] == (pytest.approx(level), going)


def test_trials_and_certification(spark, tmp_path):
    r = np.random.default_rng(12)
    n = 3000
    mid = 100 * np.exp(np.cumsum(r.standard_normal(n)) / 2000)
    ticks = spark.createDataFrame([("EURUSD", k * 60_000_000, k, float(m), 1.0, 1.0) for k, m in enumerate(mid)], "asset string, ts_us long, tick_id long, mid double, bid_volume double, ask_volume double")
    regime = R.HoldingRegime("test", 2, 0.4, 1.0, 2)
    pc = T.precompute(ticks, "EURUSD", regime)
    assert pc.bar_type in ("time", "imbalance", "run") and pc.vertical_bars == 10 and pc.n_bars == pc.bars.count() > 100
    registry = R.Registry(spark, str(tmp_path / "registry"))
    small = {"windows": (10,), "entropy_windows": (20,), "least": 20, "vol_span": 20, "enforce": False}
    got = T.run_trial(pc, "donchian", {"window": 10}, registry, n_splits=3, n_estimators=8, **small)
    assert got["status"] in ("completed", "failed_mda") and got["n_events"] >= 20 and T.cohort_trials(registry, "EURUSD", "donchian") == 1
    assert T.run_trial(pc, "donchian", {"window": 10}, registry, least=10_000)["status"] == "invalid"
    verdict = T.certify(pc, "donchian", {"window": 10}, registry, n_estimators=6, depths=(2, 3), n_splits=3, dataset=small, n_shuffles=3)
    assert verdict["status"] in ("certified", "rejected", "data_leakage", "halted_at_mda", "degenerate_cpcv")
    assert T.certify(pc, "donchian", {"window": 10}, registry, dataset={"least": 10_000})["status"] == "insufficient_events"
    labels = T.run_detectors(pc.bars, {"donchian": {"window": 10}, "bollinger": {"sma_span": 10}}, registry, vertical_bars=5, vol_span=20)
    assert {x.plugin_family for x in labels.select("plugin_family").distinct().collect()} <= {"donchian", "bollinger"} and registry.total_trials() == 2
    years = T.periods_per_year(spark.createDataFrame([("a", 0), ("a", 31_557_600_000_000), ("b", 5)], "asset string, ts_us long"))
    assert {x.asset: round(x.periods, 6) for x in years.collect()} == {"a": 2.0, "b": 252.0}


def test_ranks_and_complexity_in_batches_equal_frames():
    r = np.random.default_rng(13)
    ret = np.round(r.standard_normal(300) / 100, 3)
    ret[[0, 40, 41, 200]] = np.nan
    rows = pd.DataFrame({"asset": "a", "seq": np.arange(300), "x_ret": ret})
    got = in_parts(scans.Entropies((7, 30), 4), rows, [1, 2, 3, 100, 194])
    for n in (7, 30):
        bins = []
        for t in range(300):
            frame = ret[max(0, t - n + 1) : t + 1]
            known = int((~np.isnan(frame)).sum())
            bins.append(min(int((frame < ret[t]).sum()) * 4 // known, 3) if len(frame) == n and not np.isnan(ret[t]) and known >= 2 else None)
        assert [None if pd.isna(b) else int(b) for b in got[f"x_bin{n}"]] == bins
        want = [kernels.lz_complexity(bins[t - n : t], 4) if t >= n and None not in bins[t - n : t] else math.nan for t in range(300)]
        assert np.allclose(got[f"x_lz{n}"], want, equal_nan=True) and not np.isnan(want).all()


def test_command_line(spark, tmp_path, capsys):
    from marketlab.__main__ import main

    assert main(["list"]) == 0 and "time_bars_1h" in capsys.readouterr().out
    rows = [(k, datetime(2024, 1, 1 + k // 24, k % 24), k % 3, "click", float(50 + (k * 7919) % 13 - 6), '{"k": 3}') for k in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id int, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    assert main(["query", "time_bars_1d", str(tmp_path), "--out", str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 9
    assert main(["sweep", str(tmp_path), "--asset", "click", "--family", "donchian", "--registry", str(tmp_path / "r"), "--report", str(tmp_path / "run.md")]) == 0
    assert (tmp_path / "run.md").read_text().count("invalid") == 30
    assert main(["doctor", f"x={tmp_path}/none", "--registry", str(tmp_path / "r")]) == 1 and "BAD x" in capsys.readouterr().out
