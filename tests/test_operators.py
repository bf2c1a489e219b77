import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlab.operators import bars as B
from marketlab.operators import features as X
from marketlab.operators import folds as C
from marketlab.operators import labels as L
from marketlab.operators import stationarity as D
from marketlab.operators import validation as V
from marketlab.plans import research as R
from marketlab.sources import views


def bars_of(spark, close, high=None, low=None, asset="a"):
    n = len(close)
    rows = [(asset, i + 1, i * 60_000_000, float(c), float(high[i] if high else c), float(low[i] if low else c), float(c), 1.0 + i % 3, 1) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "asset string, seq long, ts_us long, open double, high double, low double, close double, volume double, n_ticks long")


TICK = "asset string, ts_us long, tick_id long, mid double, bid_volume double, ask_volume double"


def test_time_bars_break_ties_by_tick_id(spark):
    rows = [("a", 0, 2, 5.0, 1.0, 1.0), ("a", 0, 1, 4.0, 1.0, 1.0), ("a", 61_000_000, 3, 7.0, 1.0, 2.0)]
    got = B.time_bars(spark.createDataFrame(rows, TICK), "1m").orderBy("seq").collect()
    assert [(r.open, r.close, r.volume, r.n_ticks, r.ts_us) for r in got] == [(4.0, 5.0, 4.0, 2, 0), (7.0, 7.0, 3.0, 1, 60_000_000)]


def test_empty_ticks_give_empty_bars(spark):
    empty = spark.createDataFrame([], TICK)
    assert B.time_bars(empty).count() == B.imbalance_bars(empty).count() == B.tick_signs(empty).count() == 0


def test_flat_prices_fire_no_detector(spark):
    flat = bars_of(spark, [100.0] * 60)
    for family in L.DETECTORS:
        assert L.detector(family)(flat).count() == 0


def test_registering_twice(spark):
    L.register_alpha("cusum")(L.cusum_events)
    with pytest.raises(ValueError):
        L.register_alpha("cusum")(lambda bars: bars)
    X.register_feature(X.FeatureSpec("roll", X.roll))
    with pytest.raises(ValueError):
        X.register_feature(X.FeatureSpec("roll", X.ofi))


@pytest.mark.parametrize(
    "side,high,low,hit,label,price",
    [
        ("long", [100, 100.5, 102], [100, 99.5, 100], "upper", 1, 101.0),
        ("long", [100, 100.5, 100], [100, 99.5, 98], "lower", 0, 99.0),
        ("short", [100, 100.5, 100], [100, 99.5, 98], "lower", 1, 99.0),
        ("long", [100, 102, 100], [100, 98, 100], "lower", 0, 99.0),
        ("short", [100, 102, 100], [100, 98, 100], "upper", 0, 101.0),
        ("long", [100, 100.2, 100.2], [100, 99.9, 99.9], "vertical", 0, 100.0),
    ],
)
def test_triple_barrier(spark, side, high, low, hit, label, price):
    bars = bars_of(spark, [100.0] * 3, high, low)
    events = spark.createDataFrame([("a", 1, 0, side), ("a", 99, 0, side)], "asset string, seq long, ts_us long, side string")
    vol = spark.createDataFrame([("a", 1, 0.01)], "asset string, seq long, vol double")
    (r,) = L.triple_barrier(bars, events, vol=vol).collect()
    assert (r.barrier_hit, r.label) == (hit, label) and r.exit_price == pytest.approx(price)


def test_event_on_the_last_bar_and_zero_volatility(spark):
    bars = bars_of(spark, [100.0, 101.0, 102.0])
    events = spark.createDataFrame([("a", 3, 0, "long"), ("a", 2, 0, "long")], "asset string, seq long, ts_us long, side string")
    vol = spark.createDataFrame([("a", 3, 0.01), ("a", 2, 0.0)], "asset string, seq long, vol double")
    (r,) = L.triple_barrier(bars, events, vol=vol).collect()
    assert (r.seq, r.exit_seq, r.barrier_hit, r.return_pct) == (3, 3, "vertical", 0.0)


def test_features_of_a_prefix_are_a_prefix_of_the_features(spark):
    close = (100 + np.random.default_rng(1).standard_normal(120).cumsum()).tolist()
    cols = [f"{f}_w10" for f in ("roll", "corwin_schultz", "ofi", "hasbrouck", "kyle", "amihud")] + ["shannon_w20", "lempel_ziv_w20"]
    make = lambda n: X.raw_features(bars_of(spark, close[:n], [c + 0.5 for c in close[:n]], [c - 0.5 for c in close[:n]]), (10,), (20,)).orderBy("seq").select(cols).toPandas()
    full, part = make(120), make(80)
    pd.testing.assert_frame_equal(full.iloc[:80], part, check_exact=False, rtol=1e-9)
    assert full.iloc[60:].notna().all().all()


def test_forward_fill_stops_at_its_limit(spark):
    values = [1.0, *[None] * 6, 2.0, float("nan"), 3.0]
    df = spark.createDataFrame([("a", i, 0, v) for i, v in enumerate(values)], "asset string, seq long, ts_us long, f double")
    assert [(r.seq, r.f) for r in X.clean(df, 5).orderBy("seq").collect()] == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 2), (8, 2), (9, 3)]
    with pytest.raises(ValueError):
        X.assert_finite(df)


def test_alignment_and_thinning(spark):
    bars = bars_of(spark, range(1, 11))
    events = spark.createDataFrame([("a", 1), ("a", 2), ("a", 50)], "asset string, seq long")
    kept, report = X.align(events, bars)
    assert kept.count() == 2 and report.first()["n_dropped"] == 1
    assert [r.seq for r in X.thin(bars, 4).orderBy("seq").collect()] == [1, 4, 7, 10]


def test_ffd_expression_equals_convolution(spark):
    s = bars_of(spark, np.random.default_rng(2).standard_normal(200).cumsum().tolist()).select("asset", "seq", F.col("close").alias("value"))
    a, b = (D.ffd_series(s, 0.5, 1e-2, longest=k).orderBy("seq").toPandas() for k in (512, 1))
    assert np.allclose(a["value"], b["value"]) and a["seq"].tolist() == b["seq"].tolist()


def test_stationarity_gate_and_leaks(spark):
    r = np.random.default_rng(3)
    rows = [("a", i, 0, float(x), float(y), 1.0) for i, (x, y) in enumerate(zip(r.standard_normal(200), r.standard_normal(200).cumsum()))]
    f = spark.createDataFrame(rows, "asset string, seq long, ts_us long, noise double, walk double, flat double")
    series, report = D.stationarity_gate(f, tol=1e-2)
    verdict = {x.feature: x.verdict for x in report.collect()}
    assert verdict["noise"] == verdict["flat"] == "passed" and verdict["walk"] in ("rescued", "dropped", "passed")
    one = f.select("asset", "seq", F.col("noise").alias("value"))
    D.assert_no_leakage(one, one.where("seq < 100"), 99)
    with pytest.raises(AssertionError):
        D.assert_no_leakage(one, one.where("seq < 100").withColumn("value", F.col("value") + (F.col("seq") == 50).cast("double")), 99)
    hashes = {x["hash"] for d in (one, one.orderBy(F.desc("seq"))) for x in D.truncation_hash(d, "value").collect()}
    assert len(hashes) == 1


H = "event_id long, t0 long, t1 long"


def test_uniqueness(spark):
    u = lambda rows: {r.event_id: r.u for r in C.average_uniqueness(spark.createDataFrame(rows, H)).collect()}
    assert u([(1, 0, 1), (2, 5, 6)]) == {1: 1, 2: 1}
    assert u([(1, 0, 3), (2, 0, 3), (3, 0, 3)]) == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 1 / 3})
    assert u([(1, 0, 2), (2, 2, 4)]) == pytest.approx({1: 0.75, 2: 0.75})


def test_purged_folds_are_disjoint_and_complete(spark):
    h = spark.createDataFrame([(i, i, i + 3) for i in range(60)], H)
    p = C.purged_kfold(h, 5, 0.05).toPandas()
    assert sorted(p[p.role == "test"]["event_id"]) == list(range(60)) and len(p) == 300
    rows = {i: (i, i + 3) for i in range(60)}
    for _, f in p.groupby("fold"):
        test = [rows[i] for i in f[f.role == "test"]["event_id"]]
        lo, hi = min(a for a, _ in test), max(b for _, b in test)
        assert all(rows[i][1] < lo or rows[i][0] > hi for i in f[f.role == "train"]["event_id"])
    with pytest.raises(ValueError):
        C.purged_kfold(spark.createDataFrame([(1, 5, 2)], H))
    assert C.n_splits(6, 2) == 15 and C.n_paths(6, 2) == 5


def test_cpcv_purges_each_block(spark):
    h = spark.createDataFrame([(i, i, i) for i in range(60)], H)
    p = C.cpcv_folds(h, 6, 2, 0.0).toPandas()
    sizes = p[p.role == "train"].groupby("fold").size()
    assert (sizes == 40).all() and len(sizes) == 15


def test_walk_forward_trains_on_the_past(spark):
    h = spark.createDataFrame([(i, i, i + 2) for i in range(50)], H)
    p = C.walk_forward(h, 4, 0.0).toPandas()
    for _, f in p.groupby("fold"):
        assert f[f.role == "train"]["event_id"].max() + 2 < f[f.role == "test"]["event_id"].min()


def test_pbo_of_a_strategy_that_is_always_best_and_always_worst(spark):
    rows = [(s, k, float(k), float(k if good else -k)) for s in range(4) for k in range(3) for good in [True]]
    schema = "split long, strategy long, is_perf double, oos_perf double"
    assert V.pbo(spark.createDataFrame(rows, schema))[1].first()["pbo"] == 0
    assert V.pbo(spark.createDataFrame([(s, k, a, -b) for s, k, a, b in rows], schema))[1].first()["pbo"] == 1


def test_holm_stops_at_the_first_failure(spark):
    p = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.03), ("d", 0.6)], "name string, p double")
    assert {r.name for r in V.holm(p).where("rejected").collect()} == {"a"}


def test_plateau(spark):
    flat = [(i, j, 1.0 + (i == 2 and j == 2)) for i in range(5) for j in range(5)]
    got = V.plateau(spark.createDataFrame(flat, "i long, j long, score double")).where("best").collect()
    assert [(r.i, r.j, r.robust) for r in got] == [(1, 1, 1.0)]
    bad = [(i, j, None if (i, j) == (1, 1) else 1.0) for i, j, _ in flat]
    points = {(r.i, r.j) for r in V.plateau(spark.createDataFrame(bad, "i long, j long, score double")).collect()}
    assert (1, 1) not in points and (2, 2) not in points and (3, 3) in points


def test_risk_budget_is_never_exceeded(spark):
    s = spark.createDataFrame([("x", k, "crypto", 0.5) for k in range(8)], "account string, k long, asset_class string, size double")
    got = V.risk_margin(s, "k", equity=1000.0).orderBy("k").collect()
    assert [round(r.margin) for r in got] == [250, 250, 250, 150, 0, 0, 0, 0]


def test_spearman_and_chow(spark):
    p = spark.createDataFrame([(float(i), float(i * i)) for i in range(6)], "a double, b double")
    assert V.spearman(p).first()["rho"] == pytest.approx(1)
    assert V.spearman(p.withColumn("b", F.lit(1.0))).first()["rho"] == 0
    r = np.random.default_rng(5)
    still = r.standard_normal(200)
    broken = np.concatenate([still[:100], 50 + still[100:].cumsum()])
    f = lambda y: V.chow_test(alpha=0.001, series=bars_of(spark, y.tolist()).select("asset", "seq", F.col("close").alias("value"))).first()
    assert not f(still).is_break and f(broken).is_break


def test_registry(spark, tmp_path):
    reg = R.Registry(spark, str(tmp_path / "registry"))
    rows = spark.createDataFrame([("x", "cusum", {"k": 1.0}, "completed", 0.2)], "asset string, family string, params map<string,double>, status string, metric double")
    assert reg.record(rows) == 1 and reg.record(rows) == 0 and reg.total_trials() == 1
    (r,) = reg.trials(family="cusum").collect()
    reg.update(r.experiment_id, status="validated")
    assert reg.awaiting_signoff().count() == 1
    reg.update(r.experiment_id, deployed=True)
    assert reg.deployed().count() == 1 and reg.awaiting_signoff().count() == 0
    with pytest.raises(KeyError):
        reg.update("none", deployed=True)
    with pytest.raises(ValueError):
        reg.record(rows.withColumn("status", F.lit("odd")))


def test_run_documents_and_reports(spark, tmp_path):
    R.write_run(spark, {"a": float("inf"), "b": (1, 2)}, str(tmp_path / "run"))
    assert R.read_run(spark, str(tmp_path / "run")) == {"a": None, "b": [1, 2]}
    assert "| x |" in R.report(spark.createDataFrame([(1,)], "x int"), "t")
    assert R.grid(spark, "cusum").count() == 30
    h = R.HoldingRegime("swing", 2190, 42, 120, 5**0.5)
    assert h.vertical_bars == round(120 / h.bar_hours)


def test_sources(spark, tmp_path):
    from datetime import date, datetime

    df = spark.sql("select timestamp'2024-01-01 10:00:00' as timestamp, 1.0 as bid, 2.0 as ask, 1.0 as bid_volume, 1.0 as ask_volume")
    df.write.parquet(str(tmp_path / "t"))
    views.verify_schema(df)
    with pytest.raises(ValueError):
        views.verify_schema(df.drop("bid"))
    assert views.load_ticks(spark, str(tmp_path / "t"), date(2024, 1, 1), date(2024, 1, 2), ["bid"]).columns == ["bid"]
    assert views.load_ticks(spark, str(tmp_path / "t"), end=datetime(2024, 1, 1, 10)).count() == 0
    plan = views.load_ticks(spark, str(tmp_path / "t"), date(2024, 1, 1), None, ["bid"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual" in plan


def test_bet_sizes_and_scores(spark):
    p = spark.createDataFrame([(0.9, 1), (0.4, 0), (None, 1)], "p double, y int")
    assert [r.b for r in p.select(V.bet_size("p").alias("b")).collect()][1:] == [0.0, 0.0]
    assert V.scores(p.where("p is not null")).first()["brier"] == pytest.approx((0.01 + 0.16) / 2)
    ret = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).standard_normal(50)], "ret double")
    row = V.sharpe_moments(ret).first()
    assert math.isclose(row.sharpe, row.mean / row.std)
