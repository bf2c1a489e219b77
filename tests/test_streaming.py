import numpy as np
from pyspark.sql import functions as F

from marketlab.operators import bars as B
from marketlab.streaming import editions as E

TICK = "asset string, ts_us long, tick_id long, mid double, bid_volume double, ask_volume double"


def parts(spark, tmp_path, n=600, files=4):
    mid = 100 + np.random.default_rng(1).standard_normal(n).cumsum()
    rows = [("ab"[k % 2], k * 60_000_000, k, float(m), 1.0, float(k % 5)) for k, m in enumerate(mid)]
    for f in range(files):
        part = rows[f * n // files : (f + 1) * n // files]
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, TICK)


def run(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def read(spark, tmp_path):
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_information_bars_equal_batch(spark, tmp_path):
    batch = parts(spark, tmp_path)
    got = run(spark, E.stream_information_bars(read(spark, tmp_path), "imbalance", expected_ticks=10), tmp_path, "tib")
    assert rows(got) == rows(B.imbalance_bars(batch, expected_ticks=10)) and got.count() > 5


def test_time_bars_equal_batch_but_for_the_open_ones(spark, tmp_path):
    batch = parts(spark, tmp_path)
    ticks = read(spark, tmp_path).withColumn("ts", F.timestamp_micros("ts_us"))
    got = rows(run(spark, E.stream_time_bars(ticks, "1 hour", "0 seconds"), tmp_path, "time_bars"))
    want = rows(B.time_bars(batch, "1h").drop("seq"))
    assert got and set(got) <= set(want) and len(want) - len(got) <= 2


def test_messages_round_trip(spark):
    sent = spark.createDataFrame([("e1", "a", 5, "long", "cusum")], "event_id string, asset string, ts_us long, side string, plugin_family string")
    sent = sent.withColumns({"occurred_at": F.current_timestamp(), "producer": F.lit("p")})
    wire = E.encode(sent, "event_triggered").unionByName(spark.createDataFrame([("event_triggered", "{broken")], "channel string, value string"))
    good, bad = E.decode(wire, "event_triggered")
    assert [(r.asset, r.side) for r in good.collect()] == [("a", "long")] and bad.count() == 1


def test_cusum_equals_batch(spark, tmp_path):
    from marketlab.operators import labels as L

    mid = 100 * np.exp(np.random.default_rng(2).standard_normal(400).cumsum() / 100)
    made = [("ab"[k % 2], k // 2 + 1, k * 60_000_000, float(m)) for k, m in enumerate(mid)]
    bar = "asset string, seq long, ts_us long, close double"
    for f in range(4):
        spark.createDataFrame(made[f * 100 : (f + 1) * 100], bar).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    stream = lambda: spark.readStream.schema(bar).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    got = run(spark, E.stream_cusum(stream(), vol_span=20, threshold_multiplier=1.5), tmp_path, "cusum")
    want = L.cusum_events(spark.createDataFrame(made, bar), 20, 1.5)
    assert rows(got) == rows(want.select("asset", "seq", "ts_us", "side")) and got.count() > 10
    assert run(spark, E.stream_cusum(stream(), 0.05), tmp_path, "fixed").count() > 3
