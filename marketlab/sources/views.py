"""Scans, and the price-like views that the library's queries run on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TICK_COLUMNS = ("timestamp", "ask", "bid", "ask_volume", "bid_volume")


@dataclass(frozen=True)
class Asset:
    """An instrument and where its ticks are: partitions by asset, those of the out-of-sample period in a folder of their own."""

    symbol: str
    asset_class: str

    def data_path(self, root: str) -> str:
        return f"{root.rstrip('/')}/asset={self.symbol}"

    def oos_data_path(self, root: str) -> str:
        return f"{root.rstrip('/')}/out_of_sample/asset={self.symbol}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it; a local master may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or "file:///tmp/checkpoints/marketlab").rstrip("/")


def micros(value: date | datetime) -> int:
    """Microseconds of the epoch; a date or naive time counts as UTC."""
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return round(value.timestamp() * 1_000_000)


def load_ticks(spark: SparkSession, path: str, start: date | datetime | None = None, end: date | datetime | None = None, columns: Sequence[str] | None = None, time: str = "timestamp") -> DataFrame:
    """Scan a Parquet tick file: rows with start <= time < end, then the named columns. Both reach the scan.

    A path that does not exist raises Spark's AnalysisException at once.
    """
    df = spark.read.parquet(path)
    kind = dict(df.dtypes).get(time)
    literal = (lambda t: F.timestamp_micros(F.lit(micros(t)))) if kind == "timestamp" else (lambda t: F.timestamp_micros(F.lit(micros(t))).cast("timestamp_ntz"))
    if start is not None:
        df = df.where(F.col(time) >= literal(start))
    if end is not None:
        df = df.where(F.col(time) < literal(end))
    return df.select(*columns) if columns else df


def verify_schema(df: DataFrame, required: Sequence[str] = TICK_COLUMNS) -> None:
    """Raise ValueError if a required column is absent; reads no data."""
    if absent := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {absent}")


def ts_us(c: str) -> Column:
    """Microseconds of the epoch of a timestamp column with or without a zone, taken as UTC."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: asset, ts_us, tick_id, mid, bid, ask, bid_volume, ask_volume.

    The price is the exponential of a running sum of whole numbers, so it does not depend on the order of summation.
    """
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), ts_us("ts").alias("ts_us"), F.col("event_id").alias("tick_id"), "value", "props")
    w = Window.partitionBy("asset").orderBy("ts_us", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.round((F.col("value") - 50) * 100).cast("long")
    return e.withColumn("mid", 100 * F.exp(F.sum(step).over(w) / F.lit(1e6))).select(
        "asset",
        "ts_us",
        "tick_id",
        "mid",
        (F.col("mid") - 0.01).alias("bid"),
        (F.col("mid") + 0.01).alias("ask"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("bid_volume"),
        (1 + F.col("tick_id") % 7).cast("double").alias("ask_volume"),
    )


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as label horizons: event_id, t0, t1 in days of the epoch, t1 never before t0."""
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.max(ts_us("l_shipdate")).alias("last"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), ts_us("o_orderdate").alias("t0"))
    day = 86_400_000_000
    return o.join(ship, "event_id").select("event_id", F.expr(f"t0 div {day}").alias("t0"), F.expr(f"greatest(t0, last) div {day}").alias("t1"))
