"""Research plans: the flagship label query, parameter grids, sweeps, registry and reports."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.operators import bars as B
from marketlab.operators import labels as L
from marketlab.operators import validation as V
from marketlab.functions.rolling import by_asset, rolling
from marketlab.sources.views import shared_folder, ticks, verify_schema


def rolling_volatility(bars: DataFrame, span: int = 20) -> DataFrame:
    """(asset, seq, vol): deviation of the span log returns before each bar."""
    r = B.log_returns(bars)
    return r.select("asset", "seq", rolling(F.stddev_samp, F.col("ret"), by_asset(), span, 1).alias("vol"))


def label_rates(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    """Ticks to time bars to band crossings to triple-barrier labels to label rates: the flagship query."""
    bars = B.time_bars(ticks(spark, sf_dir), interval)
    found = L.triple_barrier(bars, L.bollinger_events(bars), vol=rolling_volatility(bars))
    return L.label_balance(found)


@dataclass(frozen=True)
class HoldingRegime:
    """Bar granularity from a holding target: span days, mean and longest holding in hours, profit-take multiple."""

    name: str
    span_days: float
    mean_hold_h: float
    max_hold_h: float
    profit_take: float

    def __post_init__(self):
        if self.mean_hold_h <= 0 or self.profit_take <= 0 or self.max_hold_h < self.mean_hold_h:
            raise ValueError("holding times and the multiple are positive, and the longest is at least the mean")

    @property
    def bar_hours(self) -> float:
        return self.mean_hold_h / self.profit_take**2

    @property
    def vertical_bars(self) -> int:
        return max(1, round(self.max_hold_h / self.bar_hours))

    @property
    def target_bars(self) -> float:
        return self.span_days * 24 / self.bar_hours


#: Mean and longest holding in hours, for a span of 90 days and a multiple of 2.
REGIMES = {
    "scalp": HoldingRegime("scalp", 90, 1, 4, 2),
    "day": HoldingRegime("day", 90, 6, 24, 2),
    "swing": HoldingRegime("swing", 90, 120, 480, 2),
    "position": HoldingRegime("position", 90, 480, 2000, 2),
}

#: Parameter axes by family: (name, values), (name, values).
GRIDS = {
    "cusum": (("threshold_multiplier", (1.0, 1.5, 2.0, 2.5, 3.0)), ("vol_span", (20, 50, 100, 150, 200, 300))),
    "bollinger": (("sma_span", (10, 15, 20, 30, 40, 50)), ("num_std", (1.0, 1.5, 2.0, 2.5, 3.0))),
    "donchian": (("window", (10, 20, 30, 40, 50, 60)), ("vertical_bars", (5, 10, 15, 20, 30))),
}


def grid(spark: SparkSession, family: str) -> DataFrame:
    """(i, j, first, second): every point of a family's grid."""
    (_, a), (_, b) = GRIDS[family]
    axis = lambda values, at, value: spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"{at} long, {value} double")
    return axis(a, "i", "first").crossJoin(F.broadcast(axis(b, "j", "second")))  # two axes of a few values


def sweep(bars: DataFrame, family: str, vol_span: int = 100, least_events: int = 1, axes: tuple | None = None) -> DataFrame:
    """(i, j, n, score): mean over deviation of signed label returns at every grid point; null under least_events labels.

    Bars and volatility are written once, to the shared folder, and read by every grid point, one branch each of a single plan.
    """
    (na, va), (nb, vb) = axes or GRIDS[family]
    spark, folder = bars.sparkSession, f"{shared_folder(bars.sparkSession)}/sweep-{uuid.uuid4().hex[:12]}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    bars = kept(bars, "bars")
    vol = kept(L.ewm_volatility(bars, vol_span).select("asset", "seq", "vol"), "vol")
    rows = None
    for i, a in enumerate(va):
        for j, b in enumerate(vb):
            options = {na: a, nb: b}
            vertical = int(options.pop("vertical_bars", 20))
            events = L.detector(family)(bars, **{k: int(v) if isinstance(v, int) else v for k, v in options.items()})
            one = L.triple_barrier(bars, events, vol=vol, vertical_bars=vertical).select(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), "signed_return")
            rows = one if rows is None else rows.unionByName(one)
    per = rows.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("signed_return").alias("m"), F.stddev_samp("signed_return").alias("s"))
    return per.select("i", "j", "n", F.when((F.col("n") >= least_events) & (F.col("s") > 1e-12), F.col("m") / F.col("s")).alias("score"))


def sweep_and_select(bars: DataFrame, family: str, **options) -> DataFrame:
    """The plateau of a family's sweep."""
    return V.plateau(sweep(bars, family, **options))


def parameters_hash(params: Column) -> Column:
    """SHA-256 of a map's entries in order of their keys, as JSON."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params)))), 256)


class Registry:
    """Experiments in an append-only Parquet table. Changes are rows too; the latest row of an id is its state. One writer at a time."""

    SCHEMA = "experiment_id string, asset string, family string, params map<string,double>, params_hash string, status string, metric double, deployed boolean, version long, at timestamp"
    STATUS = ("completed", "failed_mda", "failed_validation", "validated")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def current(self) -> DataFrame:
        latest = self.rows().groupBy("experiment_id").agg(F.max_by(F.struct("asset", "family", "params", "params_hash", "status", "metric", "deployed", "version", "at"), "version").alias("x"))
        return latest.select("experiment_id", "x.*")

    def record(self, experiments: DataFrame) -> int:
        """Append experiments (asset, family, params, status, metric) whose (asset, family, parameters) are new; the number appended."""
        bad = experiments.where(~F.col("status").isin(*self.STATUS)).limit(1).count()
        if bad:
            raise ValueError(f"status must be one of {self.STATUS}")
        keyed = experiments.withColumn("params_hash", parameters_hash(F.col("params"))).dropDuplicates(["asset", "family", "params_hash"])
        new = keyed.join(self.rows().select("asset", "family", "params_hash"), ["asset", "family", "params_hash"], "left_anti")
        new = new.select(F.sha2(F.concat_ws("|", "asset", "family", "params_hash"), 256).alias("experiment_id"), "asset", "family", "params", "params_hash", "status", F.col("metric").cast("double").alias("metric"), F.lit(False).alias("deployed"), F.lit(0).cast("long").alias("version"), F.current_timestamp().alias("at")).persist()
        try:
            # ids are digests of the key, so a row that is made again has the same one
            n = new.count()
            if n:
                new.write.mode("append").parquet(self.path)
        finally:
            new.unpersist()
        return n

    def update(self, experiment_id: str, **changes) -> None:
        """Append a changed row; an unknown id raises KeyError."""
        row = self.current().where(F.col("experiment_id") == experiment_id).cache()
        if not row.count():
            raise KeyError(experiment_id)
        row = row.withColumns({k: F.lit(v) for k, v in changes.items()} | {"version": F.col("version") + 1, "at": F.current_timestamp()})
        self.spark.createDataFrame(row.select([c.split()[0] for c in self.SCHEMA.split(", ")]).collect(), self.SCHEMA).write.mode("append").parquet(self.path)

    def update_all(self, ids: DataFrame, **changes) -> None:
        """Append a changed row for each of the ids (experiment_id) that there are."""
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        rows = self.current().join(ids, "experiment_id", "left_semi").withColumns({k: F.lit(v) for k, v in changes.items()} | {"version": F.col("version") + 1, "at": F.current_timestamp()}).select(names)
        # read before anything is written to the same folder
        rows = rows.persist()
        try:
            if rows.count():
                rows.write.mode("append").parquet(self.path)
        finally:
            rows.unpersist()

    def trials(self, **where: str) -> DataFrame:
        df = self.current()
        for k, v in where.items():
            df = df.where(F.col(k) == v)
        return df.orderBy(F.desc("at"), "experiment_id")

    def total_trials(self) -> int:
        return self.current().count()

    def deployed(self) -> DataFrame:
        return self.current().where("deployed")

    def awaiting_signoff(self) -> DataFrame:
        return self.current().where("status = 'validated' and not deployed")


def run_document(run: dict) -> str:
    """A run as JSON; values that are not finite become null, tuples lists."""
    def plain(x):
        if isinstance(x, float):
            return x if math.isfinite(x) else None
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(run), sort_keys=True)


def write_run(spark: SparkSession, run: dict, path: str) -> None:
    spark.createDataFrame([(run_document(run),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def report(summary: DataFrame, title: str, survivors: DataFrame | None = None) -> str:
    """A small result as a Markdown table, and the configurations that survived as a second one."""
    if survivors is not None:
        return report(summary, title) + "\n" + report(survivors, "Survivors").replace("# ", "## ", 1)
    head, rows = summary.columns, summary.collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), ""])


def doctor(spark: SparkSession, paths: dict[str, str], registry: Registry | None = None, max_window: int = 200) -> DataFrame:
    """(check, ok, detail): whether each tick file can be read with the columns it must have and rows enough, and whether the registry can be read."""
    rows = []
    for name, path in sorted(paths.items()):
        try:
            df = spark.read.parquet(path)
            verify_schema(df)
            n, least = df.count(), 50 * (max_window + 500)
            rows.append((name, n >= least, f"{n} rows, {least} needed"))
        except (ValueError, AnalysisException) as e:
            rows.append((name, False, str(e).splitlines()[0]))
    if registry is not None:
        rows.append(("registry", True, f"{registry.total_trials()} experiments"))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def check_warmup(ticks_df: DataFrame, max_window: int = 200) -> DataFrame:
    """(asset, n, ok): at least 50 * (max_window + 500) ticks."""
    return ticks_df.groupBy("asset").agg(F.count("*").alias("n")).withColumn("ok", F.col("n") >= 50 * (max_window + 500))
