"""Microstructure features over bars. Each is lagged by one bar, and null where its frame is not full.

All frames share one window specification (asset, seq), so a whole feature matrix costs one exchange and one sort; ranks and their complexity
are made in a pass over the bars in order, which costs another.
Families: roll, corwin_schultz, ofi, hasbrouck, kyle, amihud, shannon, lempel_ziv; columns are {family}_w{window}.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from marketlab.functions.rolling import by_asset, forward_fill, frame, rolling
from marketlab.functions.scans import Entropies, scan

WINDOWS = (10, 20, 30, 50, 75, 100, 150, 200)
ENTROPY_WINDOWS = (50, 100, 150, 200, 250)
BINS = 5


def W() -> WindowSpec:
    """The one window of all features."""
    return by_asset()


def base_columns(bars: DataFrame) -> DataFrame:
    """bars with the per-bar terms (prefix x_) of all features. Missing high and low count as close, missing volume as 1."""
    for c, default in (("high", F.col("close")), ("low", F.col("close")), ("volume", F.lit(1.0))):
        if c not in bars.columns:
            bars = bars.withColumn(c, default)
    dur = (F.col("ts_us") - F.lag("ts_us").over(W())) / 1e6
    b = bars.withColumns({"x_dp": F.col("close") - F.lag("close").over(W()), "x_ret": F.log("close") - F.log(F.lag("close").over(W())), "x_dt": dur})
    # the first bar inherits the second one's duration; a bar of no duration has none
    b = b.withColumn("x_dt", F.coalesce("x_dt", F.lead("x_dt").over(W())))
    b = b.withColumn("x_dt_ok", F.when(F.col("x_dt") > 0, F.col("x_dt")))
    flow = F.signum(F.coalesce("x_dp", F.lit(0.0)))
    b = b.withColumns(
        {
            "x_dp1": F.lag("x_dp").over(W()),
            "x_dp0": F.coalesce("x_dp", F.lit(0.0)),
            "x_flow": flow * F.col("volume"),
            "x_root": flow * F.sqrt(F.greatest("volume", F.lit(0.0))),
            "x_abs": F.abs("x_ret"),
            "x_value": F.col("close") * F.col("volume"),
            "x_range": F.pow(F.log(F.try_divide("high", "low")), 2) / F.col("x_dt_ok"),
        }
    )
    beta = F.col("x_range") + F.lag("x_range").over(W())
    both = F.col("x_dt") + F.lag("x_dt").over(W())
    wide = F.log(F.try_divide(F.greatest("high", F.lag("high").over(W())), F.least("low", F.lag("low").over(W()))))
    gamma = F.when(F.lag("high").over(W()).isNotNull() & (both > 0), F.pow(wide, 2) / both)
    denom = 3 - 2 * 2**0.5
    b = b.withColumns({"x_beta": beta, "x_gamma": gamma})
    alpha = (F.sqrt(2 * F.col("x_beta")) - F.sqrt("x_beta")) / denom - F.sqrt(F.col("x_gamma") / denom)
    b = b.withColumn("x_alpha", alpha)
    return b.withColumn("x_spread", F.when(F.col("x_alpha").isNotNull(), F.greatest(2 * (F.exp("x_alpha") - 1) / (1 + F.exp("x_alpha")), F.lit(0.0))))


def roll(n: int) -> Column:
    f = frame(W(), n, 1)
    cov = F.covar_samp("x_dp", "x_dp1").over(f)
    return F.when(F.count(F.when(F.col("x_dp1").isNotNull(), F.col("x_dp"))).over(f) == n, 2 * F.sqrt(F.greatest(F.lit(0.0), -cov)))


def corwin_schultz(n: int) -> Column:
    return F.lag("x_spread").over(W()) if n <= 2 else rolling(F.avg, F.col("x_spread"), W(), n, 1)


def ofi(n: int) -> Column:
    return rolling(F.sum, F.col("x_flow"), W(), n, 1)


def hasbrouck(n: int) -> Column:
    return rolling(F.sum, F.col("x_root"), W(), n, 1)


def _slope(y: str, x: str, n: int) -> Column:
    f = frame(W(), n, 1)
    var = F.var_pop(x).over(f)
    both = F.count(F.when(F.col(y).isNotNull(), F.col(x))).over(f)
    return F.when((both == n) & (var >= 1e-12), F.covar_pop(y, x).over(f) / var)


def kyle(n: int) -> Column:
    return _slope("x_dp0", "x_flow", n)


def amihud(n: int) -> Column:
    return _slope("x_abs", "x_value", n)


def with_bins(base: DataFrame, windows: Sequence[int], bins: int = BINS) -> DataFrame:
    """base with x_bin{n} and x_lz{n} for each window n: ranks of x_ret in bins, and the complexity of the bins before, made as an asset's bars pass in order."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in base.dtypes), *(f"x_bin{n} long, x_lz{n} double" for n in windows)])
    return scan(base, ["seq"], schema, lambda: Entropies(windows, bins))


def shannon(bin_col: str, n: int, bins: int = BINS) -> Column:
    """Entropy in bits of the bins known in the frame."""
    f = frame(W(), n, 1)
    known = F.count(bin_col).over(f)
    rows = F.count(F.lit(1)).over(f)
    terms = []
    for k in range(bins):
        p = F.try_divide(F.count(F.when(F.col(bin_col) == k, 1)).over(f), known)
        terms.append(F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    return F.when((rows == n) & (known > 0), reduce(lambda a, b: a + b, terms))


def lempel_ziv(bin_col: str, n: int) -> Column:
    """Complexity of the bins of the frame, null unless all are known; with_bins() makes it beside the bins."""
    return F.nanvl(F.col(bin_col.replace("x_bin", "x_lz")), F.lit(None).cast("double"))


@dataclass(frozen=True)
class FeatureSpec:
    family: str
    build: object
    entropy: bool = False


_REGISTRY: dict[str, FeatureSpec] = {}


def register_feature(spec: FeatureSpec) -> FeatureSpec:
    """Idempotent; another spec under the same name raises ValueError."""
    if _REGISTRY.get(spec.family, spec) != spec:
        raise ValueError(f"{spec.family} is registered")
    _REGISTRY[spec.family] = spec
    return spec


def list_features() -> list[str]:
    return sorted(_REGISTRY)


for _name, _build in (("roll", roll), ("corwin_schultz", corwin_schultz), ("ofi", ofi), ("kyle", kyle), ("amihud", amihud), ("hasbrouck", hasbrouck)):
    register_feature(FeatureSpec(_name, _build))
for _name, _build in (("shannon", shannon), ("lempel_ziv", lempel_ziv)):
    register_feature(FeatureSpec(_name, _build, True))


def feature_columns(windows: Sequence[int] = WINDOWS, entropy: Sequence[int] = ENTROPY_WINDOWS) -> list[str]:
    plain = [f"{s.family}_w{n}" for s in _REGISTRY.values() if not s.entropy for n in windows]
    return plain + [f"{s.family}_w{n}" for s in _REGISTRY.values() if s.entropy for n in entropy]


def raw_features(bars: DataFrame, windows: Sequence[int] = WINDOWS, entropy: Sequence[int] = ENTROPY_WINDOWS, families: Sequence[str] | None = None) -> DataFrame:
    """asset, seq, ts_us and the feature columns, before filling."""
    wanted = [s for s in _REGISTRY.values() if families is None or s.family in families]
    b = base_columns(bars)
    if any(s.entropy for s in wanted):
        b = with_bins(b, entropy)
    cols = {f"{s.family}_w{n}": s.build(n) for s in wanted if not s.entropy for n in windows}
    cols |= {f"{s.family}_w{n}": s.build(f"x_bin{n}", n) for s in wanted if s.entropy for n in entropy}
    return b.select("asset", "seq", "ts_us", *[c.alias(n) for n, c in cols.items()])


def clean(features: DataFrame, ffill_limit: int = 5) -> DataFrame:
    """NaN as null, forward fill of at most ffill_limit bars, rows with any null dropped."""
    names = [c for c in features.columns if c not in ("asset", "seq", "ts_us")]
    f = features.select("asset", "seq", "ts_us", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
    f = f.select("asset", "seq", "ts_us", *[forward_fill(F.col(c), W(), ffill_limit).alias(c) for c in names])
    return f.dropna(subset=names)


def at_events(features: DataFrame, events: DataFrame) -> DataFrame:
    """Feature rows at the bars of events."""
    return features.join(events.select("asset", "seq").distinct(), ["asset", "seq"], "left_semi")


def assert_finite(features: DataFrame) -> None:
    """Raise ValueError if a feature is null, NaN or infinite."""
    names = [c for c in features.columns if c not in ("asset", "seq", "ts_us")]
    bad = features.agg(*[F.sum(F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0)).alias(c) for c in names]).first().asDict()
    if wrong := {k: v for k, v in bad.items() if v}:
        raise ValueError(f"values that are not finite: {wrong}")


def align(events: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events that have a feature row, and a report (n_in, n_out, n_dropped, drop_rate)."""
    kept = events.join(features.select("asset", "seq"), ["asset", "seq"], "left_semi")
    report = events.agg(F.count("*").alias("n_in")).crossJoin(kept.agg(F.count("*").alias("n_out")))  # one row each
    return kept, report.select("n_in", "n_out", (F.col("n_in") - F.col("n_out")).alias("n_dropped"), F.when(F.col("n_in") > 0, 1 - F.col("n_out") / F.col("n_in")).otherwise(0.0).alias("drop_rate"))


def thin(df: DataFrame, most: int = 6000) -> DataFrame:
    """Every step-th row of each asset by seq, step = ceil(n / most)."""
    n = df.groupBy("asset").agg(F.count("*").alias("n"))
    numbered = df.withColumn("row", F.row_number().over(W()) - 1).join(n, "asset")
    return numbered.where(F.col("row") % F.ceil(F.col("n") / most) == 0).drop("row", "n")
