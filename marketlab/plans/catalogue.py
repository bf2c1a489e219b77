"""The library's registered queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.functions import stats
from marketlab.functions.kernels import ffd_weights
from marketlab.operators import bars as B
from marketlab.operators import execution as E
from marketlab.operators import features as X
from marketlab.operators import folds as C
from marketlab.operators import labels as L
from marketlab.operators import models as M
from marketlab.operators import monitoring as G
from marketlab.operators import selection as S
from marketlab.operators import stationarity as D
from marketlab.operators import validation as V
from marketlab.plans import research as R
from marketlab.plans import strategy as T
from marketlab.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null, no negative zero, so that both engines agree on the last digits."""
    return df.select(*[(F.round(F.when(~F.isnan(c), F.col(c)), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


TICKS = r"""
ticks as (
  select event_type as asset, epoch_us(ts) as ts_us, event_id as tick_id,
    100 * exp(sum(cast(round((value - 50) * 100) as bigint)) over (partition by event_type order by ts, event_id rows unbounded preceding) / 1e6) as mid,
    cast(regexp_extract(props, '(\d+)', 1) as double) as bid_volume, cast(1 + event_id % 7 as double) as ask_volume
  from events)"""


def bars_sql(name: str = "bars", width_s: int = 3600) -> str:
    return f"""{TICKS},
{name} as (
  select asset, row_number() over (partition by asset order by b) as seq, b as ts_us, open, high, low, close, volume, n_ticks from (
    select asset, ts_us - ts_us % {width_s}000000 as b, arg_min(mid, (ts_us, tick_id)) as open, max(mid) as high, min(mid) as low, arg_max(mid, (ts_us, tick_id)) as close,
      sum(bid_volume + ask_volume) as volume, count(*) as n_ticks
    from ticks group by 1, 2))"""


BARS = bars_sql()
RET = BARS + """,
r as (select *, ln(close) - ln(lag(close) over (partition by asset order by seq)) as ret from bars)"""
#: Recursive weights (adjust = False) in closed form; the first return is row 2.
EWM = lambda span: f"""{RET},
e0 as (select *, seq - 2 as k, {2 / (span + 1)!r} as a from r where ret is not null),
e1 as (select *, case when k = 0 then 1.0 else a * power(1 - a, -k) end as c from e0),
e2 as (select *, power(1 - a, k) * sum(c * ret) over w as m, power(1 - a, k) * sum(c * ret * ret) over w as q, power(1 - a, 2 * k) * sum(c * c) over w as s2
  from e1 window w as (partition by asset order by seq rows unbounded preceding)),
e3 as (select asset, seq, case when k + 1 >= {span} then sqrt(greatest(q - m * m, 0) / (1 - s2)) end as v from e2),
ev as (select r.*, lag(e3.v) over (partition by r.asset order by r.seq) as vol from r left join e3 using (asset, seq))"""  # noqa: E731


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.time_bars(views.ticks(spark, sf_dir), "1h")


@query(f"with {TICKS} select asset, ts_us, tick_id, round(mid, 6) as mid, round(bid_volume, 6) as bid_volume, round(ask_volume, 6) as ask_volume from ticks where ts_us >= epoch_us(timestamp '2024-01-10') and ts_us < epoch_us(timestamp '2024-01-12')")
def tick_scan(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    lo, hi = (views.micros(date(2024, 1, d)) for d in (10, 12))
    return rounded(t.where((F.col("ts_us") >= lo) & (F.col("ts_us") < hi)).select("asset", "ts_us", "tick_id", "mid", "bid_volume", "ask_volume"))


@query("select event_id, epoch_us(ts) as ts_us, value from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def event_window(spark, sf_dir):
    found = views.load_ticks(spark, f"{sf_dir}/events.parquet", date(2024, 1, 10), date(2024, 1, 12), ["event_id", "ts", "value"], time="ts")
    return found.select("event_id", views.ts_us("ts").alias("ts_us"), "value")


_BAR_OUT = "asset, seq, ts_us, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(volume, 6) as volume, n_ticks"


@query(f"with {BARS} select {_BAR_OUT} from bars")
def time_bars_1h(spark, sf_dir):
    return rounded(hourly(spark, sf_dir))


@query(f"with {bars_sql(width_s=86400)} select {_BAR_OUT} from bars")
def time_bars_1d(spark, sf_dir):
    return rounded(B.time_bars(views.ticks(spark, sf_dir), "1d"))


@query(f"with {RET} select asset, seq, round(ret, 9) as ret from r")
def log_returns(spark, sf_dir):
    return rounded(B.log_returns(hourly(spark, sf_dir)).select("asset", "seq", "ret"), 9)


@query(f"""with {RET},
m as (select asset, count(ret) as n, avg(ret) as mu from r group by 1),
c as (select r.asset, m.n, avg(power(ret - mu, 2)) as m2, avg(power(ret - mu, 3)) as m3, avg(power(ret - mu, 4)) as m4 from r join m using (asset) where ret is not null group by 1, 2)
select asset, n, round(n / 6.0 * (power(m3 / power(m2, 1.5), 2) + power(m4 / (m2 * m2) - 3, 2) / 4), 6) as jb from c""")
def jarque_bera_by_asset(spark, sf_dir):
    return rounded(B.jarque_bera(B.log_returns(hourly(spark, sf_dir)), "asset"))


@query(f"""with {TICKS},
s as (select *, nullif(sign(mid - lag(mid) over w), 0) as s from ticks window w as (partition by asset order by ts_us, tick_id))
select asset, ts_us, tick_id, cast(coalesce(last_value(s ignore nulls) over (partition by asset order by ts_us, tick_id rows unbounded preceding), 1) as bigint) as sign from s""")
def tick_signs(spark, sf_dir):
    return B.tick_signs(views.ticks(spark, sf_dir))


def information_oracle(imbalance: bool) -> str:
    """The recurrence as a recursive query; b is the bar that a tick belongs to, closed or not."""
    theta = "abs(2 * np1 - ns1)" if imbalance else "greatest(np1, ns1 - np1)"
    level = "t * abs(2 * p - 1)" if imbalance else "t * greatest(p, 1 - p)"
    return f"""with recursive {TICKS},
n as (select *, row_number() over o as i, coalesce(mid - lag(mid) over o, 0) as d from ticks window o as (partition by asset order by ts_us, tick_id)),
step(asset, i, s, np, ns, nt, t, p, b, hit) as (
  select asset, i, 1, 0, 0, 1, cast(100 as double), cast(0.5 as double), 0, false from n where i = 1
  union all
  select asset, i, s1, case when h then 0 else np1 end, case when h then 0 else ns1 end, case when h then 0 else nt1 end,
    case when h then cast(0.05 as double) * nt1 + cast(0.95 as double) * t else t end,
    case when h then cast(0.05 as double) * (cast(np1 as double) / nt1) + cast(0.95 as double) * p else p end,
    b1, h
  from (select *, {theta} >= greatest({level}, 1) as h from (
    select *, np + case when s1 > 0 then 1 else 0 end as np1, ns + 1 as ns1, nt + 1 as nt1, case when hit then b + 1 else b end as b1 from (
      select n.asset, n.i, st.np, st.ns, st.nt, st.t, st.p, st.b, st.hit, case when n.d > 0 then 1 when n.d < 0 then -1 else st.s end as s1
      from step st join n on n.asset = st.asset and n.i = st.i + 1)))),
closed as (select asset, b from step where hit),
bars as (
  select asset, b + 1 as seq, max(ts_us) as ts_us, arg_min(mid, (ts_us, tick_id)) as open, max(mid) as high, min(mid) as low, arg_max(mid, (ts_us, tick_id)) as close,
    sum(bid_volume + ask_volume) as volume, count(*) as n_ticks
  from step join n using (asset, i) join closed using (asset, b) group by 1, 2)
select asset, cast(seq as bigint) as seq, {_BAR_OUT[len("asset, seq, "):]} from bars"""


@query(information_oracle(True))
def tib_bars(spark, sf_dir):
    return rounded(B.imbalance_bars(views.ticks(spark, sf_dir)))


@query(information_oracle(False))
def trb_bars(spark, sf_dir):
    return rounded(B.run_bars(views.ticks(spark, sf_dir)))


@query()
def bar_type_tournament(spark, sf_dir):
    return rounded(B.tournament(views.ticks(spark, sf_dir), ("1h", "2h", "4h", "8h", "1d"), (10, 20, 40, 80, 160)))


@query(f"with {EWM(20)} select asset, seq, round(vol, 8) as vol from ev")
def ewm_vol(spark, sf_dir):
    return rounded(L.ewm_volatility(hourly(spark, sf_dir), 20).select("asset", "seq", "vol"), 8)


CUSUM = lambda span: f"""with recursive {EWM(span)},
g as (select asset, seq, ts_us, ret, vol, row_number() over (partition by asset order by seq) as i from ev where ret is not null and vol > 0),
step(asset, i, up, down, hit) as (
  select asset, cast(0 as bigint), cast(0 as double), cast(0 as double), 0 from (select distinct asset from g)
  union all
  select asset, i, case when h <> 0 then 0 else u end, case when h <> 0 then 0 else d end, h from (
    select *, case when u >= vol then 1 when d <= -vol then -1 else 0 end as h from (
      select g.asset, g.i, g.vol, greatest(0, st.up + g.ret) as u, least(0, st.down + g.ret) as d from step st join g on g.asset = st.asset and g.i = st.i + 1)))"""  # noqa: E731


@query(CUSUM(20) + " select g.asset, g.seq, g.ts_us, case when hit > 0 then 'long' else 'short' end as side from step join g using (asset, i) where hit <> 0")
def cusum_events(spark, sf_dir):
    return L.cusum_events(hourly(spark, sf_dir), 20)


BOLL = BARS + """,
z as (select asset, seq, ts_us, close, avg(close) over w as m, stddev_samp(close) over w as s, count(*) over w as k
  from bars window w as (partition by asset order by seq rows between 20 preceding and 1 preceding)),
z1 as (select *, coalesce(k = 20 and close < m - 2 * s, false) as below, coalesce(k = 20 and close > m + 2 * s, false) as above from z),
z2 as (select *, lag(below) over w as pb, lag(above) over w as pa from z1 window w as (partition by asset order by seq)),
boll as (select asset, seq, ts_us, case when below then 'long' else 'short' end as side from z2
  where seq > 21 and ((below and not coalesce(pb, false)) or (above and not coalesce(pa, false) and not (below and not coalesce(pb, false)))))"""


@query(f"with {BOLL} select * from boll")
def bollinger_events(spark, sf_dir):
    return L.bollinger_events(hourly(spark, sf_dir))


DONCH = """
d as (select asset, seq, ts_us, close, max(high) over w as t, min(low) over w as l, count(*) over w as k
  from bars window w as (partition by asset order by seq rows between 20 preceding and 1 preceding)),
d1 as (select *, case when k = 20 and close > t then 1 when k = 20 and close < l then -1 else 0 end as s from d),
d2 as (select *, coalesce(lag(s) over (partition by asset order by seq), 0) as ps from d1),
donch as (select asset, seq, ts_us, case when s > 0 then 'long' else 'short' end as side from d2 where s <> 0 and s <> ps)"""


@query(f"with {BARS}, {DONCH} select * from donch")
def donchian_events(spark, sf_dir):
    return L.donchian_events(hourly(spark, sf_dir))


@query(f"""with {BOLL}, {DONCH},
u as (select *, 'bbands_meanrev' as plugin_family, 0 as k from boll union all select *, 'donchian_breakout', 1 from donch)
select asset, seq, ts_us, side, plugin_family from (select *, row_number() over (partition by asset, seq order by k) as n from u) where n = 1""")
def merged_events(spark, sf_dir):
    return L.merged_events(hourly(spark, sf_dir), ("bbands_meanrev", "donchian_breakout"))


BARRIER = BOLL + """,
rr as (select *, ln(close) - ln(lag(close) over (partition by asset order by seq)) as ret from bars),
vv as (select asset, seq, case when count(ret) over w = 20 then stddev_samp(ret) over w end as vol from rr window w as (partition by asset order by seq rows between 20 preceding and 1 preceding)),
ee as (select b.asset, b.seq, b.ts_us, b.side, c.close as entry_price, c.close * (1 + vol) as upper_price, c.close * (1 - vol) as lower_price, least(b.seq + 20, mx) as end_seq
  from boll b join bars c using (asset, seq) join vv using (asset, seq) join (select asset, max(seq) as mx from bars group by 1) using (asset) where vol > 0),
pp as (select ee.*, p.seq as b_seq, p.ts_us as b_us, p.close as b_close, p.seq > ee.seq and p.high >= upper_price as up, p.seq > ee.seq and p.low <= lower_price as dn
  from ee join bars p on p.asset = ee.asset and p.seq <= end_seq and (p.seq > ee.seq or end_seq = ee.seq and p.seq = ee.seq)),
ff as (select asset, seq, ts_us, side, entry_price, upper_price, lower_price, min(b_seq) filter (up or dn) as f, max(b_seq) as l from pp group by all),
labels_ as (
  select ff.asset, ff.seq, ff.ts_us, ff.side, ff.entry_price, ff.upper_price, ff.lower_price,
    case when f is null then 'vertical' when up and dn then case when ff.side = 'long' then 'lower' else 'upper' end when up then 'upper' else 'lower' end as barrier_hit,
    pp.b_seq as exit_seq, pp.b_us as exit_us, pp.b_close, f is not null and up and dn as both_
  from ff join pp on pp.asset = ff.asset and pp.seq = ff.seq and pp.side = ff.side and pp.b_seq = coalesce(f, l)),
lab as (select *, case barrier_hit when 'upper' then upper_price when 'lower' then lower_price else b_close end as exit_price,
  case when not both_ and barrier_hit = case when side = 'long' then 'upper' else 'lower' end then 1 else 0 end as label from labels_)"""


@query(f"""with {BARRIER} select asset, seq, ts_us, side, round(entry_price, 6) as entry_price, round(upper_price, 6) as upper_price, round(lower_price, 6) as lower_price,
barrier_hit, exit_seq, exit_us, round(exit_price, 6) as exit_price, label, round((exit_price - entry_price) / entry_price, 6) as return_pct,
round(case when side = 'long' then 1 else -1 end * (exit_price - entry_price) / entry_price, 6) as signed_return from lab""")
def triple_barrier(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return rounded(L.triple_barrier(bars, L.bollinger_events(bars), vol=R.rolling_volatility(bars)))


@query(f"with {BARRIER} select asset, count(*) as n, cast(sum(label) as bigint) as n_positive, round(avg(label), 6) as label_rate from lab group by 1")
def label_balance(spark, sf_dir):
    return rounded(R.label_rates(spark, sf_dir))


FEAT = RET + """,
f0 as (select *, close - lag(close) over o as dp, (ts_us - lag(ts_us) over o) / 1e6 as dt0, lag(high) over o as ph, lag(low) over o as pl from r window o as (partition by asset order by seq)),
f1 as (select *, coalesce(dt0, lead(dt0) over o) as dt, lag(dp) over o as dp1, sign(coalesce(dp, 0)) as sg from f0 window o as (partition by asset order by seq)),
f2 as (select *, power(ln(high / low), 2) / nullif(dt, 0) as rng, sg * volume as flow, sg * sqrt(greatest(volume, 0)) as rt, abs(ret) as ar, close * volume as val, coalesce(dp, 0) as dp0 from f1),
f3 as (select *, rng + lag(rng) over o as beta, case when ph is not null then power(ln(greatest(high, ph) / least(low, pl)), 2) / (dt + lag(dt) over o) end as gamma from f2 window o as (partition by asset order by seq)),
f4 as (select *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0)) - sqrt(gamma / (3 - 2 * sqrt(2.0))) as alpha from f3),
f5 as (select *, case when alpha is not null then greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) end as spread from f4)"""
_W = "window w as (partition by asset order by seq rows between 20 preceding and 1 preceding)"


def feature_query(name: str, expr: str, digits: int = 6):
    @query(f"with {FEAT} select asset, seq, round({expr}, {digits}) + 0.0 as {name}_w20 from f5 {_W}")
    def f(spark, sf_dir):
        return rounded(X.raw_features(hourly(spark, sf_dir), (20,), (), (name,)).select("asset", "seq", f"{name}_w20"), digits)

    QUERIES[f"feat_{name}"], SQL[f"feat_{name}"] = QUERIES.pop("f"), SQL.pop("f")


feature_query("roll", "case when count(dp1) over w = 20 then 2 * sqrt(greatest(0, -covar_samp(dp, dp1) over w)) end")
feature_query("corwin_schultz", "case when count(spread) over w = 20 then avg(spread) over w end")
feature_query("ofi", "case when count(flow) over w = 20 then sum(flow) over w end")
feature_query("hasbrouck", "case when count(rt) over w = 20 then sum(rt) over w end")
feature_query("kyle", "case when count(*) over w = 20 and var_pop(flow) over w >= 1e-12 then covar_pop(dp0, flow) over w / var_pop(flow) over w end")
feature_query("amihud", "case when count(ar) over w = 20 and var_pop(val) over w >= 1e-12 then covar_pop(ar, val) over w / var_pop(val) over w end", 12)

BINS = RET + """,
q0 as (select asset, seq, round(ret, 12) as ret, list(round(ret, 12)) over w as v, count(*) over w as k, count(ret) over w as known from r window w as (partition by asset order by seq rows between 49 preceding and current row)),
q as (select asset, seq, case when k = 50 and ret is not null and known >= 2 then cast(least(floor(len(list_filter(v, lambda x: x < ret)) * 5 / known), 4) as bigint) end as bin from q0)"""


@query(f"with {BINS} select * from q")
def quantile_bins(spark, sf_dir):
    b = X.base_columns(hourly(spark, sf_dir))
    return X.with_bins(b, (50,)).select("asset", "seq", F.col("x_bin50").alias("bin"))


_P = " + ".join(f"case when count(*) filter (bin = {k}) over w > 0 then -(count(*) filter (bin = {k}) over w / cast(count(bin) over w as double)) * log2(count(*) filter (bin = {k}) over w / cast(count(bin) over w as double)) else 0 end" for k in range(5))


@query(f"with {BINS} select asset, seq, round(case when count(*) over w = 50 and count(bin) over w > 0 then {_P} end, 6) as shannon_w50 from q window w as (partition by asset order by seq rows between 50 preceding and 1 preceding)")
def feat_shannon(spark, sf_dir):
    return rounded(X.raw_features(hourly(spark, sf_dir), (), (50,), ("shannon",)).select("asset", "seq", "shannon_w50"))


@query()
def feat_lempel_ziv(spark, sf_dir):
    return rounded(X.raw_features(hourly(spark, sf_dir), (), (50,), ("lempel_ziv",)).select("asset", "seq", "lempel_ziv_w50"))


@query()
def feature_matrix(spark, sf_dir):
    """All 58 columns at their default windows."""
    return rounded(X.raw_features(hourly(spark, sf_dir)))


_FILL = "last_value({0} ignore nulls) over (partition by asset order by seq rows between 5 preceding and current row)"
CLEAN = FEAT + f""",
c0 as (select asset, seq, ts_us, case when count(dp1) over w = 20 then 2 * sqrt(greatest(0, -covar_samp(dp, dp1) over w)) end as roll_w20,
  case when count(flow) over w = 20 then sum(flow) over w end as ofi_w20 from f5 {_W}),
c1 as (select asset, seq, ts_us, {_FILL.format("roll_w20")} as roll_w20, {_FILL.format("ofi_w20")} as ofi_w20 from c0),
c2 as (select * from c1 where roll_w20 is not null and ofi_w20 is not null)"""


def _clean(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return bars, X.clean(X.raw_features(bars, (20,), (), ("roll", "ofi")))


@query(f"with {CLEAN} select asset, seq, ts_us, round(roll_w20, 6) as roll_w20, round(ofi_w20, 6) as ofi_w20 from c2")
def feature_matrix_clean(spark, sf_dir):
    return rounded(_clean(spark, sf_dir)[1])


@query(f"""with {CLEAN}, {DONCH}
select count(*) as n_in, count(c2.seq) as n_out, count(*) - count(c2.seq) as n_dropped, round(1 - count(c2.seq) / cast(count(*) as double), 6) as drop_rate from donch left join c2 using (asset, seq)""")
def align_labels(spark, sf_dir):
    bars, features = _clean(spark, sf_dir)
    return rounded(X.align(L.donchian_events(bars), features)[1])


@query(f"""with {BARS}, n as (select *, row_number() over (partition by asset order by seq) - 1 as i, count(*) over (partition by asset) as n from bars)
select asset, seq from n where i % ceil(n / 100.0) = 0""")
def thinned_bars(spark, sf_dir):
    return X.thin(hourly(spark, sf_dir), 100).select("asset", "seq")


_FFD = ffd_weights(0.4, 1e-3)


@query(f"""with {BARS}, w as (select unnest({_FFD.tolist()}) as w, unnest(range({len(_FFD)})) as k)
select a.asset, a.seq, round(sum(w.w * b.close), 6) as value from bars a join bars b on a.asset = b.asset and b.seq <= a.seq and b.seq > a.seq - {len(_FFD)} join w on w.k = a.seq - b.seq where a.seq > {len(_FFD)} group by 1, 2""")
def ffd_series(spark, sf_dir):
    return rounded(D.ffd_series(hourly(spark, sf_dir).select("asset", "seq", F.col("close").alias("value")), 0.4, 1e-3))


@query()
def adf_by_asset(spark, sf_dir):
    return rounded(D.adf(hourly(spark, sf_dir).select("asset", "seq", F.col("close").alias("value"))))


@query()
def optimal_d(spark, sf_dir):
    return rounded(D.find_optimal_d(hourly(spark, sf_dir).select("asset", "seq", F.log("close").alias("value")), tol=1e-3))


HORIZONS = """h as (select o_orderkey as event_id, epoch_us(o_orderdate) // 86400000000 as t0, greatest(epoch_us(o_orderdate), m) // 86400000000 as t1
  from orders join (select l_orderkey, max(epoch_us(l_shipdate)) as m from lineitem group by 1) on l_orderkey = o_orderkey)"""
CONC = HORIZONS + """,
e as (select t, sum(o) as o, sum(c) as c from (select t0 as t, 1 as o, 0 as c from h union all select t1, 0, 1 from h) group by 1),
g as (select t, cast(sum(o) over (order by t rows unbounded preceding) - coalesce(sum(c) over (order by t rows between unbounded preceding and 1 preceding), 0) as bigint) as c from e)"""


@query(f"with {CONC} select * from g")
def concurrency(spark, sf_dir):
    return C.concurrency(views.horizons(spark, sf_dir))


UNIQ = CONC + """,
p as (select t, 1.0 / c as inv, sum(1.0 / c) over (order by t) as p, row_number() over (order by t) as k from g),
u as (select event_id, (b.p - a.p + a.inv) / (b.k - a.k + 1) as u from h join p a on a.t = h.t0 join p b on b.t = h.t1)"""


@query(f"with {UNIQ} select event_id, round(u, 6) as u from u")
def avg_uniqueness(spark, sf_dir):
    return rounded(C.average_uniqueness(views.horizons(spark, sf_dir)))


@query(f"with {UNIQ} select event_id, round(u * count(*) over () / sum(u) over (), 6) as w from u")
def weights_normalized(spark, sf_dir):
    return rounded(C.normalized_weights(C.average_uniqueness(views.horizons(spark, sf_dir)).withColumnRenamed("u", "w")))


POS = HORIZONS + ", x as (select *, row_number() over (order by t0, event_id) - 1 as pos, count(*) over () as n from h)"


@query(f"""with {POS},
f as (select cast(k as int) as fold, k * n // 5 as a, (k + 1) * n // 5 as b from (select max(n) as n from x), range(5) t(k)),
s as (select fold, a, b, min(t0) as lo, max(t1) as hi from f join x on pos >= a and pos < b group by all)
select fold, event_id, pos, case when pos >= a and pos < b then 'test' when t0 <= hi and t1 >= lo then 'purged' when pos >= b and pos < b + n // 100 then 'embargo' else 'train' end as role from x, s""")
def purged_kfold(spark, sf_dir):
    return C.purged_kfold(views.horizons(spark, sf_dir))


@query(f"""with {POS},
c as (select (row_number() over (order by a, b) - 1)::int as fold, a, b from range(6) i(a), range(6) j(b) where a < b),
bl as (select fold, a * n // 6 as lo, (a + 1) * n // 6 as hi, b = a + 1 as adj, b * n // 6 as lo2, (b + 1) * n // 6 as hi2 from c, (select max(n) as n from x)),
blocks as (select fold, lo as a, case when adj then hi2 else hi end as b from bl union all select fold, lo2, hi2 from bl where not adj),
s as (select fold, a, b, min(t0) as lo, max(t1) as hi from blocks join x on pos >= a and pos < b group by all),
k as (select fold, event_id, pos, max(case when pos >= a and pos < b then 3 when t0 <= hi and t1 >= lo then 2 when pos >= b and pos < b + n // 100 then 1 else 0 end) as st from x, s group by all)
select fold, st as state, count(*) as n, sum(pos)::bigint as pos_sum from k group by all""")
def cpcv_folds(spark, sf_dir):
    """Roles are summed up: 15 folds of all rows are too many to compare one by one."""
    r = C.cpcv_folds(views.horizons(spark, sf_dir))
    state = F.when(F.col("role") == "test", 3).when(F.col("role") == "purged", 2).when(F.col("role") == "embargo", 1).otherwise(0)
    return r.groupBy("fold", state.alias("state")).agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("""with c as (select row_number() over (order by a, b) - 1 as fold, a, b from range(6) i(a), range(6) j(b) where a < b),
u as (select fold, a as grp from c union all select fold, b from c)
select fold, grp, row_number() over (partition by grp order by fold) - 1 as path from u""")
def cpcv_paths(spark, sf_dir):
    return C.cpcv_paths(spark)


@query(f"""with {POS},
f as (select cast(k as int) as fold, s + k * (n - s) / 5.0 as a0, s + (k + 1) * (n - s) / 5.0 as b0 from (select max(n) as n, max(n) * 3 // 10 as s from x), range(5) t(k)),
f1 as (select fold, floor(a0)::bigint as a, floor(b0)::bigint as b from f),
s as (select fold, a, b, min(t0) as lo from f1 join x on pos >= a and pos < b group by all)
select fold, event_id, pos, case when pos >= a then 'test' else 'train' end as role from x, s where (pos >= a and pos < b) or (pos < a and t1 + n // 100 < lo)""")
def walk_forward(spark, sf_dir):
    return C.walk_forward(views.horizons(spark, sf_dir))


_NAMES = [f"x{i}" for i in range(8)]


def feature_frame(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_NAMES)])


@query("with f as (select " + ", ".join(f"cast(embedding[{i + 1}] as double) as x{i}" for i in range(8)) + " from embeddings) "
       + " union all ".join(f"select 'x{i}' as fi, 'x{j}' as fj, round(corr(x{i}, x{j}), 6) as rho, round(sqrt(0.5 * (1 - corr(x{i}, x{j}))), 6) as d from f" for i in range(8) for j in range(i + 1, 8)))
def corr_distance(spark, sf_dir):
    return rounded(S.correlation_distance(feature_frame(spark, sf_dir), _NAMES))


@query("""with f as (select vec_id as i, cast(embedding[1] as double) as x, embedding from embeddings),
c as (select k, corr(x, cast(embedding[k] as double)) as r from f, range(2, 9) t(k) group by 1)
select round(max(abs(r)), 6) as max_abs_corr, max(abs(r)) < 0.5 as orthogonal from c""")
def signal_orthogonality(spark, sf_dir):
    f = feature_frame(spark, sf_dir)
    old = f.select(F.col("event_id").alias("i"), F.explode(F.create_map(*[x for c in _NAMES[1:] for x in (F.lit(c), F.col(c))])).alias("name", "value"))
    return rounded(L.is_orthogonal(f.select(F.col("event_id").alias("i"), F.col("x0").alias("value")), old))


@query()
def feature_clusters(spark, sf_dir):
    return S.cluster_features(S.correlation_distance(feature_frame(spark, sf_dir), _NAMES), _NAMES)


PRED = "p as (select d.source, 1.0 / (1.0 + exp(-(n_chars - 1500) / 1000.0)) as p, quality as y from documents d join labels using (doc_id))"


def predictions(spark, sf_dir) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(views.table(spark, sf_dir, "labels"), "doc_id")
    return d.select("source", (1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0))).alias("p"), F.col("quality").alias("y"))


@query(f"""with {PRED} select source, count(*) as n, round(avg(power(p - y, 2)), 6) as brier,
round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) as log_loss, round(avg(cast(y as double)) * (1 - avg(cast(y as double))), 6) as naive_brier from p group by 1""")
def brier_logloss(spark, sf_dir):
    return rounded(V.scores(predictions(spark, sf_dir), "source"))


PVALS = "pv as (select l_suppkey::varchar as name, (count(*) * 7919 + l_suppkey * 104729) % 10007 / 1000700.0 as p from lineitem group by l_suppkey)"


def p_values(spark, sf_dir) -> DataFrame:
    g = views.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return g.select(F.col("l_suppkey").cast("string").alias("name"), ((F.col("n") * 7919 + F.col("l_suppkey") * 104729) % 10007 / 1000700.0).alias("p"))


@query(f"""with {PVALS}, k as (select *, row_number() over (order by p, name) as k, count(*) over () as m from pv)
select name, round(p, 9) as p, round(0.05 / (m - k + 1), 9) as threshold, min(case when p < cast(0.05 as double) / (m - k + 1) then 1 else 0 end) over (order by k rows unbounded preceding) = 1 as rejected from k""")
def holm(spark, sf_dir):
    return rounded(V.holm(p_values(spark, sf_dir)), 9)


PERF = """pf as (select o_orderkey % 16 as split, c_mktsegment as strategy, avg(case when o_orderkey % 2 = 0 then o_totalprice end) as is_perf, avg(case when o_orderkey % 3 = 0 then o_totalprice end) as oos_perf
  from orders join customer on c_custkey = o_custkey group by 1, 2)"""


def performance(spark, sf_dir) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    when = lambda k: F.avg(F.when(F.col("o_orderkey") % k == 0, F.col("o_totalprice")))
    split = F.expr("(o_orderkey div 6) % 16")
    return o.groupBy(split.alias("split"), F.col("c_mktsegment").alias("strategy")).agg(when(2).alias("is_perf"), when(3).alias("oos_perf"))


LOGITS = PERF.replace("o_orderkey % 16", "(o_orderkey // 6) % 16") + """,
ok as (select * from pf where split not in (select split from pf where is_perf is null or oos_perf is null)),
rk as (select split, strategy, row_number() over (partition by split order by is_perf desc, strategy) as place,
  rank() over (partition by split order by oos_perf) + (count(*) over (partition by split, oos_perf) - 1) / 2.0 as r, count(*) over (partition by split) as n from ok),
lg as (select split, strategy, least(greatest((r - 0.5) / n, 1e-6), 1 - 1e-6) as s from rk where place = 1)"""


@query(f"with {LOGITS} select split, strategy, round(ln(s / (1 - s)), 6) as logit from lg")
def pbo_logits(spark, sf_dir):
    return rounded(V.pbo(performance(spark, sf_dir))[0])


@query(f"with {LOGITS} select round(avg(case when ln(s / (1 - s)) <= 0 then 1.0 else 0.0 end), 6) as pbo, count(*) as n_splits from lg")
def pbo(spark, sf_dir):
    return rounded(V.pbo(performance(spark, sf_dir))[1])


@query(f"""with {RET}, m as (select asset, count(ret) as n, avg(ret) as mean, stddev_samp(ret) as std from r group by 1)
select asset, m.n, round(any_value(mean), 6) as mean, round(any_value(std), 6) as std, round(any_value(mean / std), 6) as sharpe, round(any_value(mean / std) * sqrt(252), 6) as annual_sharpe,
round(avg(power((ret - mean) / std, 3)), 6) as skew, round(avg(power((ret - mean) / std, 4)), 6) as kurtosis from r join m using (asset) where ret is not null group by 1, 2""")
def sharpe_moments(spark, sf_dir):
    return rounded(V.sharpe_moments(B.log_returns(hourly(spark, sf_dir)), "asset"))


#: The normal distribution function by Simpson's rule on 200 steps from 0.
PHI = lambda z: f"(0.5 + ({z}) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 201), lambda k: (case when k in (0, 200) then 1 when k % 2 = 1 then 4 else 2 end) * exp(-0.5 * power(({z}) * k / 200.0, 2)))) / 600.0)"


@query(f"""with {RET}, m as (select asset, count(ret) as n, avg(ret) as mean, stddev_samp(ret) as std from r group by 1),
k as (select asset, m.n, any_value(mean / std) as sr, avg(power((ret - mean) / std, 3)) as g3, avg(power((ret - mean) / std, 4)) as g4 from r join m using (asset) where ret is not null group by 1, 2),
z as (select asset, sr, (sr - {stats.expected_max_sharpe(100, 0.02)!r}) / sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12) / (n - 1)) as z from k)
select asset, round(sr, 6) as sharpe, round({PHI('z')}, 6) as dsr, false as quarantined from z""")
def deflated_sharpe(spark, sf_dir):
    return rounded(V.deflated_sharpe(B.log_returns(hourly(spark, sf_dir)), 100, 0.02, "asset"))


SURFACE = "sf as (select l_linenumber::bigint as i, (l_suppkey % 6)::bigint as j, round(avg(l_discount) * 100, 6) as score from lineitem group by 1, 2)"


@query(f"""with {SURFACE},
nb as (select a.i, a.j, min(b.score) as robust, count(*) as n from sf a join sf b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1 group by 1, 2)
select i, j, round(robust, 6) as robust from nb where n = 9""")
def plateau(spark, sf_dir):
    s = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("i"), (F.col("l_suppkey") % 6).alias("j")).agg(F.round(F.avg("l_discount") * 100, 6).alias("score"))
    return rounded(V.plateau(s).select("i", "j", "robust"))


@query("""with s as (select o_custkey % 10 as account, o_orderkey, ['fx', 'index', 'metal', 'crypto'][(o_orderkey % 4 + 1)::int] as asset_class, (o_orderkey % 97 + 1) / 10.0 as size, o_orderdate from orders),
d as (select *, size * case asset_class when 'fx' then 1 / 30.0 when 'crypto' then 1 / 2.0 else 1 / 20.0 end * 1000.0 as desired from s),
w as (select *, 900.0 - coalesce(sum(desired) over (partition by account order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) as rest from d)
select account, o_orderkey, asset_class, round(desired, 6) as desired, round(greatest(0, least(desired, rest)), 6) as margin from w""")
def risk_margin(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    s = o.select((F.col("o_custkey") % 10).alias("account"), "o_orderkey", F.element_at(F.array(*map(F.lit, ("fx", "index", "metal", "crypto"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("asset_class"), ((F.col("o_orderkey") % 97 + 1) / 10.0).alias("size"), "o_orderdate")
    return rounded(V.risk_margin(s, "o_orderdate", "o_orderkey", equity=1000.0).select("account", "o_orderkey", "asset_class", "desired", "margin"))


@query("""with k as (select l_suppkey % 5 as grp, l_partkey as f, sum(l_quantity) as a, sum(l_discount) as b from lineitem group by 1, 2),
z as (select grp, rank() over (partition by grp order by a) + (count(*) over (partition by grp, a) - 1) / 2.0 as ra, rank() over (partition by grp order by rb0) + (count(*) over (partition by grp, rb0) - 1) / 2.0 as rb from (select *, round(b, 4) as rb0 from k))
select grp, round(corr(ra, rb), 6) as rho, corr(ra, rb) < 0.5 as drift from z group by 1""")
def spearman_drift(spark, sf_dir):
    k = views.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("grp"), "l_partkey").agg(F.sum("l_quantity").alias("a"), F.round(F.sum("l_discount"), 4).alias("b"))
    return rounded(V.concept_drift(k, "grp"))


@query(f"""with {BARS},
n as (select asset, count(*) as n, floor(count(*) * 0.5)::bigint as bp from bars group by 1),
s as (select b.asset, n, bp, seq, close as x, lead(close) over (partition by b.asset order by seq) - close as d from bars b join n using (asset)),
q as (select asset, n, bp, p, case p when 0 then true when 1 then seq < bp else seq > bp end as ok, x, d from s, range(3) t(p) where d is not null),
v as (select asset, n, bp, p, regr_syy(d, x) - power(regr_sxy(d, x), 2) / regr_sxx(d, x) as ssr from q where ok group by 1, 2, 3, 4),
z as (select asset, n, bp, sum(ssr) filter (p = 0) as a, sum(ssr) filter (p > 0) as b from v group by 1, 2, 3)
select asset, n, bp as breakpoint, round((a - b) / 2 / (b / (n - 4)), 6) as f_stat from z""")
def chow_f(spark, sf_dir):
    return rounded(V.chow(hourly(spark, sf_dir).select("asset", "seq", F.col("close").alias("value"))))


@query(f"""with {bars_sql("b4", 14400)},
y as (select asset, seq, ln(close) - avg(ln(close)) over a as x, count(*) over a as n, var_pop(ln(close)) over a as v from b4 window a as (partition by asset)),
p as (select *, lead(x) over (partition by asset order by seq) - x as d from y),
s as (select f.asset, f.seq as f, p.n, p.v, p.seq - f.seq + 1 as m, sum(p.x) over w as sx, sum(p.d) over w as sd, sum(p.x * p.x) over w as sxx, sum(p.x * p.d) over w as sxd, sum(p.d * p.d) over w as sdd
  from y f join p on p.asset = f.asset and p.seq >= f.seq where p.d is not null window w as (partition by f.asset, f.seq order by p.seq)),
q as (select asset, sxx - sx * sx / m as vxx, sxd - sx * sd / m as vxd, sdd - sd * sd / m as vdd, m from s where m >= greatest(20, floor(0.2 * n)) - 1 and v >= 1e-10),
t as (select asset, (vxd / vxx) / sqrt((vdd - vxd * vxd / vxx) / (m - 2) / vxx) as t from q where vxx > 1e-12 and (vdd - vxd * vxd / vxx) / (m - 2) > 1e-18)
select y.asset, count(distinct y.seq) as n, round(coalesce(any_value(g.t), 0), 6) as gsadf from y left join (select asset, max(t) as t from t group by 1) g using (asset) group by 1""")
def gsadf_stat(spark, sf_dir):
    return rounded(G.gsadf_statistic(B.time_bars(views.ticks(spark, sf_dir), "4h").select("asset", "seq", F.log("close").alias("value"))))


@query(f"""with {PRED}, c as (select source, p, least(greatest(p, 1e-5), 1 - 1e-5) as q from p), z as (select *, least((q - 0.5) / sqrt(q * (1 - q)), 8.0) as z from c)
select source, round(p, 6) as p, round(case when p > 0.5 then 2 * {PHI('z')} - 1 else 0 end, 6) as bet from z""")
def bet_sizes(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(p.select("source", "p", V.bet_size("p").alias("bet")))


@query()
def batch_bets(spark, sf_dir):
    """Each source's signals sized together."""
    return rounded(E.size_batches(predictions(spark, sf_dir).select("source", "p"), "source"))


@query("""with o as (select o_custkey % 10 as account, 'a' || (o_orderkey % 7) as asset, o_orderkey as seq, case when o_orderkey % 3 = 0 then 'close' else 'open' end as action,
  case when o_orderkey % 2 = 0 then 'long' else 'short' end as side, (o_orderkey % 97 + 1) / 10.0 as size, o_totalprice as price, o_totalprice / 100 as margin from orders),
l as (select *, lag(action) over w = 'open' as had, lag(side) over w as s, lag(size) over w as z, lag(price) over w as p, lag(margin) over w as m from o window w as (partition by account, asset order by seq)),
c as (select *, case when action = 'open' then margin else 0 end - case when had then m else 0 end as change from l)
select account, asset, seq, round(case when action = 'close' and had then p end, 6) as entry_price, round(case when action = 'close' and had then case when s = 'long' then 1 else -1 end * (price - p) * z end, 4) as pnl,
  round(sum(change) over (partition by account order by seq), 4) as held from c""")
def order_ledger(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    orders = o.select(
        (F.col("o_custkey") % 10).alias("account"), F.concat(F.lit("a"), (k % 7).cast("string")).alias("asset"), k.alias("seq"), F.when(k % 3 == 0, "close").otherwise("open").alias("action"),
        F.when(k % 2 == 0, "long").otherwise("short").alias("side"), ((k % 97 + 1) / 10.0).alias("size"), price.alias("price"), (price / 100).alias("margin"),
    )
    done = E.ledger(orders)
    return done.select("account", "asset", "seq", (F.round("entry_price", 6) + 0.0).alias("entry_price"), (F.round("pnl", 4) + 0.0).alias("pnl"), (F.round("held", 4) + 0.0).alias("held"))


@query("""with t as (select 'a' || (l_suppkey % 7) as asset, 'f' || (l_partkey % 3) as family, l_linenumber as k, count(*) as n from lineitem group by 1, 2, 3)
select asset, family, count(*) as trials, sum(n)::double as total, count(*) filter (k = 1)::bigint as deployed from t group by 1, 2""")
def registry_trials(spark, sf_dir):
    """Experiments recorded, recorded again in vain, some of them deployed, and counted."""
    t = views.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("a"), (F.col("l_suppkey") % 7).cast("string")).alias("asset"), F.concat(F.lit("f"), (F.col("l_partkey") % 3).cast("string")).alias("family"), "l_linenumber").agg(F.count("*").alias("n"))
    found = t.select("asset", "family", F.create_map(F.lit("k"), F.col("l_linenumber").cast("double")).alias("params"), F.lit("completed").alias("status"), F.col("n").cast("double").alias("metric"))
    registry = R.Registry(spark, f"{views.shared_folder(spark)}/registry-{uuid.uuid4().hex[:12]}")
    registry.record(found)
    registry.record(found.withColumn("metric", F.lit(0.0)))
    registry.update_all(registry.current().where("params['k'] = 1").select("experiment_id"), deployed=True)
    return registry.current().groupBy("asset", "family").agg(F.count("*").alias("trials"), F.sum("metric").alias("total"), F.count_if("deployed").alias("deployed"))


def meta_data(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    f = feature_frame(spark, sf_dir).select("event_id", F.col("event_id").alias("t0"), (F.col("event_id") + 5).alias("t1"), (F.col("label") < 5).cast("int").alias("y"), *_NAMES)
    return f, C.purged_kfold(f.select("event_id", "t0", "t1"), 4)


@query()
def meta_out_of_fold(spark, sf_dir):
    data, roles = meta_data(spark, sf_dir)
    return rounded(M.out_of_fold(data, roles, _NAMES))


@query()
def clustered_importance(spark, sf_dir):
    data, roles = meta_data(spark, sf_dir)
    clusters = S.cluster_features(S.correlation_distance(data, _NAMES), _NAMES)
    return rounded(S.clustered_mda(data, roles, _NAMES, clusters))


@query()
def single_importance(spark, sf_dir):
    data, roles = meta_data(spark, sf_dir)
    return rounded(S.single_feature_importance(data, roles, _NAMES))


@query()
def shuffled_targets(spark, sf_dir):
    data, roles = meta_data(spark, sf_dir)
    return rounded(M.target_shuffling(data, roles, _NAMES))


@query()
def donchian_sweep(spark, sf_dir):
    bars = B.time_bars(views.ticks(spark, sf_dir), "4h")
    return rounded(R.sweep(bars, "donchian", vol_span=20))


@query()
def meta_walk_forward(spark, sf_dir):
    """Calibrated walk-forward models and their diagnostics."""
    data, _ = meta_data(spark, sf_dir)
    return rounded(T.fold_diagnostics(T.train_meta(data, _NAMES, n_estimators=30)))


@query()
def strategy_gate(spark, sf_dir):
    """The verdict on a cohort of two forests and a boosted model."""
    data, _ = meta_data(spark, sf_dir)
    data = data.withColumn("ret", F.when(F.col("y") == 1, 0.01).otherwise(-0.01) + F.col("x0") / 100)
    cohort = [T.Candidate(f"forest_{d}", "forest", {"n_estimators": 20, "max_depth": d}) for d in (3, 5)] + [T.Candidate("boosted", "boosted", {"n_estimators": 20})]
    return rounded(T.validate_strategy(data, _NAMES, cohort, n_trials=50, std_of_trials=0.1))


@query()
def regime_checks(spark, sf_dir):
    series = B.time_bars(views.ticks(spark, sf_dir), "4h").select("asset", "seq", F.log("close").alias("value"))
    return rounded(G.check_regime(series)[0])


@query()
def shap_drift(spark, sf_dir):
    """Importances of a forest on its train rows and on later ones, for each of three groups."""
    data, _ = meta_data(spark, sf_dir)
    data = data.withColumn("grp", F.col("event_id") % 3).withColumn("role", F.when(F.col("event_id") % 5 < 3, "train").otherwise("live"))
    return rounded(G.check_drift(G.shap_importance(data, _NAMES, "grp"), "grp")[0])


@query()
def computed_features(spark, sf_dir):
    """The verdict on every feature: passed, rescued or dropped."""
    return rounded(D.compute_features(hourly(spark, sf_dir))[1])
