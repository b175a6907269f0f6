"""As-of context, counters and labels over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import deviation as D
from ..operators import labels as L
from ..operators import windows as W
from ..operators.quantiles import grouped_quantiles
from .binding import Bound, log, points, r6, table

BOUND = Bound()
LOG = "(select user_id, ts as log_ts, event_id as log_id, event_type as kind, value as log_value from events where event_type = '{}')"


@BOUND(f"select e.event_id, e.user_id, e.ts, l.log_ts as at, l.log_id, l.log_value from events e asof left join {LOG.format('error')} l on e.user_id = l.user_id and e.ts >= l.log_ts")
def asof_backward(spark, d):
    x = A.asof_join(points(spark, d), log(spark, d, "error"), ["user_id"], "ts", "log_ts", ["log_id", "log_value"], tie="log_id")
    return x.select("event_id", "user_id", "ts", "at", "log_id", "log_value")


@BOUND(f"""
select e.event_id, e.ts, case when l.log_ts <= e.ts + interval 6 hour then l.log_ts end as at, case when l.log_ts <= e.ts + interval 6 hour then l.log_id end as log_id
from events e asof left join {LOG.format('purchase')} l on e.user_id = l.user_id and e.ts <= l.log_ts""")
def asof_forward_tolerance(spark, d):
    x = A.asof_join(points(spark, d), log(spark, d, "purchase"), ["user_id"], "ts", "log_ts", ["log_id"], direction="forward", tie="log_id")
    near = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= 6 * 3_600_000_000
    return x.select("event_id", "ts", F.when(near, F.col("at")).alias("at"), F.when(near, F.col("log_id")).alias("log_id"))


@BOUND(f"select e.event_id, l.log_ts as at, l.log_id from events e asof left join {LOG.format('error')} l on e.user_id = l.user_id and e.ts >= l.log_ts")
def asof_bucketed(spark, d):
    x = A.asof_join(points(spark, d), log(spark, d, "error"), ["user_id"], "ts", "log_ts", ["log_id"], tie="log_id", bucket="day")
    return x.select("event_id", "at", "log_id")


@BOUND(f"""
select e.event_id, a.log_id as error_log_id, round(a.log_value, 6) as error_log_value, b.log_id as signup_log_id, round(b.log_value, 6) as signup_log_value, c.log_id as purchase_log_id, round(c.log_value, 6) as purchase_log_value
from events e
asof left join {LOG.format('error')} a on e.user_id = a.user_id and e.ts >= a.log_ts
asof left join {LOG.format('signup')} b on e.user_id = b.user_id and e.ts >= b.log_ts
asof left join {LOG.format('purchase')} c on e.user_id = c.user_id and e.ts >= c.log_ts""")
def asof_multi_event_fused(spark, d):
    kinds = ["error", "signup", "purchase"]
    x = A.asof_fused(points(spark, d), log(spark, d, *kinds), ["user_id"], "ts", "log_ts", "kind", kinds, ["log_id", "log_value"], tie="log_id")
    return x.select("event_id", *[c for k in kinds for c in (f"{k}_log_id", r6(f"{k}_log_value"))])


@BOUND(f"select e.event_id, l.log_id, l.log_value from events e asof left join {LOG.format('signup')} l on e.user_id = l.user_id and e.ts >= l.log_ts")
def interval_join(spark, d):
    x = A.interval_join(points(spark, d), log(spark, d, "signup"), ["user_id"], "ts", "log_ts", ["log_id", "log_value"], tie="log_id")
    return x.select("event_id", "log_id", "log_value")


@BOUND(f"""
with b as (select e.event_id, e.ts, l.log_ts as t0, l.log_id as i0 from events e asof left join {LOG.format('error')} l on e.user_id = l.user_id and e.ts >= l.log_ts),
f as (select e.event_id, l.log_ts as t1, l.log_id as i1 from events e asof left join {LOG.format('error')} l on e.user_id = l.user_id and e.ts <= l.log_ts),
g as (select event_id, i0, i1, t0, t1, (epoch_us(ts) - epoch_us(t0)) / 1e6 as g0, (epoch_us(t1) - epoch_us(ts)) / 1e6 as g1 from b join f using (event_id))
select event_id, case when g0 is not null and (g1 is null or g0 <= g1) then t0 else t1 end as nearest_at,
    case when g0 is not null and (g1 is null or g0 <= g1) then i0 else i1 end as log_id, round(least(g0, g1), 6) as seconds_off from g""")
def nearest_event(spark, d):
    x = A.nearest_join(points(spark, d), log(spark, d, "error"), ["user_id"], "ts", "log_ts", ["log_id"], tie="log_id")
    return x.select("event_id", "nearest_at", "log_id", r6("seconds_off"))


@BOUND("""
with f as (select user_id, min(ts) as first_ts from events where event_type = 'purchase' group by 1),
x as (select event_id, e.user_id, ts, ts >= first_ts as after_first from events e left join f using (user_id))
select event_id, case when after_first then row_number() over (partition by user_id, after_first order by ts, event_id) - 1
    else -row_number() over (partition by user_id, after_first order by ts desc, event_id desc) end as counter from x""")
def event_counters(spark, d):
    firsts = log(spark, d, "purchase").groupBy("user_id").agg(F.min("log_ts").alias("first_ts"))
    x = points(spark, d).join(firsts, "user_id", "left").withColumn("after_first", F.col("ts") >= F.col("first_ts"))
    return W.around(x, ["user_id"], ["ts", "event_id"], "after_first").select("event_id", F.col("counter").cast("long").alias("counter"))


@BOUND("""
with n as (select *, row_number() over (partition by user_id order by ts, event_id) as point_no from events)
select e.event_id, e.point_no - l.point_no as shots_since, l.event_id as since_id
from n e asof left join (select * from n where event_type = 'error') l on e.user_id = l.user_id and e.ts >= l.ts""")
def shots_since_event(spark, d):
    x = W.numbered(points(spark, d), ["user_id"], ["ts", "event_id"])
    mark = x.where("event_type = 'error'").select("user_id", F.col("ts").alias("log_ts"), F.col("event_id").alias("since_id"), F.col("point_no").alias("at_no"))
    y = A.asof_join(x, mark, ["user_id"], "ts", "log_ts", ["since_id", "at_no"], tie="since_id")
    return y.select("event_id", (F.col("point_no") - F.col("at_no")).cast("long").alias("shots_since"), "since_id")


@BOUND(f"""
select e.event_id, datediff('hour', l.log_ts, e.ts) as hours_crossed, datediff('day', l.log_ts, e.ts) as days_crossed, datediff('minute', l.log_ts, e.ts) as minutes_crossed
from events e asof left join {LOG.format('signup')} l on e.user_id = l.user_id and e.ts >= l.log_ts""")
def hours_since_event(spark, d):
    x = A.asof_join(points(spark, d), log(spark, d, "signup"), ["user_id"], "ts", "log_ts", [], tie="log_id")
    return x.select("event_id", *[S.boundaries(u, F.col("at"), F.col("ts")).alias(f"{u}s_crossed") for u in ("hour", "day", "minute")])


@BOUND("""
select event_id, case when hour(ts) >= 6 and hour(ts) < 14 then 'A' when hour(ts) >= 14 and hour(ts) < 22 then 'B' else 'C' end as shift,
    (ts - interval 6 hour)::date as shift_date, isodow(ts - interval 6 hour) <= 5 as in_production, date_trunc('hour', ts) as hour_ts,
    round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) as season_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) as season_cos from events""")
def shift_calendar(spark, d):
    t = F.col("ts")
    s, c = S.season(t)
    return points(spark, d).select("event_id", S.shift_label(t).alias("shift"), S.shift_date(t).alias("shift_date"), S.in_production_week(t).alias("in_production"), S.truncated("hour", t).alias("hour_ts"), r6(s, "season_sin"), r6(c, "season_cos"))


BANDS = """
with t as (select event_type, median(value) as t, quantile_cont(value, 0.02) as lo, quantile_cont(value, 0.98) as hi, quantile_cont(value, 0.1) as wlo, quantile_cont(value, 0.9) as whi from events group by 1),
x as (select event_id, user_id, ts, event_type, value, (value - t) / nullif(case when value >= t then hi - t else t - lo end, 0) as dev, value < lo or value > hi as a, value < wlo or value > whi as w from events join t using (event_type))
"""


def banded(spark, d):
    p = points(spark, d)
    shares = {"t": 0.5, "lo": 0.02, "hi": 0.98, "wlo": 0.1, "whi": 0.9}
    bands = grouped_quantiles(p, ["event_type"], "value", shares).drop("n")
    x = p.join(bands, "event_type")
    v = F.col("value")
    flags = [D.outside(v, F.col(a), F.col(b)) for a, b in (("lo", "hi"), ("wlo", "whi"))]
    return x.withColumns({"dev": D.deviation(v, F.col("t"), F.col("lo"), F.col("hi")), "state": D.alarm_state([flags[0]], [flags[1]], v.isNull())})


@BOUND(BANDS + "select event_id, round(dev, 6) as dev from x")
def band_deviation(spark, d):
    return banded(spark, d).select("event_id", r6("dev"))


@BOUND(BANDS + "select event_id, case when a then 'alarm' when w then 'warning' else 'none' end as state, case when a then 2 when w then 1 else 0 end::integer as code from x")
def alarm_state(spark, d):
    return banded(spark, d).select("event_id", "state", D.state_code(F.col("state")).alias("code"))


@BOUND(BANDS + """
select user_id, date_trunc('hour', ts) as hour_ts, max(case when a then 2 when w then 1 else 0 end)::integer as state_code, round(max(abs(coalesce(dev, 0))), 6) as max_abs_deviation,
    coalesce(string_agg(distinct case when a then event_type end, ';' order by case when a then event_type end), '') as alarmed, bool_or(a or w) as any_flag, count(*) as n_sensors,
    round(avg(case when event_type = 'view' then value end), 6) as view_mean, round(max(case when event_type = 'view' then value end) - min(case when event_type = 'view' then value end), 6) as view_spread
from x group by 1, 2""")
def shot_rollup(spark, d):
    x = banded(spark, d).withColumn("hour_ts", S.truncated("hour", F.col("ts")))
    y = D.rolled_up(x, ["user_id", "hour_ts"], "state", ["dev"], "event_type", {"view_mean": ("value", "event_type = 'view'")})
    return y.select("user_id", "hour_ts", "state_code", r6("max_abs_deviation"), "alarmed", "any_flag", "n_sensors", r6("view_mean"), r6("view_mean_spread", "view_spread"))


@BOUND("""
with n as (select *, row_number() over (partition by event_type order by ts, event_id) - 1 as p from events),
b as (select event_type, median(value) as t from n where p >= 100 and p < 160 group by 1)
select event_type, round(t, 6) as template, round(t - abs(t) * 0.3, 6) as alarm_low, round(t + abs(t) * 0.3, 6) as alarm_high, round(t - abs(t) * 0.3 * 0.6, 6) as warning_low, round(t + abs(t) * 0.3 * 0.6, 6) as warning_high from b""")
def template_bands(spark, d):
    x = W.numbered(points(spark, d), ["event_type"], ["ts", "event_id"], "p").withColumn("p", F.col("p") - 1)
    y = D.bands(x, ["event_type"], "p", {"value": 0.3}, first=100)
    return y.select("event_type", r6("value_template", "template"), *[r6(f"value_{c}", c) for c in ("alarm_low", "alarm_high", "warning_low", "warning_high")])


#: Rules for free text, first match wins.
RULES = [("short|tin", "short_shot"), ("bra(ss)?", "burn"), ("st(eel)?", "sink"), ("copper|nickel", "contamination")]
CASES = " ".join(f"when regexp_matches(lower({{0}}), '{p}') then '{c}'" for p, c in RULES)


@BOUND(f"select p_partkey, case when p_type is null or trim(p_type) = '' then 'other' {CASES.format('p_type')} else 'other' end as code, regexp_replace(upper(trim(p_brand)), '^(BRAND|PN|P)[- ]?', '') as brand_key from part")
def normalize_codes(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", S.normalized_code(F.col("p_type"), RULES).alias("code"), S.without_prefix(F.col("p_brand"), ("BRAND", "PN", "P")).alias("brand_key"))


CODED_SQL = """
with c as (select l_orderkey, l_returnflag as code, sum(l_quantity)::bigint as q from lineitem group by 1, 2),
coded as (select l_orderkey, string_agg(code || ':' || q, ';' order by code) as codes from c group by 1)
"""


def coded(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("code")).agg(F.sum("l_quantity").cast("long").alias("q"))
    return c.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", "q"))), ";").alias("codes"))


@BOUND(CODED_SQL + "select l_orderkey, split_part(x, ':', 1) as code, split_part(x, ':', 2)::double as qty from (select l_orderkey, unnest(string_split(codes, ';')) as x from coded)")
def explode_code_qty(spark, d):
    return L.exploded_codes(coded(spark, d), "codes", ["l_orderkey"])


@BOUND("""
with c as (select l_orderkey, string_agg(distinct l_returnflag, ';' order by l_returnflag) as codes from lineitem group by 1)
select l_orderkey, list_contains(string_split(codes, ';'), 'A')::integer as "is_A", list_contains(string_split(codes, ';'), 'N')::integer as "is_N", list_contains(string_split(codes, ';'), 'R')::integer as "is_R" from c""")
def one_hot_codes(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("codes"))
    return L.one_hot(c, "codes", ["A", "N", "R"]).drop("codes")


@BOUND("""
with t as (select user_id, date_trunc('day', ts) as day_ts, count(*) filter (where event_type = 'error')::double as qty from events group by 1, 2),
h as (select user_id, date_trunc('day', ts) as day_ts, date_trunc('hour', ts) as hour_ts, count(*) as n from events group by 1, 2, 3)
select user_id, day_ts, hour_ts, round(n / sum(n) over (partition by user_id, day_ts), 6) as share, round(qty * n / sum(n) over (partition by user_id, day_ts), 6) as allocated from h join t using (user_id, day_ts)""")
def proportional_allocation(spark, d):
    p = points(spark, d).withColumns({"day_ts": S.truncated("day", F.col("ts")), "hour_ts": S.truncated("hour", F.col("ts"))})
    totals = p.groupBy("user_id", "day_ts").agg(F.count_if(F.col("event_type") == "error").cast("double").alias("qty"))
    hours = p.groupBy("user_id", "day_ts", "hour_ts").agg(F.count(F.lit(1)).alias("n"))
    return L.allocated(totals, hours, ["user_id", "day_ts"], "qty", "n").select("user_id", "day_ts", "hour_ts", r6("share"), r6("allocated"))


@BOUND("""
select 'lineitem' as source, l_shipdate::timestamp as at, l_returnflag as code, l_quantity as qty, null::bigint as customer from lineitem where l_returnflag = 'R'
union all select 'orders', o_orderdate::timestamp, o_orderstatus, 1.0, o_custkey from orders where o_orderstatus = 'F'
union all select 'events', ts, event_type, value, user_id from events where event_type = 'error'""")
def union_sources(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_shipdate").alias("at"), F.col("l_returnflag").alias("code"), F.col("l_quantity").alias("qty"))
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("code"), F.lit(1.0).alias("qty"), F.col("o_custkey").alias("customer"))
    e = points(spark, d).where("event_type = 'error'").select(F.col("ts").alias("at"), F.col("event_type").alias("code"), F.col("value").alias("qty"), F.col("user_id").alias("customer"))
    return L.union_sources({"lineitem": li, "orders": o, "events": e})


@BOUND("""
with n as (select *, row_number() over (partition by user_id order by ts, event_id) as p from events),
b as (select user_id, median(value) as m from n where p <= 20 group by 1)
select event_id, round(value / nullif(m, 0) - 1, 6) as value_rel from n join b using (user_id)""")
def relative_to_baseline(spark, d):
    return L.relative_to_baseline(points(spark, d), ["user_id"], ["ts", "event_id"], ["value"], first=20).select("event_id", r6("value_rel"))


@BOUND("""
with b as (select e.event_id, e.user_id, e.ts, x.ts as blocked from events e asof left join (select * from events where event_type = 'error') x on e.user_id = x.user_id and e.ts >= x.ts),
u as (select b.*, y.ts as freed from b asof left join (select * from events where event_type = 'signup') y on b.user_id = y.user_id and b.ts >= y.ts)
select event_id, (8 - case when blocked is not null and (freed is null or freed < blocked) then 1 else 0 end)::integer as active from u""")
def active_units(spark, d):
    x = A.asof_fused(points(spark, d), log(spark, d, "error", "signup"), ["user_id"], "ts", "log_ts", "kind", ["error", "signup"], [], tie="log_id")
    blocked = F.col("error_at").isNotNull() & (F.col("signup_at").isNull() | (F.col("signup_at") < F.col("error_at")))
    return x.select("event_id", (8 - F.when(blocked, 1).otherwise(0)).cast("int").alias("active"))


@BOUND(f"""
select count(*) as n_leaks from (select e.ts, l.log_ts from events e asof left join {LOG.format('error')} l on e.user_id = l.user_id and e.ts >= l.log_ts) where log_ts > ts""")
def asof_leakage(spark, d):
    x = A.asof_join(points(spark, d), log(spark, d, "error"), ["user_id"], "ts", "log_ts", ["log_id"], tie="log_id", bucket="day")
    return A.leaks(x, "ts", ["at"]).agg(F.count(F.lit(1)).alias("n_leaks"))
