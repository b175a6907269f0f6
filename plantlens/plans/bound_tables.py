"""Report tables over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import reports as R
from .binding import Bound, log, points, r6, table

BOUND = Bound()


@BOUND("""
with m as (select date_trunc('month', o_orderdate)::timestamp as period, count(*) as n_orders, sum(o_totalprice) as v, avg((o_orderstatus = 'F')::int) as f from orders group by 1),
r as (select *, row_number() over (order by period desc) - 1 as lag from m)
select period, n_orders, round(v, 2) as value, round(f, 6) as final_share, lag::integer as lag from r where lag < 2""")
def plant_kpis(spark, d):
    o = table(spark, d, "orders")
    x = R.period_kpis(o, S.truncated("month", F.col("o_orderdate")), {"n_orders": F.count(F.lit(1)), "value": F.sum("o_totalprice"), "final_share": F.avg((F.col("o_orderstatus") == "F").cast("int"))})
    return x.select("period", "n_orders", F.round("value", 2).alias("value"), r6("final_share"), "lag")


@BOUND("select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n, string_agg(distinct event_type, ';' order by event_type) as kinds, count(*) filter (where event_type = 'error') as n_errors, count(*) filter (where value > 40) as n_high from events group by 1")
def run_headers(spark, d):
    return R.run_headers(points(spark, d), "user_id", "ts", {"kinds": "event_type"}, {"n_errors": F.col("event_type") == "error", "n_high": F.col("value") > 40})


@BOUND("""
with a as (select user_id from events group by 1 having max(ts) >= (select max(ts) from events) - interval 1 day)
select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where value > 40 and user_id in (select user_id from a)) where k = 1""")
def active_signals(spark, d):
    p = points(spark, d)
    return R.active_signals(p.where("value > 40").select("user_id", "event_id", "ts"), p, ["user_id"], "ts", 1, "event_id")


@BOUND("select user_id, date_trunc('hour', ts) as hour_ts, round(max(abs(value - 20)), 6) as worst from events group by 1, 2 having max(abs(value - 20)) > 40")
def audit_requests(spark, d):
    p = points(spark, d).withColumn("dev", F.col("value") - 20)
    return R.hours_over(p, ["user_id"], S.truncated("hour", F.col("ts")), "dev", 40).select("user_id", "hour_ts", r6("worst"))


@BOUND("select date_trunc('week', ts)::timestamp as week_ts, count(*) filter (where value > 60) as template, count(*) filter (where event_type = 'error') as rules, count(*) filter (where event_type = 'error' and value > 30) as drift from events group by 1")
def alarms_by_layer(spark, d):
    e = F.col("event_type") == "error"
    return R.weekly_layers(points(spark, d), S.truncated("week", F.col("ts")), {"template": F.col("value") > 60, "rules": e, "drift": e & (F.col("value") > 30)})


@BOUND("select l_suppkey, l_returnflag, count(*) filter (where l_quantity < 5) as below, count(*) filter (where l_quantity > 45) as above, count(l_quantity) as n from lineitem group by 1, 2")
def out_of_band(spark, d):
    return R.out_of_band(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", F.lit(5), F.lit(45))


@BOUND("select o_orderpriority, round(avg((l_shipdate is null)::int), 6) as l_shipdate_null, round(avg((l_tax is null)::int), 6) as l_tax_null from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def label_coverage(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return R.null_shares(x, ["o_orderpriority"], ["l_shipdate", "l_tax"]).select("o_orderpriority", r6("l_shipdate_null"), r6("l_tax_null"))


@BOUND("""
select user_id, ts as at, 'alarm' as kind, event_id::varchar as what from events where value > 60
union all select user_id, ts, 'change', event_type from events where event_type = 'purchase'
union all select user_id, max(ts), 'last', count(*)::varchar from events group by user_id""")
def shift_event_log(spark, d):
    p = points(spark, d)
    last = p.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return R.event_list({"alarm": (p.where("value > 60"), "ts", F.col("event_id")), "change": (p.where("event_type = 'purchase'"), "ts", F.col("event_type")), "last": (last, "ts", F.col("n"))}, "user_id")


@BOUND("""
with m as (select l_suppkey, date_trunc('month', l_shipdate)::timestamp as run, max(l_quantity) as peak from lineitem group by 1, 2)
select l_suppkey, run, round(peak / nullif(median(peak) over (partition by l_suppkey order by run rows between 5 preceding and 1 preceding), 0), 6) as over_recent from m""")
def run_overlay(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey", S.truncated("month", F.col("l_shipdate")).alias("run")).agg(F.max("l_quantity").alias("peak"))
    return R.overlay(m, ["l_suppkey"], "run", "peak").select("l_suppkey", "run", r6("over_recent"))


@BOUND("""
with c as (select event_id as log_id, user_id, ts from events where event_type = 'purchase'),
b as (select distinct log_id, e.event_type from c join events e on e.user_id = c.user_id and e.ts >= c.ts - interval 24 hour and e.ts < c.ts),
j as (select log_id, e.event_type, count(*) as n from c join events e on e.user_id = c.user_id and e.ts >= c.ts and e.ts < c.ts + interval 24 hour anti join b using (log_id, event_type) group by 1, 2 having count(*) >= 2)
select log_id, effect, n from (select log_id, event_type as effect, n, row_number() over (partition by log_id order by n desc, event_type desc) as k from j) where k = 1""")
def tampering_followed(spark, d):
    c = log(spark, d, "purchase").select("log_id", "user_id", "log_ts")
    x = R.followed_by(c, points(spark, d), "user_id", "log_ts", "ts", "event_type", 86400, 2)
    return x.select("log_id", "effect", "n")
