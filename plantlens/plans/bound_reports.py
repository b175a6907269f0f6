"""Marts, capability and report tables over lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import capability as K
from ..operators import checks as Q
from ..operators import curves as V
from ..operators import labels as L
from .binding import Bound, points, r6, table

BOUND = Bound()
MONTH = "date_trunc('month', l_shipdate)::timestamp"


def pieces(spark, d):
    return table(spark, d, "lineitem").withColumn("month_ts", S.truncated("month", F.col("l_shipdate")))


@BOUND(f"""
select {MONTH} as month_ts, p_brand, l_returnflag as code, sum(l_quantity)::double as qty, round(sum(l_extendedprice), 2) as cost, count(distinct l_orderkey) as n_orders
from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1, 2, 3""")
def plant_scrap_mart(spark, d):
    x = pieces(spark, d).where("l_returnflag = 'R'").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("month_ts", "p_brand", F.col("l_returnflag").alias("code")).agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.count_distinct("l_orderkey").alias("n_orders"))


@BOUND("""
select date_trunc('month', o_orderdate)::timestamp as month_ts, c_mktsegment, count(*) as n_orders, round(sum(o_totalprice), 2) as value, count(c_custkey) as n_linked
from orders left join customer on o_custkey = c_custkey group by all""")
def plant_output_mart(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("month_ts", S.truncated("month", F.col("o_orderdate")))
    return x.groupBy("month_ts", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("c_custkey").alias("n_linked"))


@BOUND("""
with s as (select l_orderkey, count(*) as n_pieces, sum(l_quantity)::double as qty, sum(l_quantity) filter (where l_returnflag = 'R')::double as rejected, count(*) filter (where l_linestatus = 'F') as n_final, min(l_shipdate)::timestamp as first_ts, max(l_shipdate)::timestamp as last_ts from lineitem group by 1)
select o_orderkey, o_custkey, coalesce(n_pieces, 0) as n_pieces, qty, coalesce(rejected, 0.0) as rejected, coalesce(n_final, 0) as n_final, datediff('day', first_ts, last_ts) as days, round(rejected / nullif(qty, 0), 6) as reject_share, last_ts + interval 21 day <= timestamp '1998-09-01' as matured
from orders left join s on o_orderkey = l_orderkey""")
def job_fact(spark, d):
    reject = F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("l_quantity").alias("qty"), F.sum(reject).alias("rejected"), F.count_if(F.col("l_linestatus") == "F").alias("n_final"), F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"))
    x = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    matured = F.col("last_ts") + F.make_dt_interval(days=F.lit(21)) <= F.lit("1998-09-01").cast("timestamp_ntz")
    return x.select("o_orderkey", "o_custkey", zero("n_pieces"), "qty", zero("rejected"), zero("n_final"), S.boundaries("day", F.col("first_ts"), F.col("last_ts")).alias("days"), r6(S.ratio(F.col("rejected"), F.col("qty")), "reject_share"), matured.alias("matured"))


@BOUND("""
with h as (select user_id, date_trunc('hour', ts) as hour_ts, count(*) as n, avg(value) as m, count(*) filter (where value > 30) as n_high, max(event_id) as last_id from events group by 1, 2),
e as (select user_id, date_trunc('hour', ts) as hour_ts, count(*) as n_errors from events where event_type = 'error' group by 1, 2)
select user_id, hour_ts, n, round(m, 6) as mean_value, n_high, last_id, coalesce(n_errors, 0) as n_errors from h left join e using (user_id, hour_ts)""")
def job_hour_fact(spark, d):
    p = points(spark, d).withColumn("hour_ts", S.truncated("hour", F.col("ts")))
    # One pass: the errors of the hour are a filtered count, so no second aggregate is joined.
    return p.groupBy("user_id", "hour_ts").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean_value"), F.count_if(F.col("value") > 30).alias("n_high"), F.max("event_id").alias("last_id"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


@BOUND("""
with l as (select l_orderkey, max(l_shipdate)::timestamp as last_ts from lineitem group by 1),
x as (select l_quantity as qty, datediff('day', l_shipdate::timestamp, last_ts) as days from lineitem join l using (l_orderkey))
select round(sum(case when days <= 0 then qty else 0 end) / sum(qty), 6) as share_0d, round(sum(case when days <= 7 then qty else 0 end) / sum(qty), 6) as share_7d, round(sum(case when days <= 21 then qty else 0 end) / sum(qty), 6) as share_21d, round(sum(case when days <= 60 then qty else 0 end) / sum(qty), 6) as share_60d from x""")
def maturity_curve(spark, d):
    li = table(spark, d, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ts"))
    x = li.join(last, "l_orderkey").select(F.col("l_quantity").alias("qty"), S.boundaries("day", F.col("l_shipdate"), F.col("last_ts")).alias("days"))
    return L.maturity(x, "qty", "days", [0, 7, 21, 60]).select(*[r6(f"share_{k}d") for k in (0, 7, 21, 60)])


@BOUND("select l_returnflag, count(*) as n, count(o_orderkey) as n_linked, round(count(o_orderkey) / count(*), 6) as share from lineitem left join orders on l_orderkey = o_orderkey and o_orderstatus = 'F' group by 1")
def linkage_coverage(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    x = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return L.coverage(x, ["l_returnflag"], F.col("o_orderkey").isNotNull()).select("l_returnflag", "n", "n_linked", r6("share"))


D2_SQL = "case when {0} <= 2.5 then 1.128 when {0} <= 3.5 then 1.693 when {0} <= 4.5 then 2.059 when {0} <= 5.5 then 2.326 when {0} <= 6.5 then 2.534 when {0} <= 7.5 then 2.704 when {0} <= 8.5 then 2.847 when {0} <= 9.5 then 2.970 when {0} <= 11 then 3.078 when {0} <= 13.5 then 3.258 when {0} <= 17.5 then 3.472 else 3.735 end::double"
D4_SQL = "case when {0} <= 2.5 then 3.267 when {0} <= 3.5 then 2.574 when {0} <= 4.5 then 2.282 when {0} <= 5.5 then 2.114 when {0} <= 6.5 then 2.004 when {0} <= 7.5 then 1.924 when {0} <= 8.5 then 1.864 when {0} <= 9.5 then 1.816 else 1.777 end::double"


@BOUND(f"""
with g as (select l_suppkey, l_orderkey, count(*) as n, max(l_quantity) - min(l_quantity) as r from lineitem group by 1, 2),
w as (select l_suppkey, avg(r / {D2_SQL.format('n')}) as sw from g where n > 1 group by 1),
a as (select l_suppkey, count(*) as n, avg(l_quantity) as m, stddev_samp(l_quantity) as so from lineitem group by 1)
select l_suppkey, n, round(m, 6) as mean, round(sw, 6) as sigma_within, round(so, 6) as sigma_overall, round(50 / nullif(6 * sw, 0), 6) as cp, round(least(51 - m, m - 1) / nullif(3 * sw, 0), 6) as cpk, round(least(51 - m, m - 1) / nullif(3 * so, 0), 6) as ppk
from a left join w using (l_suppkey)""")
def capability_cpk(spark, d):
    x = K.capability(table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey", "l_quantity", F.lit(1.0), F.lit(51.0))
    return x.select("l_suppkey", "n", *[r6(c) for c in ("mean", "sigma_within", "sigma_overall", "cp", "cpk", "ppk")])


XBAR = f"""
with g as (select l_suppkey, date_trunc('month', l_shipdate)::timestamp as month_ts, count(l_quantity) as n, avg(l_quantity) as m, max(l_quantity) - min(l_quantity) as r from lineitem group by 1, 2),
k as (select *, row_number() over (partition by l_suppkey order by month_ts) as no from g),
b as (select l_suppkey, avg(m) as gm, avg(r) as mr, avg(n) as mn from k where no <= 25 group by 1),
l as (select *, gm + 3 / ({D2_SQL.format('mn')} * sqrt(mn)) * mr as upper, gm - 3 / ({D2_SQL.format('mn')} * sqrt(mn)) * mr as lower, {D4_SQL.format('mn')} * mr as range_upper from b)
"""


def xbar(spark, d):
    return K.xbar_r(K.subgroups(pieces(spark, d), ["l_suppkey", "month_ts"], "l_quantity"), ["l_suppkey"], ["month_ts"])


@BOUND(XBAR + "select l_suppkey, round(gm, 6) as grand_mean, round(mr, 6) as mean_range, round(upper, 6) as upper, round(lower, 6) as lower, round(range_upper, 6) as range_upper from l")
def xbar_r_limits(spark, d):
    x = xbar(spark, d).select("l_suppkey", *[r6(c) for c in ("grand_mean", "mean_range", "upper", "lower", "range_upper")])
    return x.distinct()


@BOUND(XBAR + "select l_suppkey, month_ts, no::integer as group_no, m > upper or m < lower as mean_out, r > range_upper as range_out from k join l using (l_suppkey)")
def xbar_rules(spark, d):
    return xbar(spark, d).select("l_suppkey", "month_ts", "group_no", "mean_out", "range_out")


@BOUND("with n as (select p_type, sum(l_quantity)::double as n from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' group by 1) select p_type, n, (row_number() over (order by n desc, p_type))::integer as rank, round(sum(n) over (order by n desc, p_type) / sum(n) over (), 6) as cumulative from n")
def pareto_period(spark, d):
    x = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return L.pareto(x, "p_type", F.col("l_quantity")).select("p_type", "n", "rank", r6("cumulative"))


@BOUND(f"select {MONTH} as month_ts, p_brand, sum(l_quantity) filter (where l_returnflag = 'R')::double as sorted, sum(l_quantity) filter (where l_returnflag = 'R' and l_linestatus = 'O')::double as good, round(sum(l_quantity) filter (where l_returnflag = 'R' and l_linestatus = 'O') / nullif(sum(l_quantity) filter (where l_returnflag = 'R'), 0), 6) as false_share from lineitem join part on l_partkey = p_partkey group by 1, 2")
def false_reject_share(spark, d):
    x = pieces(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s, g = F.col("l_returnflag") == "R", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    q = F.col("l_quantity")
    x = x.groupBy("month_ts", "p_brand").agg(F.sum(F.when(s, q)).alias("sorted"), F.sum(F.when(g, q)).alias("good"))
    return x.withColumn("false_share", r6(S.ratio(F.col("good"), F.col("sorted")), "x"))


@BOUND(f"with m as (select l_suppkey, {MONTH} as mo, avg(l_quantity) as a from lineitem group by 1, 2) select l_suppkey, round(max(a) - min(a), 6) as swing, count(*) as n_months from m group by 1")
def monthly_swing(spark, d):
    m = pieces(spark, d).groupBy("l_suppkey", "month_ts").agg(F.avg("l_quantity").alias("a"))
    return m.groupBy("l_suppkey").agg(r6(F.max("a") - F.min("a"), "swing"), F.count(F.lit(1)).alias("n_months"))


@BOUND("""
with p as (select user_id, avg(value) filter (where event_type = 'click') as a, avg(value) filter (where event_type = 'view') as b from events group by 1)
select user_id, round(a, 6) as click, round(b, 6) as view, round(a - b, 6) as difference, (a - b) between (select quantile_cont(a - b, 0.025) from p) and (select quantile_cont(a - b, 0.975) from p) as in_range from p""")
def cavity_balance(spark, d):
    p = points(spark, d).groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value")).withColumn("difference", F.col("click") - F.col("view"))
    r = p.agg(F.percentile("difference", F.lit(0.025)).alias("lo"), F.percentile("difference", F.lit(0.975)).alias("hi"))
    return p.crossJoin(F.broadcast(r)).select("user_id", r6("click"), r6("view"), r6("difference"), F.col("difference").between(F.col("lo"), F.col("hi")).alias("in_range"))  # one row


@BOUND("with w as (select date_trunc('week', ts) as week_ts, count(distinct (user_id, date_trunc('hour', ts))) filter (where event_type = 'error') as n_alarm_hours, count(distinct date_trunc('hour', ts)) as hours from events group by 1) select week_ts::timestamp as week_ts, n_alarm_hours, round(n_alarm_hours / (hours / 8), 6) as per_shift from w")
def weekly_alarm_rate(spark, d):
    p = points(spark, d).withColumns({"week_ts": S.truncated("week", F.col("ts")), "hour_ts": S.truncated("hour", F.col("ts"))})
    hours = p.groupBy("week_ts", "hour_ts", "user_id").agg(F.bool_or(F.col("event_type") == "error").alias("e"))
    x = hours.groupBy("week_ts").agg(F.count_if("e").alias("n_alarm_hours"), F.count_distinct("hour_ts").alias("hours"))
    return x.select("week_ts", "n_alarm_hours", r6(F.col("n_alarm_hours") / (F.col("hours") / 8), "per_shift"))


@BOUND("select floor(l_quantity / 5)::bigint as bin, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from lineitem group by 1")
def histogram_share(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy()), "x"))


@BOUND("""
with c as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c),
t as (select user_id, string_agg(event_type, '; ' order by k) as causes from r where k <= 2 group by 1),
f as (select user_id, event_type, min(ts) as first_at from events group by 1, 2), s as (select user_id, string_agg(event_type, ';' order by first_at) as seen from f group by 1)
select user_id, causes, seen from t join s using (user_id)""")
def top_causes(spark, d):
    p = points(spark, d)
    return L.top_causes(p, ["user_id"], "event_type").join(L.first_seen(p, ["user_id"], "event_type", "ts"), "user_id")


@BOUND("select user_id, event_id as last_id, event_type as last_type, round(value, 6) as last_value, ts as last_ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_status(spark, d):
    last = F.max_by(F.struct("event_id", "event_type", "value", "ts"), F.struct("ts", "event_id")).alias("x")
    return points(spark, d).groupBy("user_id").agg(last).select("user_id", F.col("x.event_id").alias("last_id"), F.col("x.event_type").alias("last_type"), r6("x.value", "last_value"), F.col("x.ts").alias("last_ts"))


@BOUND("select l_suppkey, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) as weighted_discount, round(sum(l_quantity) / count(*), 6) as mean_qty, median(l_quantity) as median_qty from lineitem group by 1 order by sum(l_extendedprice) desc, l_suppkey limit 12")
def top_groups(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_extendedprice"), "weighted_discount"), r6(F.avg("l_quantity"), "mean_qty"), F.median("l_quantity").alias("median_qty"), F.sum("l_extendedprice").alias("_s"))
    return x.orderBy(F.desc("_s"), "l_suppkey").limit(12).drop("_s")


CURVE = "(select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding)))::bigint as t from embeddings)"


def curves(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("t", "v")).select("vec_id", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))


@BOUND(f"""
with c as (select * from {CURVE}),
f as (select vec_id, min(t) filter (where v >= 0.1) as arrival, max(v) as peak, sum(v) filter (where t < 20) as fi, sum(v) filter (where t >= 20) as pi, sum(v) as ci, avg(v) filter (where t >= 20) as plateau from c group by 1),
pk as (select vec_id, t as peak_at from (select *, row_number() over (partition by vec_id order by v desc, t) as k from c) where k = 1),
s as (select c.vec_id, min(t) filter (where v < 0.95 * plateau) as seal_at, regr_slope(v, t) as slope from c join f using (vec_id) join pk using (vec_id) where t > peak_at group by 1)
select f.vec_id, arrival, round(peak, 6) as peak, peak_at, round(fi, 6) as fill_integral, round(pi, 6) as pack_integral, round(ci, 6) as cycle_integral, seal_at, round(slope, 6) as cooling_slope from f join pk using (vec_id) left join s using (vec_id)""")
def curve_features(spark, d):
    x = V.curve_features(curves(spark, d), ["vec_id"], "t", "v", F.lit(20), 0.1)
    return x.select("vec_id", "arrival", r6("peak"), "peak_at", r6("fill_integral"), r6("pack_integral"), r6("cycle_integral"), "seal_at", r6("cooling_slope"))


@BOUND(f"""
with c as (select * from {CURVE}), l as (select vec_id, max(t) as last from c group by 1),
p as (select vec_id, floor(t / (last + 10) * 24)::integer as bin, avg(v) as v from c join l using (vec_id) group by 1, 2),
g as (select vec_id, unnest(range(24))::integer as bin from l), j as (select vec_id, bin, coalesce(last_value(v ignore nulls) over (partition by vec_id order by bin), 0) as v from g left join p using (vec_id, bin)),
b as (select vec_id, median(v) as held from j where bin >= 12 group by 1), k as (select vec_id, bin, v - held as w from j join b using (vec_id)),
m as (select label, median(peak) as scale from (select vec_id, max(w) as peak from k group by 1) join embeddings using (vec_id) group by 1)
select vec_id, bin, round(w / nullif(scale, 0), 6) as level from k join embeddings using (vec_id) join m using (label)""")
def curve_resample(spark, d):
    """Each vector is a curve, its label the job."""
    x = curves(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return V.resampled(x, ["vec_id"], "t", "v", bins=24, scale_by=["label"]).select("vec_id", "bin", r6("level"))


@BOUND(f"with c as (select * from {CURVE}) select case when label < 5 then 'early' else 'late' end as phase, t, round(avg(v), 6) as mean, count(v) as n from c join embeddings using (vec_id) group by 1, 2")
def mean_curve_by_phase(spark, d):
    x = curves(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    return V.mean_by_phase(x, F.when(F.col("label") < 5, "early").otherwise("late"), "t", "v").select("phase", "t", r6("mean"), "n")


@BOUND("""
select 'reject_share' as measure, round((select avg((l_returnflag = 'R')::int) from lineitem), 6) as value, 0.1::double as low, 0.5::double as high, (select avg((l_returnflag = 'R')::int) from lineitem) between 0.1 and 0.5 as passed
union all select 'mean_value', round((select avg(value) from events), 6), 0.0, 10.0, (select avg(value) from events) between 0 and 10
union all select 'linked_orders', round((select avg((o_custkey is not null)::int) from orders), 6), 0.8, 1.0, (select avg((o_custkey is not null)::int) from orders) between 0.8 and 1.0""")
def range_checks(spark, d):
    share = lambda c: F.avg(c.cast("int"))
    x = Q.range_checks({"reject_share": (table(spark, d, "lineitem"), share(F.col("l_returnflag") == "R"), 0.1, 0.5), "mean_value": (points(spark, d), F.avg("value"), 0, 10), "linked_orders": (table(spark, d, "orders"), share(F.col("o_custkey").isNotNull()), 0.8, 1)})
    return x.withColumn("value", r6("value"))


@BOUND("""
select 'event_id' as check_name, (select count(*) from (select event_id from events group by 1 having count(*) > 1)) as n
union all select 'lineitem_key', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))
union all select 'null_value', (select count(*) from events where value is null)
union all select 'event_type', (select count(distinct event_type) from events where event_type not in ('click', 'view', 'purchase', 'error'))""")
def unique_not_null(spark, d):
    p, li = points(spark, d), table(spark, d, "lineitem")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
    null = Q.nulls(p, ["value"]).select(F.lit("null_value").alias("check_name"), F.col("n_null").alias("n"))
    return n(Q.not_unique(p, ["event_id"]), "event_id").unionByName(n(Q.not_unique(li, ["l_orderkey", "l_linenumber"]), "lineitem_key")).unionByName(null).unionByName(n(Q.not_accepted(p, "event_type", ["click", "view", "purchase", "error"]), "event_type"))


@BOUND("""
with x as (select user_id, value, lag(value) over (partition by user_id order by ts, event_id) as p from events)
select user_id, count(*) as n, round(covar_samp(value, p) / nullif(stddev_samp(value) * stddev_samp(p), 0), 6) as lag1 from x where p is not null group by 1""")
def lag1_autocorrelation(spark, d):
    return Q.lag1_autocorrelation(points(spark, d), ["user_id"], ["ts", "event_id"], "value").select("user_id", "n", r6("lag1"))


@BOUND("with m as (select event_type, median(value) as m from events group by 1) select event_type, round(1.4826 * median(abs(value - m)), 6) as spread from events join m using (event_type) group by 1")
def robust_spread(spark, d):
    return Q.robust_spread(points(spark, d), ["event_type"], "value").select("event_type", r6("spread"))


@BOUND("""
with c as (select l_suppkey, count(*) as n, covar_samp(l_quantity, l_quantity) as aa, covar_samp(l_discount, l_discount) as bb, covar_samp(l_quantity, l_discount) as ab, covar_samp(l_quantity, l_extendedprice) as ay, covar_samp(l_discount, l_extendedprice) as byy, covar_samp(l_extendedprice, l_extendedprice) as yy from lineitem group by 1)
select l_suppkey, n, round((ay * ay * bb - 2 * ay * byy * ab + byy * byy * aa) / nullif(aa * bb - ab * ab, 0) / nullif(yy, 0), 6) as r2 from c""")
def two_regressor_r2(spark, d):
    return Q.two_regressor_r2(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", "l_discount").select("l_suppkey", "n", r6("r2"))
