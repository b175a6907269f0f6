"""Charts, rules and drift over events; shorter baselines than on the shop floor, as the series have 50 to 90 points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import drift as R
from ..operators import spc as C
from ..operators import windows as W
from .binding import Bound, log, points, r6

BOUND = Bound()
KEYS, ORDER, BASE = ["user_id"], ["ts", "event_id"], 20

CHART = f"""
with c0 as (select event_id, user_id, ts, event_type, value, row_number() over w as point_no, lag(value) over w as previous, avg(value) over (partition by user_id order by ts, event_id rows between 30 preceding and 1 preceding) as recent_mean,
    count(value) over (partition by user_id order by ts, event_id rows between 30 preceding and 1 preceding) as recent_n from events window w as (partition by user_id order by ts, event_id)),
c as (select *, abs(value - previous) as moving_range from c0),
lim as (select user_id, count(value) as n, avg(value) as centre, avg(moving_range) as mr_bar, stddev_samp(value) as sigma_baseline from c where point_no <= {BASE} group by 1),
fit as (select user_id, count(value) as ar_n, avg(value) as ar_mean, stddev_samp(value) as ar_sd,
    greatest(0, least(0.98, covar_samp(value, previous) / nullif(stddev_samp(case when previous is not null then value end) * stddev_samp(previous), 0))) as phi from c where point_no > 5 and point_no <= 45 group by 1),
res as (select *, (value - level) - phi * (previous - level) as residual from (select c.*, fit.phi, case when recent_n >= 10 then recent_mean else ar_mean end as level from c join fit using (user_id))),
z as (select res.*, lim.mr_bar, residual / nullif(stddev_samp(residual) over (partition by res.user_id), 0) as z, coalesce(residual / nullif(stddev_samp(residual) over (partition by res.user_id), 0), 0) as v from res join lim using (user_id)),
rules as (select *, abs(v) > 3 as we1,
    sum((v > 2)::int) over (w rows between 2 preceding and current row) >= 2 or sum((v < -2)::int) over (w rows between 2 preceding and current row) >= 2 as we2,
    sum((v > 1)::int) over (w rows between 4 preceding and current row) >= 4 or sum((v < -1)::int) over (w rows between 4 preceding and current row) >= 4 as we4,
    sum((v > 0)::int) over (w rows between 7 preceding and current row) >= 8 or sum((v < 0)::int) over (w rows between 7 preceding and current row) >= 8 as we5,
    moving_range > 3.267 * mr_bar as mr_rule from z window w as (partition by user_id order by ts, event_id)),
fired as (select *, case when we1 then 'WE1' when we2 then 'WE2' when we4 then 'WE4' when we5 then 'WE5' when mr_rule then 'MR' end as rule from rules),
alarms as (select * from (select *, lag(point_no) over (partition by user_id order by point_no) as before from fired where rule is not null) where before is null or point_no - before > 1)
"""
FLAGS = {"we1": "WE1", "we2": "WE2", "we4": "WE4", "we5": "WE5", "mr_rule": "MR"}


def chart(spark, d):
    return C.charted(points(spark, d), KEYS, ORDER)


def residuals(spark, d):
    x = chart(spark, d)
    return C.ar1_residual(x, C.ar1_fit(x, KEYS, 5, 45), KEYS, ORDER, level_rows=30, least=10)


def ruled(spark, d):
    from pyspark.sql import Window

    x = residuals(spark, d)
    sd = F.stddev_samp("residual").over(Window.partitionBy(*KEYS))
    x = x.withColumn("z", F.col("residual") / F.nullif(sd, F.lit(0.0))).join(C.imr_limits(chart(spark, d), KEYS, BASE).select("user_id", "mr_bar"), "user_id")
    return C.range_rule(C.run_rules(x, KEYS, ORDER, "z"))


@BOUND("""
select user_id, metric, value from (select user_id, event_id, ts, value as value_a, case when event_type = 'view' then value * 2 end as value_b from events) unpivot (value for metric in (value_a, value_b))""")
def unpivot_points(spark, d):
    x = points(spark, d).select("user_id", F.col("value").alias("value_a"), F.when(F.col("event_type") == "view", F.col("value") * 2).alias("value_b"))
    return C.unpivoted(x, ["user_id"], ["value_a", "value_b"])


@BOUND(CHART + "select user_id, n, round(centre, 6) as centre, round(mr_bar, 6) as mr_bar, round(sigma_baseline, 6) as sigma_baseline, round(mr_bar / 1.128, 6) as sigma_range, round(centre + 3 * mr_bar / 1.128, 6) as upper, round(centre - 3 * mr_bar / 1.128, 6) as lower, round(3.267 * mr_bar, 6) as range_upper from lim")
def imr_limits(spark, d):
    return C.imr_limits(chart(spark, d), KEYS, BASE).select("user_id", "n", *[r6(c) for c in ("centre", "mr_bar", "sigma_baseline", "sigma_range", "upper", "lower", "range_upper")])


@BOUND(CHART + "select user_id, ar_n, round(ar_mean, 6) as ar_mean, round(ar_sd, 6) as ar_sd, round(phi, 6) as phi from fit")
def ar1_fit(spark, d):
    return C.ar1_fit(chart(spark, d), KEYS, 5, 45).select("user_id", "ar_n", *[r6(c) for c in ("ar_mean", "ar_sd", "phi")])


@BOUND(CHART + "select event_id, round(level, 6) as level, round(residual, 6) as residual from res")
def ar1_residual(spark, d):
    return residuals(spark, d).select("event_id", r6("level"), r6("residual"))


@BOUND(CHART + """
, wk as (select user_id, date_trunc('week', ts) as run, min(ts) as starts, sum(case when residual is not null then residual * residual end) as ss, count(residual) as n, stddev_samp(residual) as own from res group by 1, 2)
select user_id, run, n, round(coalesce(sqrt(sum(ss) over w / nullif(sum(n) over w, 0)), own), 6) as sigma from wk window w as (partition by user_id order by starts, run rows between unbounded preceding and 1 preceding)""")
def pooled_prior_sigma(spark, d):
    x = residuals(spark, d).withColumn("run", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    return C.pooled_sigma(x, ["user_id", "run"], ["user_id"], "ts", 0, 0, 10**9).select("user_id", "run", "n", r6("sigma"))


@BOUND(CHART + "select event_id, round(z, 6) as z, we1, we2, we4, we5, mr_rule from rules")
def we_rules(spark, d):
    return ruled(spark, d).select("event_id", r6("z"), "we1", "we2", "we4", "we5", "mr_rule")


@BOUND(CHART + f"select user_id, date_trunc('day', ts) as day_ts, bool_or(we1) as any_we1, bool_or(we2) as any_we2, bool_or(we4 or we5) as any_run, coalesce(bool_or(mr_rule), false) as any_mr, count(*) as n from rules where point_no > {BASE} group by 1, 2")
def series_flags(spark, d):
    x = ruled(spark, d).where(F.col("point_no") > BASE).withColumn("day_ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return x.groupBy("user_id", "day_ts").agg(F.bool_or("we1").alias("any_we1"), F.bool_or("we2").alias("any_we2"), F.bool_or(F.col("we4") | F.col("we5")).alias("any_run"), F.coalesce(F.bool_or("mr_rule"), F.lit(False)).alias("any_mr"), F.count(F.lit(1)).alias("n"))


@BOUND(CHART + f"""
select r.event_id, r.user_id, r.ts, r.we1, r.we2, r.we4, r.we5, l.ts as context_at, l.event_id as context_id
from rules r asof left join (select * from events where event_type = 'error') l on r.user_id = l.user_id and r.ts >= l.ts where point_no > {BASE}""")
def entry_series_flags(spark, d):
    """The flagship: as-of context, limits, level, rules in one plan."""
    x = ruled(spark, d).where(F.col("point_no") > BASE).select("event_id", "user_id", "ts", "we1", "we2", "we4", "we5")
    y = A.asof_join(x, log(spark, d, "error"), ["user_id"], "ts", "log_ts", ["log_id"], tie="log_id", prefix="context_")
    return y.withColumnRenamed("context_log_id", "context_id")


@BOUND(CHART + "select event_id, user_id, point_no::integer as point_no, rule from alarms")
def alarm_dedup(spark, d):
    return C.new_alarms(ruled(spark, d), KEYS, FLAGS).select("event_id", "user_id", "point_no", "rule")


@BOUND(CHART + """
, ch as (select user_id, ts as change_at, event_id as change_log_id from events where event_type = 'purchase')
select a.event_id, a.rule, case when epoch(date_trunc('second', c.change_at)) - epoch(date_trunc('second', a.ts)) <= 86400 then c.change_log_id end as change_log_id,
    case when epoch(date_trunc('second', c.change_at)) - epoch(date_trunc('second', a.ts)) <= 86400 then 'changed' else 'none' end as disposition
from alarms a asof left join ch c on a.user_id = c.user_id and a.ts <= c.change_at""")
def alarm_disposition(spark, d):
    a = C.new_alarms(ruled(spark, d), KEYS, FLAGS)
    x = C.alarm_disposition(a, log(spark, d, "purchase"), KEYS, "ts", "log_ts", ["log_id"], within_s=86400, tie="log_id")
    return x.select("event_id", "rule", "change_log_id", "disposition")


@BOUND(CHART + ", s as (select k, sum((abs(v) > 3 * k)::int) as n_we1, count(*) as n from z, (select unnest([1.0, 1.2, 1.5]) as k) group by 1) select k::double as scale, n_we1::bigint as n_we1, round(n_we1 / n, 6) as share from s")
def rules_at_scale(spark, d):
    x = ruled(spark, d).withColumn("scale", F.explode(F.array(F.lit(1.0), F.lit(1.2), F.lit(1.5))))
    x = x.groupBy("scale").agg(F.count_if(F.abs(F.coalesce("z", F.lit(0.0))) > 3 * F.col("scale")).alias("n_we1"), F.count(F.lit(1)).alias("n"))
    return x.select("scale", "n_we1", r6(F.col("n_we1") / F.col("n"), "share"))


def with_resets(spark, d):
    x = A.asof_join(points(spark, d), log(spark, d, "error"), KEYS, "ts", "log_ts", ["log_id"], tie="log_id")
    return R.segments(R.resets(x, KEYS, ORDER, changed=("log_id",)), KEYS, ORDER)


SEG = """
with j as (select e.event_id, e.user_id, e.ts, e.value, l.event_id as log_id from events e asof left join (select * from events where event_type = 'error') l on e.user_id = l.user_id and e.ts >= l.ts),
r as (select *, row_number() over w as p, coalesce(log_id is distinct from lag(log_id) over w, false) and row_number() over w > 1 as reset from j window w as (partition by user_id order by ts, event_id)),
seg as (select *, sum(reset::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as segment from r)
"""


@BOUND(SEG + "select event_id, reset, segment::bigint as segment from seg")
def reset_segments(spark, d):
    return with_resets(spark, d).select("event_id", "reset", F.col("segment").cast("long").alias("segment"))


@BOUND(SEG.replace("with j", "with recursive j") + """
, s0 as (select user_id, avg(value) as start from seg where p <= 20 group by 1),
e as (select seg.user_id, p, 0.2 * value + 0.8 * start as ewma from seg join s0 using (user_id) where p = 1
    union all select s.user_id, s.p, case when s.reset then s.value else 0.2 * s.value + 0.8 * e.ewma end from e join seg s on s.user_id = e.user_id and s.p = e.p + 1),
lim as (select user_id, avg(ewma) as m, stddev_pop(ewma) as sd from e where p <= 20 group by 1)
select seg.event_id, round(e.ewma, 4) as ewma, abs(e.ewma - m) > 3.5 * case when sd = 0 then 1 else sd end as ewma_signal from e join seg using (user_id, p) join lim using (user_id)""")
def ewma_drift(spark, d):
    x = R.ewma(with_resets(spark, d), KEYS, ORDER, "value", baseline=20)
    return x.select("event_id", F.round("ewma", 4).alias("ewma"), "ewma_signal")


BLOCK = SEG.replace("with j", "with recursive j") + """
, b0 as (select *, p - 1 as pos, case when count(value) over f >= 3 then avg(value) over f end as bm, coalesce(bool_or(reset) over f, false) as rb from seg window f as (partition by user_id order by ts, event_id rows between 4 preceding and current row)),
ref as (select user_id, count(bm) as n, avg(bm) as m, stddev_pop(bm) as sd from b0 where pos % 5 = 0 and pos > 0 and pos < 40 group by 1),
b as (select user_id, event_id, rb as reset, row_number() over (partition by user_id order by pos) as k, case when n >= 4 then (bm - m) / case when sd = 0 then 1 else sd end end as z from b0 left join ref using (user_id) where pos % 5 = 4)
"""


def blocks(spark, d):
    x = R.block_z(with_resets(spark, d), KEYS, ORDER, "value", block=5, least=3, baseline=40)
    return x.select("user_id", "event_id", "reset", "z")


@BOUND(BLOCK + "select event_id, reset, round(z, 6) as z from b")
def block_means(spark, d):
    return blocks(spark, d).select("event_id", "reset", r6("z"))


@BOUND(BLOCK + """
, c as (select user_id, k, case when z is null then 0.0 else greatest(0, z - 0.375) end as s, case when z is null then false else greatest(0, z - 0.375) > 2 end as f from b where k = 1
    union all
    select b.user_id, b.k, case when b.z is null then x.s0 else greatest(0, x.s0 + b.z - 0.375) end, case when b.z is null then false else greatest(0, x.s0 + b.z - 0.375) > 2 end
    from (select c.user_id, c.k, case when b2.reset or c.f then 0.0 else c.s end as s0 from c join b b2 on b2.user_id = c.user_id and b2.k = c.k + 1) x join b on b.user_id = x.user_id and b.k = x.k + 1)
select b.event_id, round(c.s, 6) as cusum, c.f as cusum_signal from c join b using (user_id, k)""")
def block_cusum(spark, d):
    b = blocks(spark, d)
    x = R.cusum(b.join(_order(b), ["user_id", "event_id"]), KEYS, "k", h=2.0)
    return x.join(_order(b), ["user_id", "k"]).select("event_id", r6("cusum"), "cusum_signal")


def _order(b):
    """Blocks in the order of their last event; ids grow with time."""
    from pyspark.sql import Window

    return b.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("k"))


@BOUND("""
with n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, case when count(value) over f >= 10 then stddev_samp(value) over f end as sp from events window f as (partition by user_id order by ts, event_id rows between 19 preceding and current row)),
b as (select user_id, median(sp) as m from n where pos >= 10 and pos < 40 group by 1)
select event_id, round(case when sp > 0 and m > 0 then ln(sp / m) end, 6) as z from n join b using (user_id) where pos % 5 = 4""")
def variance_cusum_input(spark, d):
    return R.log_spread(points(spark, d), KEYS, ORDER, "value", size=20, least=10, first=10, last=40, every=5).select("event_id", r6("z"))


@BOUND(SEG.replace("with j", "with recursive j") + """
, g as (select *, value > 60 as signal, sum(reset::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as rs from seg),
st as (select user_id, p - 1 as position, rs, row_number() over (partition by user_id order by p) as k from (select *, coalesce(lag(signal) over (partition by user_id order by ts, event_id), false) as was from g) where signal and not was),
f as (select user_id, k, position as kept, rs as krs, true as keep, position from st where k = 1
    union all select s.user_id, s.k, case when s.position - f.kept >= 15 or s.rs > f.krs then s.position else f.kept end, case when s.position - f.kept >= 15 or s.rs > f.krs then s.rs else f.krs end, s.position - f.kept >= 15 or s.rs > f.krs, s.position
    from f join st s on s.user_id = f.user_id and s.k = f.k + 1)
select user_id, position::integer as position from f where keep""")
def rearm_signals(spark, d):
    x = with_resets(spark, d).drop("segment").withColumn("signal", F.col("value") > 60)
    return R.rearmed(x, KEYS, ORDER, "signal", rearm=15).select("user_id", "position")


@BOUND(SEG + """
, l as (select user_id, segment, ts, event_id, 'high' as detector from seg where value > 40 union all select user_id, segment, ts, event_id, 'low' from seg where value < 3)
select user_id, segment::bigint as segment, detector, event_id from (select *, row_number() over (partition by user_id, segment, detector order by ts, event_id) as n from l) where n = 1""")
def first_signal_per_segment(spark, d):
    x = with_resets(spark, d).withColumns({"high": F.col("value") > 40, "low": F.col("value") < 3})
    return R.first_signals(x, KEYS, ORDER, ["high", "low"]).select("user_id", F.col("segment").cast("long").alias("segment"), "detector", "event_id")


@BOUND("""
with n as (select *, row_number() over (partition by user_id order by ts, event_id) as no from events),
ev as (select event_id as change_id, user_id, no - 1 as passed from n where event_type = 'signup'),
near as (select change_id, value, case when no <= passed then 'b' else 'a' end as side from ev join n using (user_id) where no > passed - 10 and no <= passed + 10),
g as (select change_id, count(*) filter (where side = 'b') as n_before, count(*) filter (where side = 'a') as n_after, avg(value) filter (where side = 'b') as mb, avg(value) filter (where side = 'a') as ma, stddev_samp(value) as sd from near group by 1)
select change_id, n_before, n_after, round(ma - mb, 6) as step, round((ma - mb) / nullif(sd * sqrt(8.0 * (1 / n_before + 1 / n_after)), 0), 6) as t from g where n_before >= 5 and n_after >= 5""")
def step_test(spark, d):
    ev = points(spark, d).where("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("change_id"))
    near = W.nearest_rows(points(spark, d), ev, KEYS, "ts", "event_id", "at", "change_id", 10)
    return R.step_test(near, ["change_id"], "value", least=5).select("change_id", "n_before", "n_after", r6("step"), r6("t"))


@BOUND("select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between current row and 9 following) - avg(value) over (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding), 6) as step from events")
def local_steps(spark, d):
    return R.local_steps(points(spark, d), KEYS, ORDER, "value", 10).select("event_id", r6("step"))


@BOUND("select event_id, coalesce(sum((value > 30)::int) over (partition by user_id order by ts, event_id rows between 9 preceding and current row) >= 2, false) as persistent from events")
def k_of_n(spark, d):
    return W.k_of_n(points(spark, d).withColumn("flag", F.col("value") > 30), KEYS, ORDER, "flag").select("event_id", "persistent")


@BOUND("select event_id, value > 30 and not coalesce(lag(value > 30) over (partition by user_id order by ts, event_id), false) as rising from events")
def rising_edges(spark, d):
    return W.rising(points(spark, d).withColumn("flag", F.col("value") > 30), KEYS, ORDER, "flag").select("event_id", "rising")


EPISODES = """
with n as (select *, row_number() over (partition by user_id order by ts, event_id) as position from events),
h as (select *, coalesce(position - lag(position) over (partition by user_id order by position) >= 5, true) as starts from n where value > 30)
"""


@BOUND(EPISODES + "select event_id, position::integer as position, starts, sum(starts::int) over (partition by user_id order by position rows unbounded preceding)::bigint as episode from h")
def episode_numbers(spark, d):
    return W.episodes(points(spark, d).withColumn("flag", F.col("value") > 30), KEYS, ORDER, "flag", gap=5).select("event_id", "position", "starts", "episode")


@BOUND("select event_id, round(value - case when count(value) over f >= 5 then avg(value) over f end, 6) as value_change from events window f as (partition by user_id order by ts, event_id rows between 15 preceding and 1 preceding)")
def trailing_change(spark, d):
    return W.trailing_change(points(spark, d), KEYS, ORDER, ["value"], before=15, least=5).select("event_id", r6("value_change"))


@BOUND("""
with a as (select *, value / 20 - 1 as z from events),
b as (select *, case when count(z) over f >= 5 then sqrt(avg(z * z) over f) end as rr from a window f as (partition by user_id order by ts, event_id rows between 9 preceding and current row))
select event_id, round(rr, 6) as rolling_rms, sum(coalesce(rr > 1, false)::int) over g = 6 and count(*) over g = 6 as triggered from b window g as (partition by user_id order by ts, event_id rows between 5 preceding and current row)""")
def rolling_rmse_trigger(spark, d):
    x = points(spark, d).withColumn("z", F.col("value") / 20 - 1)
    return W.rolling_rms_trigger(x, KEYS, ORDER, "z", 1.0, size=10, least=5, hold=6).select("event_id", r6("rolling_rms"), "triggered")
