"""Mechanism tests and report tables over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import mechanisms as M
from ..operators import windows as W
from .binding import Bound, log, points, r6, table

BOUND = Bound()
KEYS, ORDER = ["user_id"], ["ts", "event_id"]
NUM = "n as (select *, row_number() over (partition by user_id order by ts, event_id) as no from events)"


RISES = f"""{NUM}, s as (select user_id, no - 1 as pos, case when count(*) over w = 10 then sum((value > 40)::int) over w end as sm from n window w as (partition by user_id order by no rows between 9 preceding and current row)),
b as (select user_id, coalesce(avg(sm) filter (where pos < 30), 0) as base from s group by 1),
r as (select user_id, min(pos) filter (where sm > greatest(2, 1.2 * base)) as exceeds_at, count(*) as n from s join b using (user_id) group by 1),
f as (select user_id, min(no - 1) as fires_at from n where value > 100 group by 1),
leads as (select user_id, exceeds_at, fires_at, n, coalesce(fires_at < exceeds_at, false) as ahead, case when fires_at < exceeds_at then exceeds_at - fires_at end as lead from r left join f using (user_id))"""


def leads_of(spark, d):
    p = W.numbered(points(spark, d), KEYS, ORDER).withColumn("hot", F.col("value") > 40)
    rises = M.first_exceedance(p, KEYS, ORDER, "hot", 10, 2, 1.2, 30)
    fires = p.where("value > 100").groupBy("user_id").agg(F.min(F.col("point_no") - 1).alias("fires_at"))
    return M.lead(fires, rises, KEYS)


@BOUND(f"with {RISES} select user_id, exceeds_at::integer as exceeds_at, fires_at::integer as fires_at, lead::integer as lead, ahead from leads")
def vent_lead(spark, d):
    return leads_of(spark, d).select("user_id", "exceeds_at", "fires_at", "lead", "ahead")


def uniform_sql(seed: int, *parts: str) -> str:
    named = " || ':' || ".join([f"'{seed}'", *(f"coalesce({p}::varchar, '')" for p in parts)])
    return f"(('0x' || substr(md5({named}), 1, 8))::bigint / 4294967296.0::double)"


def poisson_sql(unit: str, replicate: str, seed: int = 7) -> str:
    return "list_sum(list_transform([" + ", ".join(repr(c) for c in E.POISSON) + f"], lambda c: ({uniform_sql(seed, unit, replicate)} >= c)::int))::bigint"


@BOUND(f"""with {RISES}, x as (select user_id, fires_at, draw, 10 + (n - 10) * {uniform_sql(7, 'user_id', 'draw')} as rise from (select *, unnest(range(1, 201)) as draw from leads where exceeds_at is not null)),
one as (select draw, avg(coalesce(fires_at < rise, false)::int) as share, median(rise - fires_at) filter (where fires_at < rise) as lead from x group by 1)
select round(avg(share), 6) as chance, round(quantile_cont(share, 0.025), 6) as chance_low, round(quantile_cont(share, 0.975), 6) as chance_high, round(median(lead), 6) as chance_lead from one""")
def vent_lead_by_chance(spark, d):
    x = M.chance_of_lead(leads_of(spark, d), KEYS, first=10, draws=200)
    return x.select(*[r6(c) for c in ("chance", "chance_low", "chance_high", "chance_lead")])


@BOUND(f"""with {RISES}, own as (select * from leads where lead is not null), drawn as (select *, {poisson_sql('user_id', 'replicate')} as w from (select user_id, lead, unnest(range(1, 201)) as replicate from own)),
m as (select replicate, median(lead) as m from (select replicate, lead, unnest(range(w)) from drawn) group by 1),
c as (select count(*) as intervals, count(exceeds_at) as with_rise, count(fires_at) as with_firing, count(*) filter (where ahead) as n_ahead, count(*) filter (where lead between 2 and 6) as n_within from leads), p as (select *, n_ahead / nullif(with_rise, 0) as share from c)
select intervals, with_rise, with_firing, n_ahead, n_within, round(share, 6) as share_ahead, round((share + 1.96 * 1.96 / (2 * with_rise)) / (1 + 1.96 * 1.96 / with_rise) - 1.96 * sqrt(share * (1 - share) / with_rise + 1.96 * 1.96 / (4 * with_rise * with_rise)) / (1 + 1.96 * 1.96 / with_rise), 6) as share_low,
    round((share + 1.96 * 1.96 / (2 * with_rise)) / (1 + 1.96 * 1.96 / with_rise) + 1.96 * sqrt(share * (1 - share) / with_rise + 1.96 * 1.96 / (4 * with_rise * with_rise)) / (1 + 1.96 * 1.96 / with_rise), 6) as share_high,
    (select round(median(lead), 6) from own) as lead, (select round(quantile_cont(m, 0.025), 6) from m) as lead_low, (select round(quantile_cont(m, 0.975), 6) from m) as lead_high from p""")
def vent_summary(spark, d):
    """How often the detector is ahead of the rise, and by how much, with intervals."""
    x = M.lead_summary(leads_of(spark, d), KEYS, (2, 6), replicates=200)
    return x.select("intervals", "with_rise", "with_firing", "n_ahead", "n_within", *[r6(c) for c in ("share_ahead", "share_low", "share_high", "lead", "lead_low", "lead_high")])


@BOUND(f"""
with {NUM}, worn as (select user_id, date_trunc('week', ts) as run, count(*) as k, avg(value) as mean_worn from n where no > 40 group by 1, 2),
u as (select w.user_id, run, avg(value) as mean_unworn, count(*) as n_unworn from worn w join n on n.user_id = w.user_id and no <= 40 and no - 1 < k group by 1, 2)
select user_id, run, k, round(mean_worn, 6) as mean_worn, round(mean_unworn, 6) as mean_unworn, n_unworn from worn left join u using (user_id, run)""")
def ring_windows(spark, d):
    p = W.numbered(points(spark, d), KEYS, ORDER)
    worn = p.where("point_no > 40").groupBy("user_id", S.truncated("week", F.col("ts")).alias("run")).agg(F.count(F.lit(1)).alias("k"), F.avg("value").alias("mean_worn"))
    unworn = p.where("point_no <= 40").select("user_id", (F.col("point_no") - 1).alias("position"), "value")
    return M.matched_windows(worn, unworn, KEYS, "value", "k").select("user_id", "run", "k", r6("mean_worn"), r6("mean_unworn"), "n_unworn")


@BOUND(f"""
with {NUM}, ev as (select event_id as eid, user_id, event_type as kind, no - 1 as passed from n where event_type in ('signup', 'error')),
near as (select eid, kind, value, no <= passed as b from ev join n using (user_id) where no > passed - 8 and no <= passed + 8),
g as (select eid, kind, avg(value) filter (where b) as m0, avg(value) filter (where not b) as m1, stddev_samp(value) filter (where b) as s0, count(*) filter (where b) as n0, count(*) filter (where not b) as n1 from near group by 1, 2)
select kind, round(median(abs(m1 - m0) / nullif(s0, 0)), 6) as shift, count(*) as n_events from g where n0 >= 5 and n1 >= 5 group by 1""")
def shift_after_events(spark, d):
    ev = log(spark, d, "signup", "error").select("user_id", "log_ts", F.col("log_id").alias("eid"))
    near = W.nearest_rows(points(spark, d), ev, KEYS, "ts", "event_id", "log_ts", "eid", 8)
    kinds = log(spark, d, "signup", "error").select(F.col("log_id").alias("eid"), "kind")
    x = M.shift_after_events(near.join(kinds, "eid"), ["eid"], "kind", "value", least=5)
    return x.select("kind", r6("shift"), "n_events")


@BOUND("""
with e as (select event_id, user_id, ts, value from events where value > 60), c as (select user_id, ts as cts from events where event_type = 'purchase')
select event_id, case when c.cts is not null and epoch(date_trunc('second', e.ts)) - epoch(date_trunc('second', c.cts)) <= 86400 then 'step' when value > 90 then 'variability' else 'drift' end as kind
from e asof left join c on e.user_id = c.user_id and e.ts >= c.cts""")
def episode_kinds(spark, d):
    e = points(spark, d).where("value > 60")
    x = M.classified_episodes(e, log(spark, d, "purchase"), KEYS, "ts", "log_ts", 86400, F.col("value") > 90)
    return x.select("event_id", "kind")


@BOUND("""
with s as (select user_id, ts as sts from events where value > 60), c as (select event_id, user_id, ts as cts from events where event_type = 'purchase')
select c.event_id as log_id from c asof left join s on c.user_id = s.user_id and c.cts <= s.sts where s.sts is null or epoch(date_trunc('second', s.sts)) - epoch(date_trunc('second', c.cts)) > 43200""")
def undetected_changes(spark, d):
    s = points(spark, d).where("value > 60").select("user_id", "ts")
    return M.undetected_changes(log(spark, d, "purchase"), s, KEYS, "log_ts", "ts", 43200).select("log_id")


@BOUND(f"""
with {NUM}, s as (select * from n where value > 40), v as (select user_id, ts as vts, no as vno from n where event_type = 'signup'),
j as (select s.user_id, s.event_id, s.ts, s.no, v.vts, v.vno from s asof left join v on s.user_id = v.user_id and s.ts <= v.vts),
k as (select *, row_number() over (partition by user_id, vts order by ts, no) as r from j)
select event_id, (vno - no)::integer as rows_until, round((epoch_us(vts) - epoch_us(ts)) / 86400e6, 6) as days_until from k where r = 1""")
def maintenance_requests(spark, d):
    p = W.numbered(points(spark, d), KEYS, ORDER)
    v = p.where("event_type = 'signup'").select("user_id", F.col("ts").alias("vts"), F.col("point_no").alias("vno"))
    x = M.requests(p.where("value > 40"), v, KEYS, "ts", "vts", "point_no", "vno")
    return x.select("event_id", "rows_until", r6("days_until"))


@BOUND("""
with s as (select event_id, user_id, ts from events where value > 40), c as (select user_id, ts as cts, event_id as cid from events where event_type = 'purchase'),
b as (select s.*, case when epoch(date_trunc('second', s.ts)) - epoch(date_trunc('second', c.cts)) <= 36000 then c.cid end as before_log_id from s asof left join c on s.user_id = c.user_id and s.ts >= c.cts)
select b.event_id, b.before_log_id, case when epoch(date_trunc('second', c.cts)) - epoch(date_trunc('second', b.ts)) <= 72000 then c.cid end as next_log_id from b asof left join c on b.user_id = c.user_id and b.ts <= c.cts""")
def reaction_log(spark, d):
    x = M.changes_around(points(spark, d).where("value > 40"), log(spark, d, "purchase"), KEYS, "ts", "log_ts", 36000, 72000, ["log_id"], "log_id")
    return x.select("event_id", "before_log_id", "next_log_id")


NOVEL = """e as (select event_id as novel_id, user_id, ts - interval 12 hour as start_ts, ts + interval 12 hour as end_ts from events where event_type = 'signup'),
j as (select e.*, x.ts, x.value > 40 as hot, x.event_type = 'error' as err from e join events x on e.user_id = x.user_id and x.ts between start_ts and end_ts),
g as (select novel_id, user_id, min(ts) as started_at, count(ts) as n_rows, min(ts) filter (where hot) as first_hot, min(ts) filter (where err) as first_err, avg(hot::int) as hot_rate, avg(err::int) as err_rate from j group by 1, 2),
logs as (select user_id, ts as entry, case event_type when 'purchase' then 'change' when 'click' then 'tally' end as kind from events where event_type = 'purchase' or event_type = 'click' and value < 8),
r as (select g.*, l.entry as response_at, l.kind as response_kind, (epoch_us(first_hot) - epoch_us(started_at)) / 60e6 as minutes_to_hot, (epoch_us(first_err) - epoch_us(started_at)) / 60e6 as minutes_to_err, (epoch_us(l.entry) - epoch_us(first_hot)) / 60e6 as lead from g asof left join logs l on g.user_id = l.user_id and g.started_at <= l.entry)"""


def novel(spark, d):
    half = F.make_dt_interval(hours=F.lit(12))
    e = log(spark, d, "signup").select(F.col("log_id").alias("novel_id"), "user_id", (F.col("log_ts") - half).alias("start_ts"), (F.col("log_ts") + half).alias("end_ts"))
    p = points(spark, d)
    rows = p.withColumns({"hot": F.col("value") > 40, "err": F.col("event_type") == "error"})
    logs = {"change": (p.where("event_type = 'purchase'"), "ts"), "tally": (p.where("event_type = 'click' and value < 8"), "ts")}
    return M.detected_events(e, rows, logs, KEYS, "ts", "hot", "err")


@BOUND(f"with {NOVEL} select novel_id, started_at, n_rows, first_hot, first_err, round(hot_rate, 6) as hot_rate, round(err_rate, 6) as err_rate, round(minutes_to_hot, 6) as minutes_to_hot, round(minutes_to_err, 6) as minutes_to_err, response_at, response_kind, first_hot is not null as detected, round(lead, 6) as lead_over_response from r")
def novel_events(spark, d):
    x = novel(spark, d)
    return x.select("novel_id", "started_at", "n_rows", "first_hot", "first_err", *[r6(c) for c in ("hot_rate", "err_rate", "minutes_to_hot", "minutes_to_err")], "response_at", "response_kind", "detected", r6("lead_over_response"))


@BOUND(f"with {NOVEL} select count(*) as events, count(first_hot) as detected, round(median(minutes_to_hot), 6) as minutes_to_flag, round(median(lead), 6) as lead_over_response from r")
def novel_summary(spark, d):
    x = M.detection_summary(novel(spark, d), "hot")
    return x.select("events", "detected", r6("minutes_to_flag"), r6("lead_over_response"))


@BOUND("select event_type, date_trunc('week', ts)::timestamp as month_ts, count(*) as n, round(avg((value > 40)::int), 6) as flag_rate, round(avg(case when value < 80 then (value > 40)::int end), 6) as false_rate from events group by 1, 2")
def flag_rate_by_period(spark, d):
    p = points(spark, d).withColumn("flag", F.col("value") > 40)
    x = M.flagged_by_month(p, ["event_type"], S.truncated("week", F.col("ts")), "flag", F.col("value") < 80)
    return x.select("event_type", "month_ts", "n", r6("flag_rate"), r6("false_rate"))


@BOUND("select count(*) filter (where value > 30 and value % 1 < 0.5) as both, round(count(*) filter (where value > 30 and value % 1 < 0.5) / nullif(count(*) filter (where value > 30), 0), 6) as share_of_hot, round(count(*) filter (where value > 30 and value % 1 < 0.5) / nullif(count(*) filter (where value % 1 < 0.5), 0), 6) as share_of_low from events")
def flag_overlap(spark, d):
    p = points(spark, d).withColumns({"hot": F.col("value") > 30, "low": F.col("value") % 1 < 0.5})
    return M.overlap(p, "hot", "low").select("both", r6("share_of_hot"), r6("share_of_low"))


@BOUND("select event_id, round(value - case when count(value) over f >= 5 then median(value) over f end, 6) as residual from events window f as (partition by user_id order by ts, event_id rows between 7 preceding and 7 following)")
def centred_median_residual(spark, d):
    return M.centred_median(points(spark, d), KEYS, ORDER, "value", 15, 5).select("event_id", r6("residual"))


@BOUND(f"with recursive {NUM}, e as (select user_id, event_id, no, value as t from n where no = 1 union all select n.user_id, n.event_id, n.no, 0.2 * n.value + 0.8 * e.t from e join n on n.user_id = e.user_id and n.no = e.no + 1) select event_id, round(t, 5) as trend from e")
def smoothed_trend(spark, d):
    return M.smoothed(points(spark, d), KEYS, ORDER, "value").select("event_id", F.round("trend", 5).alias("trend"))


@BOUND(f"""
with {NUM}, m as (select user_id, median(value) as t from events group by 1), o as (select * from n join m using (user_id) where no between 10 and 40),
k as (select *, row_number() over (partition by user_id order by abs(value - t), event_id) as r from o)
select user_id, min(event_id) filter (where r = 1) as reference, round(median(value), 6) as era_median, count(*) as n from k group by 1""")
def reference_row(spark, d):
    p = W.numbered(points(spark, d), KEYS, ORDER)
    m = p.groupBy("user_id").agg(F.median("value").alias("t"))
    return M.reference_row(p.join(m, "user_id"), KEYS, "point_no", "value", "t", "event_id", 10, 40).select("user_id", "reference", r6("era_median"), "n")


@BOUND(f"with {NUM} select user_id, floor((no - 1) / 10)::bigint as bin, count(*) filter (where value > 40) as n_flags, count(*) as n from n group by 1, 2")
def run_timeline(spark, d):
    p = W.numbered(points(spark, d), KEYS, ORDER).withColumn("flag", F.col("value") > 40)
    return M.timeline(p, KEYS, "point_no", "flag", 10)


@BOUND("with g as (select user_id, stddev_samp(value) filter (where ts < timestamp '2024-01-15') as s0, stddev_samp(value) filter (where ts >= timestamp '2024-01-15') as s1, avg(value) filter (where ts < timestamp '2024-01-15') as m0, avg(value) filter (where ts >= timestamp '2024-01-15') as m1 from events group by 1) select user_id, round(s1 / nullif(s0, 0), 6) as spread_ratio, round((m1 - m0) / nullif(s0, 0), 6) as mean_shift from g")
def before_after(spark, d):
    x = M.before_after_ratio(points(spark, d), KEYS, F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), "value")
    return x.select("user_id", r6("spread_ratio"), r6("mean_shift"))


@BOUND("with x as (select l_returnflag, l_quantity - avg(l_quantity) over w as a, l_extendedprice - avg(l_extendedprice) over w as b from lineitem window w as (partition by l_returnflag, l_suppkey)) select l_returnflag, round(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 6) as r, count(*) as n from x group by 1")
def demeaned_correlation(spark, d):
    return M.demeaned_correlation(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity", "l_extendedprice").select("l_returnflag", r6("r"), "n")


@BOUND("select l_linestatus, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, count(*) as n from (select l_linestatus, l_orderkey % 5 as seed, avg(l_quantity) as m from lineitem group by 1, 2) group by 1")
def seed_average(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_linestatus", (F.col("l_orderkey") % 5).alias("seed")).agg(F.avg("l_quantity").alias("m"))
    return M.seed_average(m, ["l_linestatus"], "m").select("l_linestatus", r6("mean"), r6("sd"), "n")


@BOUND("""select p_brand, coalesce(sum(l_quantity) filter (where l_returnflag = 'A'), 0)::double as "A", coalesce(sum(l_quantity) filter (where l_returnflag = 'N'), 0)::double as "N", coalesce(sum(l_quantity) filter (where l_returnflag = 'R'), 0)::double as "R", coalesce(sum(l_quantity) filter (where l_returnflag in ('A', 'N', 'R')), 0)::double as total from lineitem join part on l_partkey = p_partkey group by 1""")
def pivot_with_total(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.with_total_row(x, "p_brand", "l_returnflag", ["A", "N", "R"], F.col("l_quantity"))


@BOUND("select event_id, round(avg((value > 40)::int) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as running_share from events")
def running_share(spark, d):
    p = points(spark, d).withColumn("flag", F.col("value") > 40)
    return M.running_share(p, KEYS, ORDER, "flag").select("event_id", r6("running_share"))
