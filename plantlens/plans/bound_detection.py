"""Detection measured against chance: documents with labels, events by hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import windows as W
from .bound_mechanisms import poisson_sql
from .binding import Bound, points, r6, table
from .bound_series import EPISODES

BOUND = Bound()
SET = "e as (select doc_id, source, toxic = 1 as bad, n_chars > 3000 as long_text, n_chars % 7 = 0 as odd, n_chars / 20000.0 as score from documents join labels using (doc_id))"


def labelled(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    n = F.col("n_chars")
    return x.select("doc_id", "source", (F.col("toxic") == 1).alias("bad"), (n > 3000).alias("long_text"), (n % 7 == 0).alias("odd"), (n / 20000.0).alias("score"))


@BOUND(f"with {SET} select source, round(sum((long_text and bad)::int) / greatest(sum(bad::int), 1), 6) as rate_bad, round(sum((long_text and not bad)::int) / greatest(sum((not bad)::int), 1), 6) as rate_good, round(sum((long_text and bad)::int) / greatest(sum(bad::int), 1) - sum((long_text and not bad)::int) / greatest(sum((not bad)::int), 1), 6) as above_chance from e group by 1")
def detection_above_chance(spark, d):
    return E.rates(labelled(spark, d), ["source"], "long_text", "bad").select("source", r6("rate_bad"), r6("rate_good"), r6("above_chance"))


@BOUND(f"""with {SET}, c as (select source, count(*) filter (where long_text and bad) as fb, count(*) filter (where bad) as nb, count(*) filter (where long_text and not bad) as fg, count(*) filter (where not bad) as ng from e group by 1),
d as (select *, {poisson_sql('source', 'replicate')} as w from (select *, unnest(range(1, 401)) as replicate from c)),
r as (select replicate, sum(w * fb) / greatest(sum(w * nb), 1) as rate_bad, sum(w * fg) / greatest(sum(w * ng), 1) as rate_good from d group by 1)
select {", ".join(f"round(quantile_cont({e}, {q}), 6) as {c}_{end}" for c, e in (("rate_bad", "rate_bad"), ("rate_good", "rate_good"), ("above_chance", "rate_bad - rate_good")) for q, end in ((0.025, "low"), (0.975, "high")))} from r""")
def detection_interval(spark, d):
    """The intervals of all three rates, over resampled sources."""
    x = E.bootstrap_interval(labelled(spark, d), "source", "long_text", "bad")
    return x.select(*[r6(f"{c}_{end}") for c in E.RATES for end in ("low", "high")])


@BOUND(f"with {SET} select doc_id, long_text as long_text_only, odd and not long_text as odd_only from e")
def incremental_detection(spark, d):
    return E.incremental(labelled(spark, d), ["long_text", "odd"]).select("doc_id", "long_text_only", "odd_only")


@BOUND("""
with d as (select event_id, user_id, floor(epoch(ts) / 3600)::bigint as hour from events where event_type = 'error'),
a as (select distinct user_id, floor(epoch(ts) / 3600)::bigint as hour, case event_type when 'view' then 'template' when 'click' then 'rules' else 'drift' end as layer from events where event_type in ('view', 'click', 'purchase')),
m as (select d.event_id, a.layer, d.hour - a.hour as back, case a.layer when 'template' then 0 when 'rules' then 1 else 2 end as rank from d join a on d.user_id = a.user_id and a.hour between d.hour - case a.layer when 'drift' then 24 else 8 end and d.hour),
b as (select *, row_number() over (partition by event_id order by back desc, rank) as k from m)
select d.event_id, b.layer as credited, b.back::integer as hours_back from d left join b on d.event_id = b.event_id and k = 1""")
def lookback_credit(spark, d):
    x = points(spark, d).withColumn("hour", F.floor(S.epoch(F.col("ts")) / 3600))
    defects = x.where("event_type = 'error'").select("event_id", "user_id", "hour")
    layer = F.when(F.col("event_type") == "view", "template").when(F.col("event_type") == "click", "rules").otherwise("drift")
    alarms = x.where(F.col("event_type").isin("view", "click", "purchase")).select("user_id", "hour", layer.alias("layer"))
    return E.lookback_credit(defects, alarms, "user_id", "hour", {"template": 8, "rules": 8, "drift": 24}).select("event_id", "credited", "hours_back")


@BOUND(f"with {SET}, t as (select * from e order by score desc, doc_id limit (select greatest(1, round(count(*) * 0.1))::bigint from e)) select (select sum(bad::int) from e)::bigint as positives, sum(bad::int)::bigint as captured, count(*) as k, round(sum(bad::int) / nullif((select sum(bad::int) from e), 0), 6) as recall from t")
def recall_at_rate(spark, d):
    return E.recall_at_rate(labelled(spark, d), "score", "bad", "doc_id", 0.1).select("positives", "captured", "k", r6("recall"))


@BOUND(f"with {SET}, s as (select score, sum(bad::int) as y, count(*) as n from e group by 1), c as (select y, sum(y) over (order by score desc) as cy, sum(n) over (order by score desc) as cn from s) select round(sum(y * cy / cn) / nullif(sum(y), 0), 6) as average_precision from c")
def average_precision(spark, d):
    return E.average_precision(labelled(spark, d), "score", "bad").select(r6("average_precision"))


@BOUND(f"""
with {SET}, g as (select source, sum(bad::int) as h, count(*) as n, sum(bad::int) / count(*) as p from e group by 1)
select source, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) as low, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) as high from g""")
def wilson_interval(spark, d):
    g = labelled(spark, d).groupBy("source").agg(F.count_if("bad").alias("h"), F.count(F.lit(1)).alias("n"))
    lo, hi = S.wilson(F.col("h"), F.col("n"))
    return g.select("source", r6(lo, "low"), r6(hi, "high"))


@BOUND(EPISODES + """
select round(avg((value > 30)::int), 6) as flagged_share, round(count(distinct date_trunc('hour', ts)) / 8, 6) as shifts, (select sum(starts::int) from h)::bigint as episodes, round((select sum(starts::int) from h) / (count(distinct date_trunc('hour', ts)) / 8), 6) as per_shift from events""")
def alarm_budget(spark, d):
    p = points(spark, d).withColumn("flag", F.col("value") > 30)
    e = W.episodes(p, ["user_id"], ["ts", "event_id"], "flag", gap=5)
    x = E.alarm_budget(e, p.withColumn("f", F.col("flag").cast("int")), S.truncated("hour", F.col("ts")), "f")
    return x.select(r6("flagged_share"), r6("shifts"), "episodes", r6("per_shift"))


@BOUND("""
with w as (select list_reverse_sort(list(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row)) as l from events)
select round(quantile_cont(l[2], 0.997), 6) as threshold, count(l[2]) as n from w""")
def second_largest_threshold(spark, d):
    return E.order_statistic_threshold(points(spark, d), ["user_id"], ["ts", "event_id"], "value", 0.003).select(r6("threshold"), "n")
