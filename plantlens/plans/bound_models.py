"""Learned scores over events, embeddings and lineitem; what a model predicts has no SQL, its measures do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as M
from ..operators import curves as V
from ..operators import metrology as Y
from ..operators import windows as W
from ..operators.quantiles import grouped_quantiles
from ..sources.tables import materialised
from .binding import Bound, points, r6, table

BOUND = Bound()


@BOUND()
def isolation_forest_score(spark, d):
    x = W.trailing_change(points(spark, d), ["user_id"], ["ts", "event_id"], ["value"], before=15, least=5)
    forest = M.fit_forest(x, "event_type", "event_id", ["value", "value_change"])
    return M.score_forest(x, forest, "event_type", ["value", "value_change"]).select("event_id", "event_type", "anomaly")


@BOUND()
def pca_reconstruction(spark, d):
    x = M.reconstruction_error(table(spark, d, "embeddings"), "embedding", 8)
    limit = grouped_quantiles(x, [], "error", {"limit": 0.997}).select("limit")
    return x.crossJoin(F.broadcast(limit)).select("vec_id", "error", (F.col("error") > F.col("limit")).alias("flagged"))  # one row


def split(spark, d):
    x = table(spark, d, "lineitem").where("l_quantity > 0")
    return x.withColumn("split", Y.split_label(F.col("l_shipdate"), "1996-01-01", "1997-01-01")).withColumn("target", Y.relative_target(F.col("l_extendedprice"), F.lit(1000.0) * F.col("l_quantity")))


@BOUND()
def gbt_virtual_metrology(spark, d):
    x = Y.boosted(split(spark, d), ["l_quantity", "l_discount", "l_tax"], "target", "split", rounds=5, depth=3)
    return x.select("l_orderkey", "l_linenumber", "split", "target", "predicted")


@BOUND()
def defect_classifier(spark, d):
    x = split(spark, d).withColumn("bad", F.col("l_returnflag") == "R")
    x = Y.classified(x, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], "bad", "split", rounds=5, depth=3)
    return x.select("l_orderkey", "l_linenumber", "split", "bad", "score")


@BOUND("""
with x as (select user_id, ts, event_id, value as y, coalesce(avg(value) over (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding), 20) as p from events),
e as (select *, y - p as e, lag(y - p) over (partition by user_id order by ts, event_id) as b from x)
select user_id, count(e) as n, round(sqrt(avg(e * e)), 6) as rmse, round(sqrt(avg(e * e)) / 2.5, 6) as rmse_over_gauge, round(1 - sum(e * e) / nullif(var_pop(y) * count(e), 0), 6) as r2, round(covar_pop(y, p) / nullif(var_pop(p), 0), 6) as slope,
    round(covar_samp(case when b is not null then e end, b) / nullif(stddev_samp(case when b is not null then e end) * stddev_samp(b), 0), 6) as lag1 from e group by 1""")
def vm_metrics(spark, d):
    w = W.series(["user_id"], ["ts", "event_id"])
    x = points(spark, d).withColumn("p", F.coalesce(W.trailing_mean(F.col("value"), w, 10, 1), F.lit(20.0)))
    y = Y.error_measures(x, ["user_id"], ["ts", "event_id"], "value", "p", F.lit(2.5))
    return y.select("user_id", "n", *[r6(c) for c in ("rmse", "rmse_over_gauge", "r2", "slope", "lag1")])


@BOUND("select l_orderkey, l_linenumber, l_partkey, u::integer as unit, round(l_extendedprice / l_linenumber, 4) as share from (select *, unnest(range(1, l_linenumber + 1)) as u from lineitem)")
def per_unit_rows(spark, d):
    x = Y.per_unit(table(spark, d, "lineitem"), F.col("l_linenumber"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "unit", F.round(F.col("l_extendedprice") / F.col("l_linenumber"), 4).alias("share"))


@BOUND()
def rolling_forest(spark, d):
    """Forests refitted by type and week on the quiet rows of the weeks before, their thresholds and alarms."""
    x = W.trailing_change(points(spark, d), ["user_id"], ["ts", "event_id"], ["value"], before=15, least=5).withColumn("week_ts", F.date_trunc("week", F.col("ts")).cast("timestamp_ntz"))
    first = str(x.agg(F.min("week_ts") + F.make_dt_interval(days=F.lit(7))).first()[0])
    y = Y.rolling_forest(x, "event_type", "week_ts", first, "event_id", ["value", "value_change"], F.col("value") < 100, ["user_id"], ["ts", "event_id"], rate=0.01, least=100)
    return y.select("event_id", "event_type", "week_ts", "n_fit", "anomaly", "threshold", "alarm")


@BOUND()
def rolling_boosting(spark, d):
    """Boosting refitted by year on the years before the last, which stops it."""
    x = split(spark, d).withColumn("year_ts", F.date_trunc("year", F.col("l_shipdate")).cast("timestamp_ntz"))
    f = ["l_quantity", "l_discount", "l_tax"]
    sums = materialised(Y.alike(x, f, "target", ["year_ts"]), "sums")  # rows are read once for all origins
    y = Y.rolling_origin(x, "year_ts", "1996-01-01", lambda train, valid: Y.boosted_model(train, valid, f, "target", rounds=5, depth=3, summed=True), held_out=True, learn=sums)
    return y.select("l_orderkey", "l_linenumber", "year_ts", "target", "predicted")


@BOUND()
def curve_reconstruction(spark, d):
    """Vectors as curves of jobs (label) and cells (its parity): resampled, the held level off, scaled to the job, errors by cell."""
    c = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("t", "v"))
    x = V.resampled(c, ["vec_id"], "t", "v", bins=24, tail=4, scale_by=["label"])
    x = x.groupBy("vec_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", F.coalesce("level", F.lit(0.0)).alias("level")))), lambda r: r["level"]).alias("curve"))
    x = x.withColumn("cell", F.col("label") % 2)
    return M.curve_errors(x, "cell", "curve", F.col("vec_id") % 3 != 0, k=8, rate=0.01, least=50).select("vec_id", "cell", "error", "threshold", "flagged")
