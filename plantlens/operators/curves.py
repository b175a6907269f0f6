"""Curves as long tables (keys, time, value): features and resampling, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def curve_features(df: DataFrame, keys: list[str], t: str, value: str, transfer: Column, arrival: float, seal_share: float = 0.95, dt: float = 1.0) -> DataFrame:
    """One row per curve: arrival, peak and its time, integrals before and after transfer, when the value falls under a share of the plateau, slope after it."""
    v, at = F.col(value), F.col(t)
    first = df.groupBy(*keys).agg(F.min(F.when(v >= arrival, at)).alias("arrival"), F.max(v).alias("peak"), F.max_by(t, F.struct(v, -at)).alias("peak_at"), F.sum(F.when(at < transfer, v * dt)).alias("fill_integral"), F.sum(F.when(at >= transfer, v * dt)).alias("pack_integral"), F.sum(v * dt).alias("cycle_integral"), F.avg(F.when(at >= transfer, v)).alias("plateau"))
    late = df.join(first, keys).where(at > F.col("peak_at"))
    second = late.groupBy(*keys).agg(F.min(F.when(v < seal_share * F.col("plateau"), at)).alias("seal_at"), F.regr_slope(v, at).alias("cooling_slope"))
    return first.join(second, keys, "left")


def resampled(df: DataFrame, keys: list[str], t: str, value: str, bins: int = 120, margin: float = 10, tail: int = 12, scale_by: list[str] | None = None) -> DataFrame:
    """Curves on `bins` bins of their own length: bin means carried forward, the median of the last `tail` bins taken off, scaled.

    What is taken off is the sensor's reading once the part has released. The scale is the median of the peaks of the
    curves that share `scale_by` (a job), which df has beside the keys; the curve's own peak if None.
    """
    last = df.groupBy(*keys).agg(F.max(t).alias("_last"), *[F.min(c).alias(c) for c in scale_by or []])
    placed = df.join(last.select(*keys, "_last"), keys).withColumn("bin", F.floor(F.col(t) / (F.col("_last") + margin) * bins).cast("int")).groupBy(*keys, "bin").agg(F.avg(value).alias("_v"))
    grid = last.select(*keys, *(scale_by or []), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = grid.join(placed, [*keys, "bin"], "left").withColumn("_v", F.coalesce(F.last("_v", ignorenulls=True).over(w), F.lit(0.0)))
    whole = Window.partitionBy(*keys)
    x = x.withColumn("_v", F.col("_v") - F.median(F.when(F.col("bin") >= bins - tail, F.col("_v"))).over(whole))
    x = x.withColumn("_peak", F.max("_v").over(whole))
    if scale_by:
        peaks = x.where("bin = 0").groupBy(*scale_by).agg(F.median("_peak").alias("_scale"))
        x = x.join(peaks, scale_by, "left")
    else:
        x = x.withColumn("_scale", F.col("_peak"))
    return x.withColumn("level", F.col("_v") / F.nullif(F.col("_scale"), F.lit(0.0))).drop("_v", "_peak", "_scale")


def mean_by_phase(df: DataFrame, phase: Column, t: str, value: str) -> DataFrame:
    return df.withColumn("phase", phase).where("phase is not null").groupBy("phase", t).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
