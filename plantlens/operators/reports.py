"""Report tables for all jobs, moulds or series at once; the thing reported on is a column, not a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .windows import series


def period_kpis(df: DataFrame, period: Column, measures: dict[str, Column]) -> DataFrame:
    """The measures of the latest period and of the one before, one row each with `lag` 0 or 1."""
    x = df.groupBy(period.alias("period")).agg(*[m.alias(k) for k, m in measures.items()])
    rank = F.row_number().over(Window.orderBy(F.desc("period"))) - 1  # one row a period
    return x.withColumn("lag", rank).where("lag < 2")


def run_headers(df: DataFrame, job: str, ts: str, lists: dict[str, str], counts: dict[str, Column]) -> DataFrame:
    """One row per job: first and last time, rows, distinct values as sorted text, conditional counts."""
    return df.groupBy(job).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n"),
        *[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(name) for name, c in lists.items()],
        *[F.count_if(c).alias(name) for name, c in counts.items()],
    )


def active_signals(signals: DataFrame, rows: DataFrame, keys: list[str], ts: str, days: int, tie: str) -> DataFrame:
    """The last signal of each key that had rows within the last days of all."""
    last = rows.agg(F.max(ts).alias("_last"))
    active = rows.groupBy(*keys).agg(F.max(ts).alias("_own")).crossJoin(F.broadcast(last)).where(F.col("_own") >= F.col("_last") - F.make_dt_interval(days=F.lit(days)))  # one row
    own = signals.join(active.select(*keys), keys, "left_semi")
    return own.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in signals.columns if c not in keys]), F.struct(ts, tie)).alias("_x")).select(*keys, "_x.*")


def hours_over(df: DataFrame, keys: list[str], hour: Column, value: str, limit: float) -> DataFrame:
    """Distinct hours in which the largest absolute value of a row passes the limit: audits to ask for."""
    x = df.groupBy(*keys, hour.alias("hour_ts")).agg(F.max(F.abs(F.col(value))).alias("worst"))
    return x.where(F.col("worst") > limit)


def weekly_layers(df: DataFrame, week: Column, layers: dict[str, Column]) -> DataFrame:
    """Alarms of each layer by week; weeks without any have 0."""
    return df.groupBy(week.alias("week_ts")).agg(*[F.count_if(c).alias(k) for k, c in layers.items()])


def out_of_band(df: DataFrame, keys: list[str], value: str, low: Column, high: Column) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count_if(v < low).alias("below"), F.count_if(v > high).alias("above"), F.count(v).alias("n"))


def null_shares(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Share of nulls of each column by group."""
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_null") for c in columns])


def event_list(sources: dict[str, tuple[DataFrame, str, Column]], key: str) -> DataFrame:
    """Events of several tables as (key, at, kind, what), to be sorted by the reader."""
    out = None
    for kind, (df, ts, what) in sources.items():
        x = df.select(key, F.col(ts).alias("at"), F.lit(kind).alias("kind"), what.cast("string").alias("what"))
        out = x if out is None else out.unionByName(x)
    return out


def overlay(df: DataFrame, keys: list[str], order: str, value: str, runs: int = 5) -> DataFrame:
    """Each run's value over the median of the `runs` before it."""
    w = series(keys, [order])
    return df.withColumn("over_recent", ratio(F.col(value), F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-runs, -1))))


def followed_by(causes: DataFrame, effects: DataFrame, key: str, ts: str, effect_ts: str, code: str, within_s: float, least: int) -> DataFrame:
    """Causes followed within the time by at least so many effects of a new code, with the commonest such code.

    A code is new when the key had none of it in as long a time before the cause; the time after starts with the cause.
    Effects are joined on key and hour bucket of both windows, so a key's rows are not all paired.
    """
    hours = int(within_s // 3600) + 1
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 3600)
    c = causes.withColumn("_h", bucket(ts)).withColumn("_h", F.explode(F.sequence(F.col("_h") - hours, F.col("_h") + hours)))
    e = effects.select(F.col(key).alias("_key"), bucket(effect_ts).alias("_eh"), F.col(effect_ts).alias("_at"), F.col(code).alias("_code"))
    gap = F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    met = c.join(e, (F.col(key) == F.col("_key")) & (F.col("_h") == F.col("_eh"))).withColumn("_gap", gap).where((F.col("_gap") >= -within_s * 1e6) & (F.col("_gap") < within_s * 1e6))
    n = met.groupBy(*causes.columns, "_code").agg(F.count_if(F.col("_gap") >= 0).alias("n"), F.count_if(F.col("_gap") < 0).alias("_before")).where((F.col("n") >= least) & (F.col("_before") == 0))
    return n.groupBy(*causes.columns).agg(F.max_by("_code", F.struct("n", "_code")).alias("effect"), F.max("n").alias("n"))
