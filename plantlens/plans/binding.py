"""How queries are bound: a function of (spark, sf_dir) under its name, with the SQL of the same result beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Bound:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measured points: series user_id, time ts, id event_id, metric event_type."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def log(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """events of some types as a log of what happened to a series."""
    from pyspark.sql import functions as F

    x = points(spark, sf_dir).where(F.col("event_type").isin(*kinds))
    return x.select("user_id", F.col("ts").alias("log_ts"), F.col("event_id").alias("log_id"), F.col("event_type").alias("kind"), F.col("value").alias("log_value"))


def r6(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or str(c))


def signed_r6(c: str) -> Column:
    """r6 that keeps the sign of what rounds to zero, as SQL's round does: -1e-15 gives -0.0."""
    to = F.round(F.col(c), 6)
    return F.when((F.col(c) < 0) & (to == 0), F.lit(-0.0)).otherwise(to).alias(c)
