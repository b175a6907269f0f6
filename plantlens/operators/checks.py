"""Data checks: each returns violations or measures as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: how many nulls."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "n_null")


def not_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def range_checks(measures: dict[str, tuple[DataFrame, Column, float, float]]) -> DataFrame:
    """One row per measure (a one-row aggregate): value, low, high, passed."""
    rows = [df.agg(m.cast("double").alias("value")).select(F.lit(name).alias("measure"), "value", F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for name, (df, m, low, high) in measures.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)))


def lag1_autocorrelation(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    from pyspark.sql import Window

    x = df.withColumn("_p", F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_p").isNotNull() & F.col(value).isNotNull())
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.covar_samp(value, "_p") / F.nullif(F.stddev_samp(value) * F.stddev_samp("_p"), F.lit(0.0))).alias("lag1"))


def robust_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """1.4826 times the median absolute deviation from the group's median."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    return df.join(mid, keys).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("spread"))


def two_regressor_r2(df: DataFrame, keys: list[str], y: str, a: str, b: str) -> DataFrame:
    """R squared of y on a and b per group, from covariances in closed form."""
    cov = lambda p, q: F.covar_samp(p, q)
    x = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cov(a, a).alias("aa"), cov(b, b).alias("bb"), cov(a, b).alias("ab"), cov(a, y).alias("ay"), cov(b, y).alias("by"), cov(y, y).alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    fit = (F.col("ay") * F.col("ay") * F.col("bb") - 2 * F.col("ay") * F.col("by") * F.col("ab") + F.col("by") * F.col("by") * F.col("aa")) / F.nullif(det, F.lit(0.0))
    return x.select(*keys, "n", (fit / F.nullif("yy", F.lit(0.0))).alias("r2"))
