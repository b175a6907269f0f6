"""Defect labels: code lists, allocation of counts over hours, union of sources, facts and marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_code, quantities, ratio


def exploded_codes(df: DataFrame, codes: str, keep: list[str]) -> DataFrame:
    """One row per code of a `code:qty;...` text; null and empty texts give none."""
    return df.where(F.col(codes).isNotNull() & (F.col(codes) != "")).select(*keep, F.explode(quantities(F.col(codes))).alias("_x")).select(*keep, F.col("_x.code").alias("code"), F.col("_x.qty").alias("qty"))


def one_hot(df: DataFrame, codes: str, names: list[str]) -> DataFrame:
    return df.withColumns({f"is_{n}": has_code(F.col(codes), n).cast("int") for n in names})


def allocated(totals: DataFrame, shares: DataFrame, keys: list[str], qty: str, weight: str) -> DataFrame:
    """Quantities of a group spread over its rows in proportion to their weights; groups without rows are left out."""
    share = ratio(F.col(weight).cast("double"), F.sum(weight).over(Window.partitionBy(*keys)))
    return shares.withColumn("share", share).join(totals, keys).withColumn("allocated", F.col(qty) * F.col("share"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' rows by column name with their source; missing columns are null."""
    frames = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def relative_to_baseline(df: DataFrame, keys: list[str], order: list[str], values: list[str], first: int = 500) -> DataFrame:
    """Each value over the median of the series' first rows, less 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_no", F.row_number().over(w))
    base = x.where(F.col("_no") <= first).groupBy(*keys).agg(*[F.median(v).alias(f"_{v}") for v in values])
    return x.join(base, keys, "left").withColumns({f"{v}_rel": ratio(F.col(v), F.col(f"_{v}")) - 1 for v in values}).drop("_no", *[f"_{v}" for v in values])


def maturity(known: DataFrame, qty: str, days: str, horizons: list[int]) -> DataFrame:
    """One row: the share of the final quantity known within each number of days."""
    return known.agg(*[(F.sum(F.when(F.col(days) <= k, F.col(qty)).otherwise(0.0)) / F.nullif(F.sum(qty), F.lit(0))).alias(f"share_{k}d") for k in horizons])


def coverage(df: DataFrame, by: list[str], linked: Column) -> DataFrame:
    """Linked rows and their share by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(linked).alias("n_linked")).withColumn("share", ratio(F.col("n_linked").cast("double"), F.col("n")))


def pareto(df: DataFrame, by: str, weight: Column) -> DataFrame:
    """Counts of a category, largest first, with cumulative share; categories are few, so one window orders them all."""
    n = df.groupBy(by).agg(F.sum(weight).alias("n"))
    w = Window.orderBy(F.desc("n"), by)
    return n.withColumns({"rank": F.row_number().over(w), "cumulative": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())})


def top_causes(df: DataFrame, keys: list[str], cause: str, n: int = 2) -> DataFrame:
    """The n most frequent causes of each group as text."""
    counts = df.groupBy(*keys, cause).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), cause)
    best = counts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", cause))), lambda x: x[cause]), "; ").alias("causes"))


def first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each group in the order they were first seen, as text."""
    once = df.groupBy(*keys, value).agg(F.min(order).alias("_at"))
    return once.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]), ";").alias("seen"))
