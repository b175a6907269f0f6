"""Exact quantiles of groups of any size, by counting ranges instead of sorting groups.

A wanted order statistic lies between the least and the largest value of its group. Each round cuts what is left of that
range into bins, counts the group's values in each bin with partial aggregates (at most `bins` rows a wanted rank and task),
and goes on with the bin that holds the rank, between the least and largest value seen in it. Ties end at once, as the two
are equal then. Where few values are left in the range, these alone are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialised


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])


def order_statistics(values: DataFrame, keys: list[str], wanted: DataFrame, bins: int = 1024, few: int = 20_000, rounds: int = 60) -> DataFrame:
    """keys, rank and value: the rank-th smallest `_v` of each group, ranks from 1.

    `values` has keys and _v without nulls and NaN, and is read once a round; `wanted` has keys and rank, distinct and
    within each group's size. An error if `rounds` rounds leave a range of more than `few` different values.
    """
    names = [f"_{k}" for k in keys]
    ends = values.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("inside")).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    left = materialised(wanted.join(ends, _same(keys)).select(*names, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "inside"), "ranges")
    done = left.where("lo = hi").select(*names, "rank", F.col("lo").alias("_value"))
    left = left.where("lo < hi")
    for _ in range(rounds):
        small = left.where(F.col("inside") <= few)
        met = values.join(small, _same(keys) & F.col("_v").between(F.col("lo"), F.col("hi")))
        place = F.row_number().over(Window.partitionBy(*names, "rank").orderBy("_v"))
        done = done.unionByName(met.withColumn("_n", place).where(F.col("_n") == F.col("rank") - F.col("below")).select(*names, "rank", F.col("_v").alias("_value")))
        left = left.where(F.col("inside") > few)
        if left.isEmpty():
            return done.withColumnsRenamed(dict(zip(names, keys, strict=True)))
        met = values.join(left, _same(keys) & F.col("_v").between(F.col("lo"), F.col("hi")))
        # Halves are taken before the difference, which could be beyond the largest double.
        at = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bin_ = F.least(F.lit(bins - 1), F.floor(at * bins).cast("int"))
        counts = met.groupBy(*names, "rank", "below", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*names, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        counts = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("n") < F.col("rank")))
        left = materialised(counts.select(*names, "rank", "lo", "hi", (F.col("_upto") - F.col("n")).alias("below"), F.col("n").alias("inside")), "ranges")
        done = done.unionByName(left.where("lo = hi").select(*names, "rank", F.col("lo").alias("_value")))
        left = left.where("lo < hi")
    raise RuntimeError(f"ranges of over {few} values are left after {rounds} rounds")


def grouped_quantiles(df: DataFrame, keys: list[str], value: str | Column, shares: dict[str, float], bins: int = 1024, few: int = 20_000) -> DataFrame:
    """One row per group: n (values that are not null or NaN) and, for each name of `shares`, the quantile at that share.

    Quantiles between two values are interpolated, as percentile does. No keys: one row for the table. Groups without
    values have no row. Null keys are a group. The values are written once; equal and skewed values are counted, not sorted.
    """
    v = F.col(value) if isinstance(value, str) else value
    own = keys or ["_all"]
    x = df if keys else df.withColumn("_all", F.lit(0))
    x = x.select(*own, v.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    x = materialised(x, "quantiles")
    size = x.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos")) for name, p in shares.items()]))
    asked = size.select(*own, at.alias("_a")).select(*own, F.col("_a.name").alias("name"), F.col("_a.pos").alias("pos"))
    asked = asked.withColumns({"low": (F.floor("pos") + 1).cast("long"), "high": (F.ceil("pos") + 1).cast("long")})
    wanted = asked.select(*own, F.col("low").alias("rank")).unionByName(asked.select(*own, F.col("high").alias("rank"))).distinct()
    found = materialised(order_statistics(x, own, wanted, bins, few), "found").withColumnsRenamed({k: f"_{k}" for k in own})
    value_of = lambda c: found.select(*[F.col(f"_{k}").alias(f"_{c}_{k}") for k in own], F.col("rank").alias(f"_{c}"), F.col("_value").alias(f"_{c}_value"))
    for c in ("low", "high"):
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{c}_{k}")) for k in own], F.col(c) == F.col(f"_{c}"))  # noqa: B023
        asked = asked.join(value_of(c), on)
    between = F.when(F.col("low") == F.col("high"), F.col("_low_value")).otherwise((F.col("high") - 1 - F.col("pos")) * F.col("_low_value") + (F.col("pos") - F.col("low") + 1) * F.col("_high_value"))
    out = asked.withColumn("_q", between).groupBy(*own).agg(*[F.max(F.when(F.col("name") == name, F.col("_q"))).alias(name) for name in shares])
    sizes = size.withColumnsRenamed({k: f"_{k}" for k in own})
    return out.join(sizes, _same(own)).select(*keys, "n", *shares)
