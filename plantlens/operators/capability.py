"""Process capability and X-bar/R charts from subgroups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio

#: d2 (mean range over sigma) and D4 (range limit over mean range) by subgroup size.
D2 = {2: 1.128, 3: 1.693, 4: 2.059, 5: 2.326, 6: 2.534, 7: 2.704, 8: 2.847, 9: 2.970, 10: 3.078, 12: 3.258, 15: 3.472, 20: 3.735}
D4 = {2: 3.267, 3: 2.574, 4: 2.282, 5: 2.114, 6: 2.004, 7: 1.924, 8: 1.864, 9: 1.816, 10: 1.777}


def by_size(table: dict[int, float], n: Column) -> Column:
    """The table's value at its size nearest to n; of two as near the smaller."""
    sizes = sorted(table)
    out = F.lit(table[sizes[-1]])
    for size, larger in reversed(list(zip(sizes, sizes[1:], strict=False))):
        out = F.when(n <= (size + larger) / 2, F.lit(table[size])).otherwise(out)
    return out


def subgroups(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"))


def capability(df: DataFrame, keys: list[str], subgroup: str, value: str, low: Column, high: Column) -> DataFrame:
    """Cp, Cpk (spread within subgroups of two or more) and Ppk (overall spread) per key."""
    inner = subgroups(df, [*keys, subgroup], value).where("n > 1").groupBy(*keys).agg(F.avg(F.col("range") / by_size(D2, F.col("n"))).alias("sigma_within"))
    all_ = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma_overall"), F.max(low).alias("low"), F.max(high).alias("high"))
    x = all_.join(inner, keys, "left")
    near = F.least(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    return x.withColumns({"cp": ratio(F.col("high") - F.col("low"), 6 * F.col("sigma_within")), "cpk": ratio(near, 3 * F.col("sigma_within")), "ppk": ratio(near, 3 * F.col("sigma_overall"))})


def xbar_r(groups: DataFrame, keys: list[str], order: list[str], baseline: int = 25) -> DataFrame:
    """Subgroups with X-bar and range limits from the first `baseline` of their key, and violations."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = groups.withColumn("group_no", F.row_number().over(w))
    base = x.where(F.col("group_no") <= baseline).groupBy(*keys).agg(F.avg("mean").alias("grand_mean"), F.avg("range").alias("mean_range"), F.avg("n").alias("mean_n"))
    a2 = 3 / (by_size(D2, F.col("mean_n")) * F.sqrt(F.col("mean_n")))
    base = base.withColumns({"upper": F.col("grand_mean") + a2 * F.col("mean_range"), "lower": F.col("grand_mean") - a2 * F.col("mean_range"), "range_upper": by_size(D4, F.col("mean_n")) * F.col("mean_range")})
    x = x.join(base, keys)
    return x.withColumns({"mean_out": (F.col("mean") > F.col("upper")) | (F.col("mean") < F.col("lower")), "range_out": F.col("range") > F.col("range_upper")})


def audit_rules(audits: DataFrame, keys: list[str], order: list[str], value: str, baseline: int = 25) -> DataFrame:
    """Audits with z of their mean against the first `baseline` audits of their key, and run rules 1, 2, 4 and 5 as a text.

    A rule that needs n audits says nothing on the first n - 1. Audits without a key have no baseline and are left out;
    those without an order are a key's last.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    x = audits.dropna(subset=keys).withColumn("audit_no", F.row_number().over(w))
    base = F.when(F.col("audit_no") <= baseline, F.col(value))
    whole = Window.partitionBy(*keys)
    x = x.withColumn("z", ratio(F.col(value) - F.avg(base).over(whole), F.stddev_samp(base).over(whole)))
    n = lambda hit, size: F.when(F.col("audit_no") >= size, F.sum(F.coalesce(hit.cast("int"), F.lit(0))).over(w.rowsBetween(1 - size, 0)))
    either = lambda limit, size, least: F.greatest(n(F.col("z") > limit, size), n(F.col("z") < -limit, size)) >= least
    rules = {"WE1": F.abs("z") > 3, "WE2": either(2, 3, 2), "WE4": either(1, 5, 4), "WE5": either(0, 8, 8)}
    return x.withColumn("rules", F.concat_ws(";", *[F.when(hit, F.lit(name)) for name, hit in rules.items()]))
