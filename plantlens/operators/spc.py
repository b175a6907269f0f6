"""Control charts on autocorrelated series: limits, AR(1) residuals, pooled spread, run rules, alarms.

Every step is a window over the same partition (a series), so one shuffle serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .windows import RUNNING, START, recent, running

#: Mean range of two over sigma; control limit of the moving range over its mean.
RANGE_TO_SIGMA, RANGE_LIMIT = 1.128, 3.267


def unpivoted(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Long form (ids, metric, value) without null values."""
    return df.unpivot(ids, metrics, "metric", "value").where("value is not null")


def charted(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Points with point_no, the value before and the moving range."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumns({"point_no": F.row_number().over(w), "previous": F.lag(value).over(w)})
    return x.withColumn("moving_range", F.abs(F.col(value) - F.col("previous")))


def _limit_sums(on: Column, value: str) -> dict[str, Column]:
    v = F.when(on, F.col(value))
    return {"n": F.count(v), "centre": F.avg(v), "mr_bar": F.avg(F.when(on, F.col("moving_range"))), "sigma_baseline": F.stddev_samp(v)}


def _fit_sums(on: Column, value: str) -> dict[str, Column]:
    """Count, mean and spread, and the sums of the lag-1 coefficient: covariance and product of spreads."""
    v, pair = F.when(on, F.col(value)), on & F.col(value).isNotNull() & F.col("previous").isNotNull()
    x, y = F.when(pair, F.col(value)), F.when(pair, F.col("previous"))
    return {"ar_n": F.count(v), "ar_mean": F.avg(v), "ar_sd": F.stddev_samp(v), "_c": F.covar_samp(x, y), "_sx": F.stddev_samp(x), "_sy": F.stddev_samp(y)}


def _phi() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.98), F.col("_c") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0))))


def imr_limits(points: DataFrame, keys: list[str], baseline: int = 500, value: str = "value") -> DataFrame:
    """One row per series: centre, sigma from the moving range and from the baseline's spread, limits."""
    out = points.where(F.col("point_no") <= baseline).groupBy(*keys).agg(*[c.alias(k) for k, c in _limit_sums(F.lit(True), value).items()])
    sigma = F.col("mr_bar") / RANGE_TO_SIGMA
    return out.withColumns({"sigma_range": sigma, "upper": F.col("centre") + 3 * sigma, "lower": F.col("centre") - 3 * sigma, "range_upper": RANGE_LIMIT * F.col("mr_bar")})


def ar1_fit(points: DataFrame, keys: list[str], first: int, last: int, value: str = "value", position: str = "point_no") -> DataFrame:
    """One row per series: mean, spread and lag-1 coefficient (0 to 0.98) over the points first < position <= last.

    The coefficient is that of sums, which a constant series makes null; then, as in least(0.98, null), it is 0.98.
    """
    own = points.where((F.col(position) > first) & (F.col(position) <= last))
    out = own.groupBy(*keys).agg(*[c.alias(k) for k, c in _fit_sums(F.lit(True), value).items()])
    return out.withColumn("phi", _phi()).drop("_c", "_sx", "_sy")


def with_limits_and_fit(points: DataFrame, keys: list[str], baseline: int, first: int, last: int, value: str = "value", position: str = "point_no") -> DataFrame:
    """Points with the limits of imr_limits and the fit of ar1_fit, whose points have one before them, in the same pass over the series.

    A series without points to fit has no coefficient, as it has no row in ar1_fit.
    """
    w = Window.partitionBy(*keys)
    sums = _limit_sums(F.col("point_no") <= baseline, value)
    fitted = (F.col(position) > first) & (F.col(position) <= last) & F.col("previous").isNotNull()
    sums |= _fit_sums(fitted, value) | {"_fitted": F.count(F.when(fitted, 1))}
    x = points.withColumns({k: sums[k].over(w) for k in ("centre", "mr_bar", "sigma_baseline", "_fitted", "ar_mean", "_c", "_sx", "_sy")})
    return x.withColumns({"sigma_range": F.col("mr_bar") / RANGE_TO_SIGMA, "phi": F.when(F.col("_fitted") > 0, _phi())}).drop("_fitted", "_c", "_sx", "_sy")


def trailing_level(points: DataFrame, keys: list[str], order: list[str], rows: int = 500, value: str = "value") -> DataFrame:
    """Points with mean and count of the `rows` before them."""
    x = running(points, keys, order, value)
    return x.withColumns(recent(Window.partitionBy(*keys).orderBy(*order), rows)).drop(*RUNNING)


def about_level(points: DataFrame, least: int = 100, value: str = "value") -> DataFrame:
    """Points with their level (trailing mean, with few rows the fit's mean) and the AR(1) residual about it."""
    x = points.withColumn("level", F.when(F.col("recent_n") >= least, F.col("recent_mean")).otherwise(F.col("ar_mean")))
    return x.withColumn("residual", (F.col(value) - F.col("level")) - F.col("phi") * (F.col("previous") - F.col("level")))


def ar1_residual(points: DataFrame, fit: DataFrame, keys: list[str], order: list[str], level_rows: int = 500, least: int = 100, value: str = "value", how: str = "inner") -> DataFrame:
    """Points with their level (trailing mean, with few rows the fit's mean) and the AR(1) residual about it; how="left" keeps series without a fit."""
    return about_level(trailing_level(points, keys, order, level_rows, value).join(fit, keys, how), least, value)


def pooled_sigma(residuals: DataFrame, run_keys: list[str], group_keys: list[str], run_order: str, skip: int, own_first: int, own_last: int, position: str = "point_no") -> DataFrame:
    """One row per run: sigma pooled over every earlier run of its group; a first run has its own (points own_first < no <= own_last)."""
    used = (F.col(position) > skip) & F.col("residual").isNotNull()
    own = (F.col(position) > own_first) & (F.col(position) <= own_last)
    runs = residuals.groupBy(*dict.fromkeys([*run_keys, *group_keys])).agg(
        F.min(run_order).alias("starts"),
        F.sum(F.when(used, F.col("residual") * F.col("residual"))).alias("ss"),
        F.sum(F.when(used, 1).otherwise(0)).cast("long").alias("n"),
        F.stddev_samp(F.when(own, F.col("residual"))).alias("sigma_own"),
    )
    before = Window.partitionBy(*group_keys).orderBy("starts", *[k for k in run_keys if k not in group_keys]).rowsBetween(START, -1)
    pooled = F.sqrt(F.sum("ss").over(before) / F.nullif(F.sum("n").over(before), F.lit(0)))
    return runs.withColumn("sigma", F.coalesce(pooled, F.col("sigma_own")))


def z_scores(value: str = "value") -> dict[str, Column]:
    """z of the residual, and of the value by the textbook's sigma (moving range) and the baseline's spread."""
    over = lambda x, sigma: x / F.nullif(F.col(sigma), F.lit(0.0))
    off = F.col(value) - F.col("centre")
    return {"z": over(F.col("residual"), "sigma"), "z_textbook": over(off, "sigma_range"), "z_baseline": over(off, "sigma_baseline")}


def run_rules(points: DataFrame, keys: list[str], order: list[str], z: str, limit1: float = 3.0, limit2: float = 2.0, prefix: str = "", rules: tuple[str, ...] = ("we1", "we2", "we4", "we5")) -> DataFrame:
    """Western Electric rules (1, 2, 4 and 5, or those named) on z as flags; a null z counts as no; early points see the points there are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    v = F.coalesce(F.col(z), F.lit(0.0))

    def count(hit: Column, n: int) -> Column:
        return F.sum(hit.cast("int")).over(w.rowsBetween(1 - n, 0))

    flags = {
        "we1": F.abs(v) > limit1,
        "we2": (count(v > limit2, 3) >= 2) | (count(v < -limit2, 3) >= 2),
        "we4": (count(v > 1, 5) >= 4) | (count(v < -1, 5) >= 4),
        "we5": (count(v > 0, 8) >= 8) | (count(v < 0, 8) >= 8),
    }
    return points.withColumns({f"{prefix}{k}": f for k, f in flags.items() if k in rules})


def scaled_rules(points: DataFrame, keys: list[str], order: list[str], z: str, scale: str) -> DataFrame:
    """Points with `flag`: rule 1 or 2 at `scale` times the textbook limits; a null z counts as 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-2, 0)
    v, c = F.coalesce(F.col(z), F.lit(0.0)), F.col(scale)
    two = lambda side: F.sum((side * v > 2 * c).cast("int")).over(w) >= 2
    return points.withColumn("flag", (F.abs(v) > 3 * c) | two(1) | two(-1))


def range_rule(points: DataFrame, mr_bar: str = "mr_bar") -> DataFrame:
    return points.withColumn("mr_rule", F.col("moving_range") > RANGE_LIMIT * F.col(mr_bar))


def first_rule(flags: dict[str, str]) -> Column:
    """The label of the first flag that is on, in the order given."""
    out = F.lit(None).cast("string")
    for flag, label in reversed(flags.items()):
        out = F.when(F.coalesce(F.col(flag), F.lit(False)), label).otherwise(out)
    return out


def new_alarms(points: DataFrame, keys: list[str], flags: dict[str, str]) -> DataFrame:
    """Fired points whose series didn't fire on the point before, with the rule of the highest priority."""
    fired = points.withColumn("rule", first_rule(flags)).where("rule is not null")
    before = F.lag("point_no").over(Window.partitionBy(*keys).orderBy("point_no"))
    return fired.withColumn("_before", before).where("_before is null or point_no - _before > 1").drop("_before")


def alarm_disposition(alarms: DataFrame, changes: DataFrame, keys: list[str], ts: str, change_ts: str, columns: list[str], within_s: float = 3600, tie: str | None = None, bucket: str | None = None) -> DataFrame:
    """Alarms with the next change within the time, if any."""
    x = asof_join(alarms, changes, keys, ts, change_ts, columns, direction="forward", tolerance_s=within_s, tie=tie, prefix="change_", bucket=bucket)
    return x.withColumn("disposition", F.when(F.col("change_at").isNotNull(), "changed").otherwise("none"))
