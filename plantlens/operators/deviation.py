"""Values against bands: deviation, alarm state, roll-up of sensors to shots, band establishment, match score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def deviation(value: Column, template: Column, low: Column, high: Column) -> Column:
    """0 on the template, 1 at the upper and -1 at the lower alarm limit; null where a limit is the template."""
    return ratio(value - template, F.when(value >= template, high - template).otherwise(template - low))


def outside(value: Column, low: Column, high: Column) -> Column:
    return (value < low) | (value > high)


def alarm_state(alarms: list[Column], warnings: list[Column], dropout: Column, unmatched: Column | None = None) -> Column:
    """none for a dropout, else alarm, warning or none by the flags; null flags count as off."""
    any_of = lambda flags: F.greatest(*[F.coalesce(f, F.lit(False)).cast("int") for f in [*flags, F.lit(False), F.lit(False)]]) > 0
    alarm = any_of([*alarms, *([unmatched] if unmatched is not None else [])])
    return F.when(dropout, "none").when(alarm, "alarm").when(any_of(warnings), "warning").otherwise("none")


STATES = ("none", "warning", "alarm")


def state_code(state: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(STATES):
        out = F.when(state == name, k).otherwise(out)
    return out


def state_label(code: Column) -> Column:
    out = F.lit(STATES[0])
    for k, name in enumerate(STATES[1:], 1):
        out = F.when(code == k, name).otherwise(out)
    return out


def rolled_up(df: DataFrame, keys: list[str], state: str, deviations: list[str], sensor: str, values: dict[str, tuple[str, str]], also: tuple[Column, ...] = ()) -> DataFrame:
    """Sensor rows to one row: worst state, largest absolute deviation, alarmed sensors in order, mean and spread by position.

    `values`: output name -> (value column, condition); each gives the mean where the condition holds, and the spread.
    `also`: more sums of the same rows.
    """
    worst = F.max(state_code(F.col(state)))
    largest = F.greatest(*[F.coalesce(F.abs(F.col(d)), F.lit(0.0)) for d in deviations], F.lit(0.0))
    out = [F.max(largest).alias("max_abs_deviation"), F.array_join(F.array_sort(F.collect_set(F.when(F.col(state) == "alarm", F.col(sensor)))), ";").alias("alarmed"), F.bool_or(F.col(state) != "none").alias("any_flag"), F.count(F.lit(1)).alias("n_sensors")]
    for name, (value, where) in values.items():
        v = F.when(F.expr(where), F.col(value))
        out += [F.avg(v).alias(name), (F.max(v) - F.min(v)).alias(f"{name}_spread")]
    return df.groupBy(*keys).agg(*also, worst.alias("state_code"), *out).withColumn("state", state_label(F.col("state_code")))


def bands(df: DataFrame, keys: list[str], position: str, metrics: dict[str, float], first: int, size: int = 60, warning: float = 0.6, widen: float = 1.0) -> DataFrame:
    """One row per key: for each metric the median of a window of rows after convergence, and bands as shares of it."""
    own = df.where((F.col(position) >= first) & (F.col(position) < first + size))
    out = own.groupBy(*keys).agg(*[F.median(m).alias(f"{m}_template") for m in metrics])
    for m, share in metrics.items():
        t, half = F.col(f"{m}_template"), F.abs(F.col(f"{m}_template")) * share * widen
        out = out.withColumns({f"{m}_alarm_low": t - half, f"{m}_alarm_high": t + half, f"{m}_warning_low": t - half * warning, f"{m}_warning_high": t + half * warning})
    return out


def match_score(deviations: list[Column], slope: float = 0.18) -> Column:
    """1 less slope times the root mean square deviation, within 0 and 1."""
    squares = [F.coalesce(d * d, F.lit(0.0)) for d in deviations]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - slope * F.sqrt(sum(squares[1:], squares[0]) / len(squares))))


def triggered(deviations: dict[str, Column], separator: str = ";") -> Column:
    """Names of the values outside their alarm bands, joined."""
    return F.concat_ws(separator, *[F.when(F.abs(d) > 1, F.lit(name)) for name, d in deviations.items()])
