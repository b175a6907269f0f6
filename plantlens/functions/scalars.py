"""Column functions: boundary-counting date differences, shifts, guarded ratios, code texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, of a timestamp without zone as if it were UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """How many starts of `unit` lie between two timestamps: 00:59 to 01:01 is one hour boundary."""
    n = SECONDS[unit]
    return (F.floor(epoch(end) / n) - F.floor(epoch(start) / n)).cast("long")


def elapsed(unit: str, start: Column, end: Column) -> Column:
    """Fractional units between two timestamps."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(float(SECONDS[unit] * 1_000_000))


def truncated(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))


def shift_label(ts: Column) -> Column:
    """A from 06:00, B from 14:00, C from 22:00."""
    hour = F.hour(ts)
    return F.when((hour >= 6) & (hour < 14), "A").when((hour >= 14) & (hour < 22), "B").otherwise("C")


def shift_date(ts: Column) -> Column:
    """The production day, which starts at 06:00."""
    return (ts - F.make_dt_interval(hours=F.lit(6))).cast("date")


def in_production_week(ts: Column) -> Column:
    """Monday 06:00 to Saturday 06:00."""
    return F.weekday(ts - F.make_dt_interval(hours=F.lit(6))) < 5


def season(ts: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = 2 * math.pi * F.dayofyear(ts) / 365.25
    return F.sin(angle), F.cos(angle)


def normalized_code(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The code of the first rule (pattern, code) found in the lower-cased text; blank or unmatched: default."""
    low = F.lower(text)
    out = F.lit(default)
    for pattern, code in reversed(rules):
        out = F.when(low.rlike(pattern), code).otherwise(out)
    return F.when(text.isNull() | (F.trim(text) == ""), default).otherwise(out)


def without_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    """Upper-cased, without one of the prefixes and the dash or blank after it."""
    return F.regexp_replace(F.upper(F.trim(text)), f"^({'|'.join(prefixes)})[- ]?", "")


def has_code(codes: Column, code: str, separator: str = ";") -> Column:
    return F.coalesce(F.array_contains(F.split(codes, separator), code), F.lit(False))


def quantities(text: Column, outer: str = ";", inner: str = ":") -> Column:
    """`code:qty;code:qty` as an array of (code, qty)."""
    return F.transform(F.split(text, outer), lambda x: F.struct(F.split_part(x, F.lit(inner), F.lit(1)).alias("code"), F.split_part(x, F.lit(inner), F.lit(2)).cast("double").alias("qty")))


def labels_of(text: Column, drop: str, separator: str = ";") -> Column:
    """Labels of a separated text as an array, each without `drop`: `end_of_fill_pressure_bar;x` and `_bar` give end_of_fill_pressure, x."""
    return F.transform(F.split(text, separator), lambda x: F.replace(x, F.lit(drop), F.lit("")))


def cavity_key(cell_code: Column, cavity: Column, most: int = 32) -> Column:
    """One number for a cavity of a cell."""
    return cell_code * most + cavity


def numbers(text: Column, separator: str = ";") -> Column:
    return F.transform(F.split(text, separator), lambda x: x.try_cast("double"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = ratio(hits.cast("double"), n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half
