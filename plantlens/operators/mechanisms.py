"""Tests of detectors against what is known to have happened: leads, steps, requests, event credit, classification."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import elapsed, ratio, wilson
from .asof import asof_join, range_join
from .evaluate import median_interval, uniform
from .windows import START, series


def first_exceedance(df: DataFrame, keys: list[str], order: list[str], event: str, size: int = 1000, least: float = 3.0, times: float = 3.0, base_rows: int = 3000) -> DataFrame:
    """One row per key: the first position whose trailing sum of `size` events is over max(least, times * base), and how many rows there are.

    Only whole windows have a sum; the base is the mean of the sums among the key's first `base_rows` rows, 0 if there are none.
    """
    w = series(keys, order)
    frame = w.rowsBetween(1 - size, 0)
    x = df.withColumns({"_pos": F.row_number().over(w) - 1, "_sum": F.when(F.count(F.lit(1)).over(frame) == size, F.sum(F.col(event).cast("double")).over(frame))})
    base = F.coalesce(F.avg(F.when(F.col("_pos") < base_rows, F.col("_sum"))).over(Window.partitionBy(*keys)), F.lit(0.0))
    x = x.withColumn("_base", base)
    return x.groupBy(*keys).agg(F.min(F.when(F.col("_sum") > F.greatest(F.lit(float(least)), times * F.col("_base")), F.col("_pos"))).alias("exceeds_at"), F.count(F.lit(1)).alias("n"))


def lead(fires: DataFrame, rises: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, whether the first firing (`fires_at`) comes before the rise (`exceeds_at`), and then by how many positions."""
    x = rises.join(fires, keys, "left").withColumn("ahead", F.coalesce(F.col("fires_at") < F.col("exceeds_at"), F.lit(False)))
    return x.withColumn("lead", F.when(F.col("ahead"), F.col("exceeds_at") - F.col("fires_at")))


def chance_of_lead(leads: DataFrame, keys: list[str], first: int = 1000, draws: int = 2000, seed: int = 7) -> DataFrame:
    """One row: had the rises come at random places of their intervals, how often firings would be ahead, and by how much.

    Each draw places every interval's rise evenly between `first`, where it can first be seen, and the interval's end, and
    leaves its firing. `leads`: exceeds_at, fires_at, n; intervals without a rise are left out. Draws are hashes.
    """
    x = leads.where("exceeds_at is not null").withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    x = x.withColumn("_rise", first + (F.col("n") - first) * uniform(seed, *[F.col(k) for k in keys], F.col("_d")))
    ahead = F.coalesce(F.col("fires_at") < F.col("_rise"), F.lit(False))
    one = x.groupBy("_d").agg(F.avg(ahead.cast("int")).alias("_share"), F.median(F.when(ahead, F.col("_rise") - F.col("fires_at"))).alias("_lead"))
    return one.agg(F.avg("_share").alias("chance"), F.percentile("_share", F.lit(0.025)).alias("chance_low"), F.percentile("_share", F.lit(0.975)).alias("chance_high"), F.median("_lead").alias("chance_lead"))


def lead_summary(leads: DataFrame, keys: list[str], within: tuple[int, int] = (2000, 6000), replicates: int = 2000, seed: int = 7) -> DataFrame:
    """One row: intervals, those with a rise and with a firing, the share ahead with its interval, median lead with its, the share within a range."""
    own = leads.withColumn("_key", F.concat_ws(":", *keys))
    rise = F.col("exceeds_at").isNotNull()
    counts = own.agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if(rise).alias("with_rise"), F.count_if(F.col("fires_at").isNotNull()).alias("with_firing"),
        F.count_if(F.col("ahead")).alias("n_ahead"), F.count_if(F.col("lead").between(*within)).alias("n_within"),
    )
    low, high = wilson(F.col("n_ahead"), F.col("with_rise"))
    counts = counts.withColumns({"share_ahead": ratio(F.col("n_ahead").cast("double"), F.col("with_rise")), "share_low": low, "share_high": high})
    middle = median_interval(own.withColumn("_all", F.lit(1)), ["_all"], "_key", "lead", replicates, seed)
    return counts.join(middle.select(F.col("median").alias("lead"), F.col("low").alias("lead_low"), F.col("high").alias("lead_high")), how="left", on=F.lit(True))  # one row each


def matched_windows(worn: DataFrame, unworn: DataFrame, keys: list[str], value: str, length: str) -> DataFrame:
    """Per worn run, its mean and that of the first rows, as many, of its key's unworn run. `unworn` has position per key."""
    prefix = worn.select(*keys, "run", length).join(unworn, keys).where(F.col("position") < F.col(length))
    base = prefix.groupBy(*keys, "run").agg(F.avg(value).alias("mean_unworn"), F.count(F.lit(1)).alias("n_unworn"))
    return worn.join(base, [*keys, "run"], "left")


def matched_jobs(worn: DataFrame, unworn: DataFrame, mold: str, job: str, length: str, first_fire: str) -> DataFrame:
    """Worn jobs with how many unworn jobs of their mould are as long, and how many of these fired within as many shots.

    Both have one row a job: mould, job, length, and the position of the first firing (null: none).
    """
    u = unworn.select(F.col(mold).alias("_mold"), F.col(length).alias("_n"), F.col(first_fire).alias("_fire"), F.lit(1).alias("_one"))
    x = worn.join(u, (F.col(mold) == F.col("_mold")) & (F.col("_n") >= F.col(length)), "left")
    return x.groupBy(job, length, F.col(first_fire).isNotNull().alias("fired")).agg(F.count("_one").alias("n_matched"), F.count_if(F.col("_fire") < F.col(length)).alias("n_fired"))


def shift_after_events(near: DataFrame, event: list[str], kind: str, value: str, least: int = 300) -> DataFrame:
    """One row per kind of event: the median of absolute mean change over the spread before, from nearest rows by side."""
    on = lambda s: F.when(F.col("side") == s, F.col(value))
    x = near.groupBy(*event, kind).agg(F.count(on("before")).alias("n0"), F.count(on("after")).alias("n1"), F.avg(on("before")).alias("m0"), F.avg(on("after")).alias("m1"), F.stddev_samp(on("before")).alias("s0"))
    x = x.where((F.col("n0") >= least) & (F.col("n1") >= least))
    return x.groupBy(kind).agg(F.median(F.abs(F.col("m1") - F.col("m0")) / F.nullif("s0", F.lit(0.0))).alias("shift"), F.count(F.lit(1)).alias("n_events"))


def classified_episodes(episodes: DataFrame, changes: DataFrame, keys: list[str], ts: str, change_ts: str, within_s: float, variable: Column) -> DataFrame:
    """Episodes as a step after a change, variability, or slow drift."""
    x = asof_join(episodes, changes, keys, ts, change_ts, [], tolerance_s=within_s, prefix="change_")
    return x.withColumn("kind", F.when(F.col("change_at").isNotNull(), "step").when(variable, "variability").otherwise("drift"))


def undetected_changes(changes: DataFrame, signals: DataFrame, keys: list[str], change_ts: str, ts: str, within_s: float) -> DataFrame:
    """Changes that no signal follows within the time."""
    return asof_join(changes, signals, keys, change_ts, ts, [], direction="forward", tolerance_s=within_s, prefix="signal_").where("signal_at is null")


def requests(signals: DataFrame, services: DataFrame, keys: list[str], ts: str, service_ts: str, counter: str, service_counter: str) -> DataFrame:
    """The first signal of each interval between services, with the next service, rows and days until it."""
    x = asof_join(signals, services, keys, ts, service_ts, [service_counter], direction="forward", tie=service_counter, prefix="service_")
    w = Window.partitionBy(*keys, "service_at").orderBy(ts, counter)
    x = x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return x.withColumns({"rows_until": F.col(f"service_{service_counter}") - F.col(counter), "days_until": elapsed("day", F.col(ts), F.col("service_at"))})


def changes_around(signals: DataFrame, changes: DataFrame, keys: list[str], ts: str, change_ts: str, before_s: float, after_s: float, columns: list[str], tie: str) -> DataFrame:
    """Signals with the change before them within one time and the next within another."""
    x = asof_join(signals, changes, keys, ts, change_ts, columns, tolerance_s=before_s, tie=tie, prefix="before_")
    return asof_join(x, changes, keys, ts, change_ts, columns, direction="forward", tolerance_s=after_s, tie=tie, prefix="next_")


def event_credit(events: DataFrame, rows: DataFrame, keys: list[str], ts: str, flags: list[str], start: str = "start_ts", end: str = "end_ts", bucket_s: int = 86_400) -> DataFrame:
    """Per event (a time range of a key, both ends in it): when its first row comes, how many it has, and for each flag the first row with it, their share, and the minutes from the first row to it.

    Rows meet events by key and bucket of time; what they have is summed up per event before it is joined back.
    """
    named = events.withColumn("_event", F.xxhash64(*events.columns)).distinct()
    r = rows.select(*keys, F.col(ts).alias("_ts"), *flags)
    met = range_join(r, named.select(*keys, "_event", F.col(start).alias("_start"), F.col(end).alias("_end")), keys, "_ts", "_start", "_end", closed=True, how="inner", bucket_s=bucket_s)
    of = lambda f: F.coalesce(F.col(f), F.lit(False))
    sums = met.groupBy("_event").agg(F.min("_ts").alias("started_at"), F.count("_ts").alias("n_rows"), *[F.min(F.when(F.col(f), F.col("_ts"))).alias(f"first_{f}") for f in flags], *[F.avg(of(f).cast("int")).alias(f"{f}_rate") for f in flags])
    out = named.join(sums, "_event", "left").drop("_event").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return out.withColumns({f"minutes_to_{f}": elapsed("minute", F.col("started_at"), F.col(f"first_{f}")) for f in flags})


def first_responses(df: DataFrame, logs: dict[str, tuple[DataFrame, str]], keys: list[str], ts: str, prefix: str = "response_", bucket: str | None = None) -> DataFrame:
    """df with the first entry of any of several logs at or after its time: `{prefix}at` and `{prefix}kind`, in one forward as-of pass.

    logs: name -> (rows with the keys, their time). Of logs with the same time the last name counts.
    """
    log = None
    for name, (rows, at) in logs.items():
        own = rows.select(*keys, F.col(at).alias("_entry"), F.lit(name).alias("kind"))
        log = own if log is None else log.unionByName(own)
    return asof_join(df, log, keys, ts, "_entry", ["kind"], direction="forward", tie="kind", prefix=prefix, bucket=bucket)


def detected_events(events: DataFrame, rows: DataFrame, logs: dict[str, tuple[DataFrame, str]], keys: list[str], ts: str, flag: str, alarm: str, **options) -> DataFrame:
    """Events that have rows, with when the flag and the alarm came, the shop's first response from the first row on, and the flag's lead over it in minutes."""
    x = event_credit(events, rows, keys, ts, [flag, alarm], **options).where("n_rows > 0")
    x = first_responses(x, logs, keys, "started_at")
    return x.withColumns({"detected": F.col(f"first_{flag}").isNotNull(), "lead_over_response": elapsed("minute", F.col(f"first_{flag}"), F.col("response_at"))})


def detection_summary(detected: DataFrame, flag: str) -> DataFrame:
    """One row: events, those detected, and the medians of minutes to the flag and of its lead."""
    return detected.agg(F.count(F.lit(1)).alias("events"), F.count_if("detected").alias("detected"), F.median(f"minutes_to_{flag}").alias("minutes_to_flag"), F.median("lead_over_response").alias("lead_over_response"))


def flagged_by_month(df: DataFrame, keys: list[str], month: Column, flag: str, validated: Column) -> DataFrame:
    """Flag rates by month, over all rows and over validated ones."""
    f = F.col(flag).cast("double")
    return df.groupBy(*keys, month.alias("month_ts")).agg(F.count(F.lit(1)).alias("n"), F.avg(f).alias("flag_rate"), F.avg(F.when(validated, f)).alias("false_rate"))


def overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how much of each flag the other covers."""
    both = F.count_if(F.col(a) & F.col(b)).cast("double")
    return df.agg(F.count_if(F.col(a) & F.col(b)).alias("both"), ratio(both, F.count_if(F.col(a))).alias(f"share_of_{a}"), ratio(both, F.count_if(F.col(b))).alias(f"share_of_{b}"))


def centred_median(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 301, least: int = 50, block: int = 20_000) -> DataFrame:
    """Value less the median of the `size` rows around it (an odd number), as `residual`; null where fewer than `least` of them have a value.

    A series is cut into blocks of rows with half a window of its neighbours on either side. Blocks are sorted and streamed
    with their window's values in order: a row costs one insertion and one removal, whatever the window's size, and a task
    holds a window and a batch. NaN counts as no value.
    """
    half = size // 2
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    x = df.withColumn("_no", F.row_number().over(series(keys, order)).cast("long"))
    beside = F.sequence(F.greatest(F.lit(0), F.floor((F.col("_no") - 1 - half) / block)), F.floor((F.col("_no") - 1 + half) / block))
    names = [f"_k{i}" for i in range(len(keys))]
    laid = x.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_no", F.col(value).cast("double").alias("_v"), F.explode(beside).alias("_block"))

    def medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows, window, due = None, deque(), [], 0  # rows of the window in order of number, its values by size

        def middle() -> float | None:
            n = len(window)
            return None if n < least or not n else window[n // 2] if n % 2 else (window[n // 2 - 1] + window[n // 2]) / 2

        def passed(upto: int, out: list) -> None:
            """Put out the rows whose window is whole: those half a window before `upto`."""
            nonlocal due
            while due < upto:
                while rows and rows[0][0] < due - half:
                    v = rows.popleft()[1]
                    if v is not None:
                        del window[bisect_left(window, v)]
                if due > part[-1] * block and due <= (part[-1] + 1) * block:
                    out.append((*part[:-1], due, middle()))
                due += 1

        last = 0
        for batch in batches:
            out: list = []
            for row in zip(*(batch[c].tolist() for c in [*names, "_block", "_no", "_v"]), strict=True):
                own, number, v = row[:-2], row[-2], None if row[-1] is None or row[-1] != row[-1] else row[-1]
                if own != part:
                    if part is not None:
                        passed(last + 1, out)
                    part, due = own, number
                    rows.clear()
                    window.clear()
                passed(number - half, out)
                rows.append((number, v))
                if v is not None:
                    insort(window, v)
                last = number
            yield pd.DataFrame(out, columns=[*names, "_no", "_m"])
        if part is not None:
            out = []
            passed(last + 1, out)
            yield pd.DataFrame(out, columns=[*names, "_no", "_m"])

    schema = ", ".join([*(f"{n} {kinds[k]}" for k, n in zip(keys, names, strict=True)), "_no long, _m double"])
    found = laid.repartition(*names, "_block").sortWithinPartitions(*names, "_block", "_no").mapInPandas(medians, schema).withColumnRenamed("_no", "_at")
    on = F.col("_no") == F.col("_at")
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return x.join(found, on, "left").withColumn("residual", F.col(value) - F.col("_m")).drop("_no", "_at", "_m", *names)


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, weight: float = 0.2, depth: int = 100) -> DataFrame:
    """Exponential smoothing from the first value on, as `trend`; what is `depth` rows back weighs (1 - weight) ** depth."""
    w = series(keys, order)
    last = F.collect_list(value).over(w.rowsBetween(1 - depth, 0))
    x = df.withColumn("_last", last)
    fold = F.aggregate("_last", F.get("_last", F.lit(0)), lambda s, v: (1 - weight) * s + weight * v)
    return x.withColumn("trend", fold).drop("_last")


def reference_row(df: DataFrame, keys: list[str], position: str, value: str, template: str, row_id: str, first: int, last: int) -> DataFrame:
    """Per key, the row within the positions whose value is nearest its template (ties: the smallest id), and the medians of the era."""
    own = df.where(F.col(position).between(first, last))
    return own.groupBy(*keys).agg(F.min_by(row_id, F.struct(F.abs(F.col(value) - F.col(template)), F.col(row_id))).alias("reference"), F.median(value).alias("era_median"), F.count(F.lit(1)).alias("n"))


def timeline(df: DataFrame, keys: list[str], position: str, flag: str, width: int = 100) -> DataFrame:
    """Flags per `width` rows of each series."""
    return df.groupBy(*keys, F.floor((F.col(position) - 1) / width).alias("bin")).agg(F.count_if(F.col(flag)).alias("n_flags"), F.count(F.lit(1)).alias("n"))


def before_after_ratio(df: DataFrame, keys: list[str], event: Column, value: str) -> DataFrame:
    """Per key, spread and mean before and from an event on: ratio of spreads, mean shift over the spread before."""
    on = lambda c: F.when(c, F.col(value))
    x = df.groupBy(*keys).agg(F.stddev_samp(on(~event)).alias("s0"), F.stddev_samp(on(event)).alias("s1"), F.avg(on(~event)).alias("m0"), F.avg(on(event)).alias("m1"))
    return x.select(*keys, ratio(F.col("s1"), F.col("s0")).alias("spread_ratio"), ratio(F.col("m1") - F.col("m0"), F.col("s0")).alias("mean_shift"))


def demeaned_correlation(df: DataFrame, keys: list[str], unit: str, a: str, b: str) -> DataFrame:
    """Per key, the correlation of two values after each unit's means are taken off."""
    w = Window.partitionBy(*keys, unit)
    x = df.withColumns({"_a": F.col(a) - F.avg(a).over(w), "_b": F.col(b) - F.avg(b).over(w)})
    return x.groupBy(*keys).agg((F.covar_samp("_a", "_b") / F.nullif(F.stddev_samp("_a") * F.stddev_samp("_b"), F.lit(0.0))).alias("r"), F.count(F.lit(1)).alias("n"))


def seed_average(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(measure).alias("mean"), F.stddev_samp(measure).alias("sd"), F.count(F.lit(1)).alias("n"))


def with_total_row(df: DataFrame, index: str, column: str, values: list[str], qty: Column) -> DataFrame:
    """Pivot with a column per value, 0 where there is none, and the row's total."""
    x = df.groupBy(index).pivot(column, values).agg(F.sum(qty)).fillna(0.0, values)
    return x.withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`")))


def running_share(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    w = series(keys, order).rowsBetween(START, 0)
    return df.withColumn("running_share", F.avg(F.col(flag).cast("double")).over(w))
