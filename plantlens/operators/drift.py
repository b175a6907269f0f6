"""Drift detection: resets, EWMA, block and variance CUSUM, re-arming, step tests.

Recurrences whose state depends on the data (CUSUM, re-arming) stream over sorted partitions with one state a series,
after the rows have been thinned to blocks or excursions; the others are windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import wilson
from .windows import START, filled, rolling_spread, trailing_mean


def resets(df: DataFrame, keys: list[str], order: list[str], changed: tuple[str, ...] = (), dropped: dict[str, float] | None = None, into: str = "reset") -> DataFrame:
    """Where a series starts anew: a column differs from the row before (null is a value), or a counter falls by more than given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hit = F.lit(False)
    for c in changed:
        hit = hit | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    for c, by in (dropped or {}).items():
        hit = hit | F.coalesce(F.col(c) - F.lag(c).over(w) < -by, F.lit(False))
    return df.withColumn(into, hit & (F.row_number().over(w) > 1))


def segments(df: DataFrame, keys: list[str], order: list[str], reset: str = "reset", into: str = "segment") -> DataFrame:
    return df.withColumn(into, F.sum(F.col(reset).cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(START, 0)))


def ewma(df: DataFrame, keys: list[str], order: list[str], value: str, reset: str = "reset", weight: float = 0.2, baseline: int = 500, limit: float = 3.5, lost: float = 1e-9) -> DataFrame:
    """Exponentially weighted mean that restarts at a reset, its limits from the first `baseline` rows, and the signal.

    The value is carried over nulls, then 0. A series begins at the mean of the baseline's values, a segment at its first
    value. So many rows of a segment count that what is before them weighs less than `lost`.
    """
    depth = math.ceil(math.log(lost) / math.log(1 - weight))
    w = Window.partitionBy(*keys).orderBy(*order)
    x = segments(df, keys, order, reset, "_segment").withColumn("_no", F.row_number().over(w))
    x = x.withColumn("_x", F.coalesce(filled(F.col(value), w), F.lit(0.0)))
    whole = Window.partitionBy(*keys)
    x = x.withColumn("_start", F.coalesce(F.avg(F.when(F.col("_no") <= baseline, F.col(value))).over(whole), F.lit(0.0)))
    own = Window.partitionBy(*keys, "_segment").orderBy(*order)
    x = x.withColumns({"_in": F.row_number().over(own), "_last": F.collect_list("_x").over(own.rowsBetween(1 - depth, 0))})
    first = F.when(F.col("_in") > depth, F.get("_last", F.lit(0))).when(F.col("_segment") == 0, F.col("_start")).otherwise(F.get("_last", F.lit(0)))
    fold = F.aggregate("_last", first, lambda s, v: (1 - weight) * s + weight * v)
    x = x.withColumn("ewma", fold)
    base = F.when(F.col("_no") <= baseline, F.col("ewma"))
    x = x.withColumns({"ewma_mean": F.avg(base).over(whole), "_sd": F.stddev_pop(base).over(whole)})
    sd = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return x.withColumn("ewma_sd", sd).withColumn("ewma_signal", F.abs(F.col("ewma") - F.col("ewma_mean")) > limit * F.col("ewma_sd")).drop("_segment", "_no", "_x", "_start", "_in", "_last", "_sd")


def block_z(df: DataFrame, keys: list[str], order: list[str], value: str, block: int = 25, least: int = 12, baseline: int = 500, least_blocks: int = 4) -> DataFrame:
    """One row per block: z of its mean against the blocks of the baseline; reset if any of its rows was one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(1 - block, 0)
    x = df.withColumns({"_pos": F.row_number().over(w) - 1, "block_mean": F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame)), "reset": F.coalesce(F.max("reset").over(frame), F.lit(False))})
    whole = Window.partitionBy(*keys)
    ref = F.when((F.col("_pos") % block == 0) & (F.col("_pos") > 0) & (F.col("_pos") < baseline), F.col("block_mean"))
    x = x.withColumns({"_n": F.count(ref).over(whole), "_mean": F.avg(ref).over(whole), "_sd": F.stddev_pop(ref).over(whole)})
    sd = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    z = F.when(F.col("_n") >= least_blocks, (F.col("block_mean") - F.col("_mean")) / sd)
    return x.withColumn("z", z).where(F.col("_pos") % block == block - 1).drop("_n", "_mean", "_sd", "_pos")


def streamed(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str, step: Callable) -> DataFrame:
    """Each series' rows in order through step(state, order, *columns) -> (state, row or None); a series starts with state None.

    `out` is the schema of the rows, which get the keys before them. Partitions are sorted and streamed: a task holds a
    batch of rows and one state, however long a series is.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), out])
    names, read = [c.split(" ")[0] for c in schema.split(", ")], [*keys, order, *columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series = state = None
        for batch in batches:
            rows = []
            for row in zip(*(batch[c].tolist() for c in read), strict=True):
                if row[: len(keys)] != series:
                    series, state = row[: len(keys)], None
                state, got = step(state, *row[len(keys) :])
                if got is not None:
                    rows.append((*series, *got))
            yield pd.DataFrame(rows, columns=names)

    return df.select(*read).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def cusum(blocks: DataFrame, keys: list[str], order: str, z: str = "z", k: float = 0.375, h: float = 5.0, side: int = 1, into: str = "cusum") -> DataFrame:
    """One-sided CUSUM over a series' blocks, zero after a signal and at a reset; a null z leaves the sum as it is.

    `{into}_held` is the sum that goes on from there: 0 after a signal.
    """

    def step(state: float | None, at: int, value: float, reset: bool) -> tuple[float, tuple]:
        s = 0.0 if state is None or reset else state
        if pd.isna(value):
            return s, (at, s, False, s)
        s = max(0.0, s + side * value - k)
        held = 0.0 if s > h else s
        return held, (at, s, s > h, held)

    kind = blocks.schema[order].dataType.simpleString()
    return streamed(blocks.withColumn(z, F.col(z).cast("double")), keys, order, [z, "reset"], f"{order} {kind}, {into} double, {into}_signal boolean, {into}_held double", step)


def two_sided(blocks: DataFrame, keys: list[str], order: str, z: str = "z", k: float = 0.375, h: float = 5.0, into: str = "cusum") -> DataFrame:
    """The CUSUMs of both sides in one pass: the larger sum, a signal of either, and the larger sum that goes on."""

    def step(state: tuple[float, float] | None, at: int, value: float, reset: bool) -> tuple[tuple[float, float], tuple]:
        sums = (0.0, 0.0) if state is None or reset else state
        if not pd.isna(value):
            sums = tuple(max(0.0, s + side * value - k) for s, side in zip(sums, (1, -1), strict=True))
        fired = not pd.isna(value) and max(sums) > h
        held = tuple(0.0 if s > h else s for s in sums)
        return held, (at, max(sums), fired, max(held))

    kind = blocks.schema[order].dataType.simpleString()
    return streamed(blocks.withColumn(z, F.col(z).cast("double")), keys, order, [z, "reset"], f"{order} {kind}, {into} double, {into}_signal boolean, {into}_held double", step)


def carried(df: DataFrame, keys: list[str], order: list[str], into: str, reset: str = "reset") -> DataFrame:
    """df with the statistic `into` of every row: the reading's where there is one, else the sum held since, 0 after a reset and before any reading.

    Rows with a reading have `{into}_held`, which is dropped.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(START, 0)
    x = df.withColumn("_at", F.row_number().over(w))
    x = x.withColumns({"_reset": F.max(F.when(F.col(reset), F.col("_at"))).over(upto), "_read": F.last(F.when(F.col(f"{into}_held").isNotNull(), F.struct(F.col("_at").alias("at"), F.col(f"{into}_held").alias("held"))), ignorenulls=True).over(upto)})
    held = F.when(F.col("_reset").isNull() | (F.col("_read.at") >= F.col("_reset")), F.col("_read.held"))
    return x.withColumn(into, F.coalesce(F.col(into), held, F.lit(0.0))).drop("_at", "_reset", "_read", f"{into}_held")


def log_spread(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 200, least: int = 100, first: int = 100, last: int = 500, every: int = 50) -> DataFrame:
    """Every `every`-th row: log of the rolling spread over the median of the baseline's.

    Rows go to the readings that they are within, some `size` / `every` of them; a spread at every row is made for the baseline alone.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_pos", F.row_number().over(w) - 1)
    early = x.where(F.col("_pos") < last).withColumn("_spread", rolling_spread(F.col(value), w, size, least))
    base = early.where(F.col("_pos") >= first).groupBy(*keys).agg(F.median("_spread").alias("_base"))
    own = F.floor(F.col("_pos") / every)
    within = x.select(*keys, value, "_pos", F.explode(F.sequence(own, F.greatest(own, F.floor((F.col("_pos") + size - every) / every)))).alias("_reading"))
    within = within.where(F.col("_pos") >= (F.col("_reading") + 1) * every - size)
    spreads = within.groupBy(*keys, "_reading").agg(F.count(value).alias("_n"), F.stddev_samp(value).alias("_sd"))
    x = x.where(F.col("_pos") % every == every - 1).withColumn("_reading", own).join(spreads, [*keys, "_reading"]).join(base, keys, "left")
    x = x.withColumn("spread", F.when(F.col("_n") >= least, F.col("_sd")))
    z = F.when((F.col("spread") > 0) & (F.col("_base") > 0), F.log(F.col("spread") / F.col("_base")))
    return x.withColumn("z", z).drop("_pos", "_base", "_reading", "_n", "_sd")


def rearmed(df: DataFrame, keys: list[str], order: list[str], signal: str, reset: str = "reset", rearm: int = 3000) -> DataFrame:
    """Rows where a detector fires: starts of signal runs at least `rearm` rows after the last kept start, or after a reset since.

    Only a series' run starts, which are few, go through the stream.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumns({"position": F.row_number().over(w) - 1, "_run": F.sum(F.col(reset).cast("int")).over(w.rowsBetween(START, 0))})
    starts = x.withColumn("_start", F.col(signal) & ~F.coalesce(F.lag(signal).over(w), F.lit(False))).where("_start")

    def step(state: tuple[int, int] | None, position: int, run: int) -> tuple[tuple[int, int], tuple | None]:
        if state is None or position - state[0] >= rearm or run > state[1]:
            return (position, run), (position,)
        return state, None

    return streamed(starts, keys, "position", ["_run"], "position int", step)


def kept_signals(df: DataFrame, keys: list[str], order: list[str], detectors: list[str], reset: str = "reset", rearm: int = 3000) -> DataFrame:
    """df with the signals of all detectors re-armed: `{d}_signal` stays on in kept runs only, `{d}_fire` marks their starts.

    Only rows on which some detector signals go through the stream.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumns({"_position": F.row_number().over(w) - 1, "_run": F.sum(F.col(reset).cast("int")).over(w.rowsBetween(START, 0))})
    signals = [f"{d}_signal" for d in detectors]
    hot = x.where(F.greatest(*[F.col(c).cast("int") for c in signals], F.lit(0)) > 0)

    def step(state: dict | None, position: int, run: int, *on: bool) -> tuple[dict, tuple]:
        """state: detector -> (position and resets at the last kept start, position of the last signal, whether its run is kept)."""
        state, row = dict(state or {}), [position]
        for k, signal in enumerate(on):
            at, resets_, last, kept = state.get(k, (None, 0, -2, False))
            fire = False
            if signal:
                if last != position - 1:
                    fire = kept = at is None or position - at >= rearm or run > resets_
                    at, resets_ = (position, run) if fire else (at, resets_)
                state[k] = (at, resets_, position, kept)
            row += [signal and kept, fire]
        return state, tuple(row)

    out = "_position int, " + ", ".join(f"_{d}_kept boolean, _{d}_fire boolean" for d in detectors)
    x = x.join(streamed(hot, keys, "_position", ["_run", *signals], out, step), [*keys, "_position"], "left")
    on = {f"{d}_signal": F.coalesce(f"_{d}_kept", F.lit(False)) for d in detectors} | {f"{d}_fire": F.coalesce(f"_{d}_fire", F.lit(False)) for d in detectors}
    return x.withColumns(on).drop("_position", "_run", *[f"_{d}_{c}" for d in detectors for c in ("kept", "fire")])


def first_signals(df: DataFrame, keys: list[str], order: list[str], fired: list[str], segment: str = "segment") -> DataFrame:
    """The first row of each series, segment and detector that fired."""
    long = df.unpivot([*keys, segment, *order], fired, "detector", "fired").where("fired")
    w = Window.partitionBy(*keys, segment, "detector").orderBy(*order)
    return long.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "fired")


def step_test(near: DataFrame, event: list[str], value: str, least: int = 50, inflation: float = 8.0) -> DataFrame:
    """One row per event from its nearest rows by side: step, spread over both sides, and t widened for autocorrelation."""
    on = lambda side: F.when(F.col("side") == side, F.col(value))
    x = near.groupBy(*event).agg(F.count(on("before")).alias("n_before"), F.count(on("after")).alias("n_after"), F.avg(on("before")).alias("mean_before"), F.avg(on("after")).alias("mean_after"), F.stddev_samp(value).alias("sd"))
    x = x.where((F.col("n_before") >= least) & (F.col("n_after") >= least))
    step = F.col("mean_after") - F.col("mean_before")
    scale = F.col("sd") * F.sqrt(inflation * (1 / F.col("n_before") + 1 / F.col("n_after")))
    return x.withColumns({"step": step, "t": step / F.nullif(scale, F.lit(0.0))})


def relative_steps(near: DataFrame, event: list[str], value: str, rows: int) -> DataFrame:
    """One row per event with whole windows: the mean after it over the mean before, less 1."""
    on = lambda side: F.when(F.col("side") == side, F.col(value))
    x = near.groupBy(*event).agg(F.count(on("before")).alias("_b"), F.count(on("after")).alias("_a"), F.avg(on("before")).alias("_mb"), F.avg(on("after")).alias("_ma"))
    return x.where((F.col("_b") == rows) & (F.col("_a") == rows)).select(*event, (F.col("_ma") / F.nullif(F.col("_mb"), F.lit(0.0)) - 1).alias("step"))


def local_steps(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 300) -> DataFrame:
    """At each row, the mean of the rows from it on less that of the rows before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("step", F.avg(value).over(w.rowsBetween(0, rows - 1)) - trailing_mean(F.col(value), w, rows, 1))


def step_response(df: DataFrame, keys: list[str], order: list[str], changed: Column, value: str, fire: str, rows: int = 300, within: int = 500) -> DataFrame:
    """Changes with whole windows: the step of the value over `rows` on each side, and how many rows until the detector fires, within the window.

    `changed` marks the first row of each change; changes with fewer rows before, or less than the window after, are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    x = local_steps(df.withColumn("_no", F.row_number().over(w) - 1), keys, order, value, rows)
    ahead = w.rowsBetween(0, within - 1)
    x = x.withColumns({"_changed": changed & (F.col("_no") > 0), "_fired": F.min(F.when(F.col(fire), F.col("_no"))).over(ahead), "_ahead": F.count(F.lit(1)).over(ahead)})
    x = x.where(F.col("_changed") & (F.col("_no") >= rows) & (F.col("_ahead") == within))
    return x.withColumns({"fired": F.col("_fired").isNotNull(), "rows_to_fire": F.col("_fired") - F.col("_no")}).drop("_no", "_changed", "_fired", "_ahead")


def fired_shares(responses: DataFrame, step: float, no_step: float) -> DataFrame:
    """Two rows: how many changes with a step, and without, the detector fired on, with Wilson intervals; those between are left out."""
    size = F.abs(F.col("step"))
    x = responses.withColumn("stepped", F.when(size >= step, True).when(size < no_step, False)).where("stepped is not null")
    x = x.groupBy("stepped").agg(F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("fired"), F.median("rows_to_fire").alias("median_rows"))
    low, high = wilson(F.col("fired"), F.col("n"))
    return x.withColumns({"share": F.col("fired") / F.col("n"), "low": low, "high": high})
