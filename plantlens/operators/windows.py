"""Window operators on series: trailing statistics, persistence, episodes, counters around events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def series(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str = "point_no", bucket: str | None = None) -> DataFrame:
    """Row numbers of each series, from 1.

    With `bucket` (a unit of date_trunc, applied to the first of `order`) rows are numbered within key and bucket, and the
    rows of earlier buckets are added from a table of counts, so that no task orders a whole key. df is read twice.
    """
    if bucket is None:
        return df.withColumn(into, F.row_number().over(series(keys, order)))
    x = df.withColumn("_bucket", F.date_trunc(bucket, F.col(order[0])))
    counts = x.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(START, -1)
    before = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    on = F.col("_bucket").eqNullSafe(F.col("_at"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = F.row_number().over(series([*keys, "_bucket"], order))
    return x.withColumn(into, own).join(before, on).withColumn(into, F.col(into) + F.col("_before")).drop("_bucket", "_at", "_before", *[f"_{k}" for k in keys])


def counted(log: DataFrame, rows: DataFrame, keys: list[str], log_ts: str, ts: str, into: str, bucket: str) -> DataFrame:
    """log with the number of `rows` of its keys at or before its time: 0 before any, and where a key or the time is null.

    Counts run within key and bucket (a unit of date_trunc); those of earlier buckets are added from a table of counts.
    """
    marks = rows.select(*keys, F.col(ts).alias("_ts"), F.lit(1).cast("long").alias("_n"), F.lit(None).alias("_log"))
    both = marks.unionByName(log.select(*keys, F.col(log_ts).alias("_ts"), F.lit(0).cast("long").alias("_n"), F.struct(*log.columns).alias("_log"))).withColumn("_bucket", F.date_trunc(bucket, F.col("_ts")))
    part = [*keys, "_bucket"]
    own = F.sum("_n").over(Window.partitionBy(*part).orderBy("_ts", F.col("_n").desc()).rowsBetween(START, 0))
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(START, -1)
    before = both.where("_bucket is not null").groupBy(*part).agg(F.sum("_n").alias("_n")).select(*part, F.sum("_n").over(along).alias("_before"))
    x = both.withColumn("_own", own).where("_log is not null").join(before, part, "left")
    known = F.col("_bucket").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    return x.select("_log.*", F.when(known, F.col("_own") + F.coalesce("_before", F.lit(0))).otherwise(0).alias(into))


def trailing_mean(value: Column, w, before: int, least: int) -> Column:
    """Mean of the `before` rows before this one, null with fewer than `least` values."""
    frame = w.rowsBetween(-before, -1)
    return F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))


#: Running sums of a series: of three parts of each value, of how many there are, and of those at infinity or NaN (both).
RUNNING = ("_coarse", "_middle", "_fine", "_n", "_up", "_down")


def running(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """df with RUNNING over all rows before each one.

    A value's parts are multiples of 2^-10, of 2^-35 (under 2^-11) and what is left. Doubles add them without rounding while
    the sums are under 2^43 and 2^18, and the last part's as well unless values are under 2^-8. So differences of these sums
    are a frame's sums as if it had been added up alone, and a constant series has exactly its value as mean.
    """
    v = F.col(value).cast("double")
    infinite = F.lit(float("inf"))
    whole = F.when((v < infinite) & (v > -infinite), v)
    coarse = F.when(F.abs(whole) < 2.0**42, F.rint(whole * 2.0**10) / 2.0**10).otherwise(whole)
    middle = F.rint((whole - coarse) * 2.0**35) / 2.0**35
    parts = dict(zip(RUNNING, (coarse, middle, whole - coarse - middle), strict=False))
    counts = {"_n": v.isNotNull(), "_up": v >= infinite, "_down": (v == -infinite) | F.isnan(v)}
    before = series(keys, order).rowsBetween(START, -1)
    sums = {k: F.coalesce(F.sum(c).over(before), F.lit(0.0)) for k, c in parts.items()}
    return df.withColumns(sums | {k: F.count(F.when(c, 1)).over(before) for k, c in counts.items()})


def recent(w, rows: int) -> dict[str, Column]:
    """Mean and count of the `rows` before each one, from the sums of `running`: a difference of two rows, however many lie between."""
    since = {k: F.col(k) - F.coalesce(F.lag(k, rows).over(w), F.lit(0)) for k in RUNNING}
    n, up, down = since["_n"], since["_up"] > 0, since["_down"] > 0
    mean = since["_coarse"] / n + since["_middle"] / n + since["_fine"] / n
    mean = F.when(up & down, float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(mean)
    return {"recent_mean": F.when(n > 0, mean), "recent_n": n}


def trailing_change(df: DataFrame, keys: list[str], order: list[str], values: list[str], before: int = 300, least: int = 50) -> DataFrame:
    """Each value less its trailing mean, as `{value}_change`."""
    w = series(keys, order)
    return df.withColumns({f"{v}_change": F.col(v) - trailing_mean(F.col(v), w, before, least) for v in values})


def rolling_spread(value: Column, w, size: int, least: int) -> Column:
    frame = w.rowsBetween(1 - size, 0)
    return F.when(F.count(value).over(frame) >= least, F.stddev_samp(value).over(frame))


def k_of_n(df: DataFrame, keys: list[str], order: list[str], flag: str, k: int = 2, n: int = 10, into: str = "persistent") -> DataFrame:
    """Whether at least k of the last n rows, this one included, are flagged."""
    return df.withColumn(into, F.sum(F.col(flag).cast("int")).over(series(keys, order).rowsBetween(1 - n, 0)) >= k)


def rising(df: DataFrame, keys: list[str], order: list[str], flag: str, into: str = "rising") -> DataFrame:
    """Whether a flag goes on here."""
    return df.withColumn(into, F.col(flag) & ~F.coalesce(F.lag(flag).over(series(keys, order)), F.lit(False)))


def episodes(df: DataFrame, keys: list[str], order: list[str], flag: str, gap: int = 30) -> DataFrame:
    """Flagged rows with their position, whether an episode starts, and its number; a gap of `gap` positions parts two."""
    w = series(keys, order)
    hits = df.withColumn("position", F.row_number().over(w)).where(F.col(flag))
    start = F.coalesce(F.col("position") - F.lag("position").over(w) >= gap, F.lit(True))
    hits = hits.withColumn("starts", start)
    return hits.withColumn("episode", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(START, 0)))


def around(df: DataFrame, keys: list[str], order: list[str], after: str, into: str = "counter", bucket: str | None = None) -> DataFrame:
    """Counter around an event: 0, 1, 2 ... from it on, -1, -2 ... before it; rows without an event count by themselves.

    With `bucket` rows are numbered as in `numbered`, and counted down from how many there are. df is read twice.
    """
    if bucket is not None:
        own = [*keys, after]
        totals = df.groupBy(*[F.col(k).alias(f"_{k}") for k in own]).agg(F.count(F.lit(1)).alias("_all"))
        x = numbered(df, own, order, "_up", bucket)
        on = F.lit(True)
        for k in own:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        x = x.join(totals, on)
        return x.withColumn(into, F.when(F.col(after), F.col("_up") - 1).otherwise(F.col("_up") - F.col("_all") - 1)).drop("_up", "_all", *[f"_{k}" for k in own])
    up = F.row_number().over(Window.partitionBy(*keys, after).orderBy(*order)) - 1
    down = -F.row_number().over(Window.partitionBy(*keys, after).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn(into, F.when(F.col(after), up).otherwise(down))


def filled(value: Column, w) -> Column:
    """The last value that isn't null."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(START, 0))


def rolling_rms_trigger(df: DataFrame, keys: list[str], order: list[str], z: str, limit: float, size: int = 200, least: int = 100, hold: int = 400) -> DataFrame:
    """Rolling root mean square of z, and whether it was over the limit in all of the last `hold` rows."""
    w = series(keys, order)
    frame = w.rowsBetween(1 - size, 0)
    x = df.withColumn("rolling_rms", F.when(F.count(z).over(frame) >= least, F.sqrt(F.avg(F.col(z) * F.col(z)).over(frame))))
    over = F.coalesce(F.col("rolling_rms") > limit, F.lit(False)).cast("int")
    held = w.rowsBetween(1 - hold, 0)
    return x.withColumn("triggered", (F.sum(over).over(held) == hold) & (F.count(F.lit(1)).over(held) == hold))


def _placed(df: DataFrame, events: DataFrame, keys: list[str], ts: str, event_ts: str, event_id: str) -> DataFrame:
    """keys, event_id and _from: how many rows of its series are before each event."""
    marks = df.select(*keys, F.col(ts).alias("_ts"), F.lit(1).alias("_n"), F.lit(None).cast("long").alias("_event")).unionByName(events.select(*keys, F.col(event_ts).alias("_ts"), F.lit(0).alias("_n"), F.col(event_id).cast("long").alias("_event")))
    passed = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_ts", "_n").rowsBetween(START, 0)), F.lit(0))
    return marks.withColumn("_passed", passed).where("_event is not null").select(*keys, F.col("_event").alias(event_id), F.col("_passed").alias("_from"))


def nearest_rows(df: DataFrame, events: DataFrame, keys: list[str], ts: str, order: str, event_ts: str, event_id: str, each: int) -> DataFrame:
    """Rows among the `each` nearest before and from each event on: event_id, side, and the row.

    Rows are numbered once; an event becomes a row number by a count, and its rows are an equi-join on the key and the
    number's bucket of `each` rows, so that no series is joined with itself.
    """
    rows = numbered(df, keys, [ts, order], "_no")
    placed = _placed(df, events, keys, ts, event_ts, event_id)
    spread = placed.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col("_from") - each + 1) / each), F.floor((F.col("_from") + each) / each))))
    joined = rows.withColumn("_bucket", F.floor(F.col("_no") / each)).join(spread, [*keys, "_bucket"])
    near = joined.where((F.col("_no") > F.col("_from") - each) & (F.col("_no") <= F.col("_from") + each))
    return near.withColumn("side", F.when(F.col("_no") <= F.col("_from"), "before").otherwise("after")).drop("_bucket", "_no", "_from")


def around_events(df: DataFrame, events: DataFrame, keys: list[str], ts: str, order: str, event_ts: str, event_id: str, each: int, values: list[str], head: list[str]) -> DataFrame:
    """One row per event from the `each` nearest rows before and from it on, as nearest_rows has them, without a row for each of them.

    event_id, n_before, n_after, `head` of the first row after, and per value its means `{v}_before`, `{v}_after` and its
    spread `{v}_sd` over both sides. Rows go to their block of `each` and the blocks beside it, so a row is sent three times
    however many events are near it.
    """
    rows = numbered(df, keys, [ts, order], "_no").select(*keys, "_no", *head, *[F.col(v).cast("double").alias(v) for v in values])
    placed = _placed(df, events, keys, ts, event_ts, event_id).withColumn("_block", F.floor(F.col("_from") / each))
    own = F.floor(F.col("_no") / each)
    dealt = rows.withColumn("_block", F.explode(F.array(own - 1, own, own + 1))).join(placed.select(*keys, "_block").distinct(), [*keys, "_block"], "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"{event_id} long, n_before long, n_after long", *(f"{c} {kinds[c]}" for c in head), *(f"{v}_before double, {v}_after double, {v}_sd double" for v in values)])
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def mean(x: np.ndarray) -> float | None:
        return x.mean() if len(x) else None

    def near(block: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_no")
        number, out = block["_no"].to_numpy(), []
        columns = {v: block[v].to_numpy(dtype="float64") for v in values}
        for event, at in zip(marks[event_id].tolist(), marks["_from"].tolist(), strict=True):
            low, middle, high = np.searchsorted(number, (at - each, at, at + each), side="right")
            row = [event, middle - low, high - middle, *(block[c].iloc[middle] if middle < high else None for c in head)]
            for x in columns.values():
                before, after = (y[~np.isnan(y)] for y in (x[low:middle], x[middle:high]))
                both = np.concatenate([before, after])
                row += [mean(before), mean(after), both.std(ddof=1) if len(both) > 1 else None]
            out.append(row)
        return pd.DataFrame(out, columns=names)

    marked = placed.select(event_id, "_from", *[F.col(c).alias(f"_own_{c}") for c in (*keys, "_block")])
    return dealt.groupBy(*keys, "_block").cogroup(marked.groupBy(*[f"_own_{c}" for c in (*keys, "_block")])).applyInPandas(near, schema)
