"""As-of joins: each left row with the right row in force at its time, by one window pass over a tagged union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch
from .windows import counted, numbered

START = Window.unboundedPreceding


def _no_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _union(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], tie: str | None) -> DataFrame:
    """Rows of both sides: keys, _ts, _side (0 right, 1 left), _tie, _right (null for left rows), _left (null for right rows)."""
    payload = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in columns])
    r = right.where(_no_null(keys) & F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(0)).alias("_tie"), payload.alias("_right"))
    return left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"), F.struct(*left.columns).alias("_left")).unionByName(r, allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], direction: str = "backward", tolerance_s: float | None = None, tie: str | None = None, prefix: str = "", bucket: str | None = None) -> DataFrame:
    """left with `columns` of the right row in force, and its time as `{prefix}at`.

    backward: the latest right row at or before the left row's time, forward: the earliest at or after; of equal times
    the one with the largest `tie`. No match, a null key or time, or a gap over tolerance_s gives nulls. One shuffle on
    the keys; with `bucket` (a unit of date_trunc) it is on keys and bucket, and what was in force at a bucket's edge is
    carried over a table of one row a bucket, so that a key that holds most rows is worked on by many tasks.
    """
    back = direction == "backward"
    both = _union(left, right, keys, left_ts, right_ts, columns, tie)
    time, edge = F.col("_ts") if back else F.col("_ts").desc(), F.col("_tie").asc_nulls_first()
    part = list(keys)
    if bucket:
        both = both.withColumn("_bucket", F.date_trunc(bucket, F.col("_ts")))
        part.append("_bucket")
    seen = F.last("_right", ignorenulls=True).over(Window.partitionBy(*part).orderBy(time, "_side", edge).rowsBetween(START, 0))
    out = both.withColumn("_hit", seen).where("_side = 1")
    if bucket:
        micros = F.unix_micros(F.col("_ts").cast("timestamp"))
        rights = both.where("_side = 0").groupBy(*part).agg(F.max_by("_right", F.struct((micros if back else -micros).alias("t"), F.col("_tie"))).alias("_edge"))
        grid = both.where("_side = 1").select(*part).distinct().join(rights, part, "full")
        along = Window.partitionBy(*keys).orderBy(F.col("_bucket") if back else F.col("_bucket").desc()).rowsBetween(START, -1)
        carry = grid.withColumn("_carry", F.last("_edge", ignorenulls=True).over(along)).drop("_edge")
        out = out.join(carry, part, "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    ok = _no_null(keys) & F.col("_ts").isNotNull()
    if tolerance_s is not None:
        ok = ok & (F.abs(epoch(F.col("_hit._at")) - epoch(F.col("_ts"))) <= tolerance_s)
    hit = lambda c: F.when(ok, F.col(f"_hit.{c}"))
    return out.select("_left.*", hit("_at").alias(f"{prefix}at"), *[hit(c).alias(f"{prefix}{c}") for c in columns])


def asof_fused(left: DataFrame, log: DataFrame, keys: list[str], left_ts: str, log_ts: str, kind: str, kinds: list[str], columns: list[str], tie: str | None = None, bucket: str | None = None, number: tuple[str, str] | None = None) -> DataFrame:
    """left with, for each kind of logged event, `{kind}_{column}` and `{kind}_at` of the last one, all in one window pass.

    With `bucket` (a unit of date_trunc) rows are ordered within key and bucket only; the last event of each kind before a
    bucket comes from a table of one row a key and bucket, so a key that holds most rows is worked on by many tasks.
    `number` (a column that orders left rows of one time, a name) adds the row's number in its key, from 1, in the same
    pass; null where a key or the time is.
    """
    both = _union(left, log.where(F.col(kind).isin(kinds)), keys, left_ts, log_ts, [kind, *columns], tie)
    part = list(keys)
    if bucket:
        both = both.withColumn("_bucket", F.date_trunc(bucket, F.col("_ts")))
        part.append("_bucket")
    own = {k: F.when(F.col(f"_right.{kind}") == k, F.col("_right")) for k in kinds}
    row = [F.col(f"_left.{number[0]}")] if number else []
    w = Window.partitionBy(*part).orderBy("_ts", "_side", F.col("_tie").asc_nulls_first(), *row).rowsBetween(START, 0)
    passed = {"_passed": F.sum(F.when(F.col("_ts").isNotNull(), F.col("_side").cast("long"))).over(w)} if number else {}
    out = both.withColumns({f"_last_{k}": F.last(v, ignorenulls=True).over(w) for k, v in own.items()} | passed).where("_side = 1")
    if bucket:
        at = F.struct(F.unix_micros(F.col("_ts").cast("timestamp")).alias("t"), F.col("_tie"))
        count = [F.sum(F.col("_side").cast("long")).alias("_n")] if number else []
        edges = both.where("_bucket is not null").groupBy(*part).agg(*[F.max_by(v, F.when(v.isNotNull(), at)).alias(f"_edge_{k}") for k, v in own.items()], *count)
        along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(START, -1)
        carry = edges.select(*part, *[F.last(f"_edge_{k}", ignorenulls=True).over(along).alias(f"_carry_{k}") for k in kinds], *([F.sum("_n").over(along).alias("_before")] if number else []))
        out = out.join(carry, part, "left").withColumns({f"_last_{k}": F.coalesce(f"_last_{k}", f"_carry_{k}") for k in kinds})
        if number:
            out = out.withColumn("_passed", F.col("_passed") + F.coalesce("_before", F.lit(0)))
    ok = _no_null(keys) & F.col("_ts").isNotNull()
    pick = [F.when(ok, F.col(f"_last_{k}.{c}")).alias(f"{k}_{'at' if c == '_at' else c}") for k in kinds for c in ("_at", *columns)]
    if number:
        pick.append(F.when(ok, F.col("_passed")).alias(number[1]))
    return out.select("_left.*", *pick)


def validity(log: DataFrame, keys: list[str], ts: str, tie: str | None = None) -> DataFrame:
    """log with valid_from and valid_to: each row holds until the next one of its key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in (ts, tie) if c])
    return log.withColumns({"valid_from": F.col(ts), "valid_to": F.lead(ts).over(w)})


def range_join(left: DataFrame, ranges: DataFrame, keys: list[str], ts: str, low: str, high: str, closed: bool = False, how: str = "left", bucket_s: int = 86_400, times: DataFrame | None = None) -> DataFrame:
    """left with every range of its keys that holds its time: low <= ts < high, or <= high if `closed`; a null high is open.

    Ranges are cut at buckets of time and met by an equi-join on keys and bucket with the exact condition beside it, so no
    key's rows are scanned range by range, and a key that holds most rows is dealt to tasks by bucket. Open and long ranges
    are laid out within the buckets that left has. `left` and `ranges` share no column but the keys. how: left or inner. `times`:
    a table with all times of left, read for the first and last in place of a left that is dear to make twice.
    """
    number = lambda c: F.floor(epoch(F.col(c)) / bucket_s)
    rows = left.withColumn("_bucket", number(ts))
    seen = (rows if times is None else times.select(number(ts).alias("_bucket"))).agg(F.min("_bucket").alias("_b0"), F.max("_bucket").alias("_b1"))  # one row
    r = ranges.withColumnsRenamed({k: f"_{k}" for k in keys}).crossJoin(F.broadcast(seen))
    first, last = F.greatest(number(low), F.col("_b0")), F.when(F.col(high).isNull(), F.col("_b1")).otherwise(F.least(number(high), F.col("_b1")))
    r = r.withColumns({"_b0": first, "_b1": last}).where("_b0 <= _b1")
    r = r.withColumn("_at", F.explode(F.sequence("_b0", "_b1"))).drop("_b0", "_b1")
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys], F.col("_bucket") == F.col("_at"))
    before = F.col(ts) <= F.col(high) if closed else F.col(ts) < F.col(high)
    on = on & (F.col(ts) >= F.col(low)) & (F.col(high).isNull() | before)
    return rows.join(r, on, how).drop("_bucket", "_at", *[f"_{k}" for k in keys])


def interval_join(left: DataFrame, log: DataFrame, keys: list[str], left_ts: str, log_ts: str, columns: list[str], tie: str | None = None, bucket_s: int = 86_400, times: DataFrame | None = None) -> DataFrame:
    """The as-of join by validity ranges, for logs with few rows a key and bucket: each log row holds from its time until the next one of its key."""
    r = validity(log, keys, log_ts, tie).select(*keys, "valid_from", "valid_to", *columns)
    return range_join(left, r, keys, left_ts, "valid_from", "valid_to", bucket_s=bucket_s, times=times)


def counted_join(left: DataFrame, log: DataFrame, keys: list[str], left_ts: str, log_ts: str, columns: list[str], tie: str | None = None, bucket: str = "day") -> DataFrame:
    """interval_join for logs of many rows: a row's range is the one with as many log rows of its key as are not after the row.

    Ranges and rows meet by an equi-join on key and that number, each row one range at most, so the work is not that of
    all rows by all ranges of a bucket.
    """
    known = log.where(_no_null(keys) & F.col(log_ts).isNotNull())
    order = [c for c in (log_ts, tie) if c]
    r = numbered(validity(known, keys, log_ts, tie), keys, order, "_no", bucket).select(*keys, "_no", "valid_from", "valid_to", *columns)
    x = counted(left, known, keys, left_ts, log_ts, "_no", bucket).withColumn("_no", F.col("_no").cast("long"))
    r = r.withColumn("_no", F.col("_no").cast("long")).withColumnsRenamed({k: f"_{k}" for k in keys} | {"_no": "_range"})
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in keys], F.col("_no") == F.col("_range"))
    on = on & (F.col(left_ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(left_ts) < F.col("valid_to")))
    return x.join(r, on, "left").drop("_no", "_range", *[f"_{k}" for k in keys])


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """left with the right row nearest in time on either side (ties: the earlier), and how many seconds off it is."""
    both = _union(left, right, keys, left_ts, right_ts, columns, tie)
    edge = F.col("_tie").asc_nulls_first()
    before = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_ts", "_side", edge).rowsBetween(START, 0))
    after = F.last("_right", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.col("_ts").desc(), "_side", edge).rowsBetween(START, 0))
    out = both.withColumns({"_before": before, "_after": after}).where("_side = 1")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gaps = {"_g0": micros("_ts") - micros("_before._at"), "_g1": micros("_after._at") - micros("_ts")}
    out = out.withColumns(gaps)
    early = F.col("_g1").isNull() | (F.col("_g0") <= F.col("_g1"))
    hit = F.when(early & F.col("_g0").isNotNull(), F.col("_before")).otherwise(F.col("_after"))
    out = out.withColumn("_hit", F.when(_no_null(keys), hit))
    return out.select("_left.*", F.col("_hit._at").alias("nearest_at"), (F.least("_g0", "_g1") / 1e6).alias("seconds_off"), *[F.col(f"_hit.{c}").alias(c) for c in columns])


def leaks(joined: DataFrame, ts: str, context_times: list[str]) -> DataFrame:
    """Rows whose context is later than themselves; a right as-of join leaves none."""
    return joined.where(reduce(lambda a, b: a | b, [F.col(c) > F.col(ts) for c in context_times]))
