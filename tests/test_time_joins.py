"""Joins and numbering by buckets of time against loops, with a key that holds most rows."""

import pytest
from pyspark.sql import functions as F

from plantlens.operators import asof, mechanisms, windows


def skewed(spark, n=600):
    """Two keys, one of which has nine tenths of the rows, over some days; a log of three kinds; a null key and time."""
    import random
    from datetime import datetime, timedelta

    rng = random.Random(8)
    at = lambda: datetime(2026, 1, 1) + timedelta(seconds=rng.randrange(6 * 86_400) // 600 * 600)
    key = lambda: "hot" if rng.random() < 0.9 else "cold"
    rows = [(i, key(), at()) for i in range(n)] + [(n, None, at()), (n + 1, "hot", None), (n + 2, "alone", at())]
    log = [(key(), at(), rng.choice("abc"), i) for i in range(60)] + [(None, at(), "a", 60), ("hot", None, "a", 61)]
    return rows, log, spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz"), spark.createDataFrame(log, "key string, at timestamp_ntz, kind string, no long")


def test_fused_asof_by_bucket_equals_loops(spark):
    rows, log, df, ldf = skewed(spark)
    want = {}
    for i, key, ts in rows:
        for kind in "abc":
            hits = [(t, no) for k, t, c, no in log if c == kind and k is not None and k == key and ts and t and t <= ts]
            want[i, kind] = max(hits, default=(None, None))
    for bucket in (None, "day", "hour"):
        got = asof.asof_fused(df, ldf, ["key"], "ts", "at", "kind", ["a", "b", "c"], ["no"], tie="no", bucket=bucket).collect()
        assert len(got) == len(rows)
        assert {(r["id"], k): (r[f"{k}_at"], r[f"{k}_no"]) for r in got for k in "abc"} == want


def test_numbers_by_bucket_equal_plain_numbers(spark):
    rows, _, df, _ = skewed(spark)
    plain = {(r["id"], r["point_no"]) for r in windows.numbered(df, ["key"], ["ts", "id"]).collect()}
    assert {(r["id"], r["point_no"]) for r in windows.numbered(df, ["key"], ["ts", "id"], bucket="day").collect()} == plain


def window_partitions(df):
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.sub(r"#\d+", "", m) for m in re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)], plan


def test_no_window_over_rows_is_on_a_hot_key_alone(spark):
    _, _, df, ldf = skewed(spark)
    fused = asof.asof_fused(windows.numbered(df, ["key"], ["ts", "id"], bucket="day"), ldf, ["key"], "ts", "at", "kind", ["a", "b"], ["no"], bucket="day")
    parts, plan = window_partitions(fused)
    alone = [p for p in parts if "_bucket" not in p]
    # Windows on the key alone run over one row a bucket: an aggregate on key and bucket is right below them.
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Window [" in line and "_bucket" not in line.split("], [")[1]:
            below = [x for x in lines[i + 1 : i + 4] if "Aggregate [" in x]
            assert below and "_bucket" in below[0], line
    assert len(alone) == 2 and len(parts) == 4


@pytest.mark.parametrize("bucket_s", [3_600, 86_400, 10**9])
def test_range_join_equals_loops(spark, bucket_s):
    rows, log, df, _ = skewed(spark, 300)
    from datetime import timedelta

    ranges = [(k, t, None if no % 7 == 0 or t is None else t + timedelta(hours=no % 50 - 2), no) for k, t, _, no in log]
    rdf = spark.createDataFrame(ranges, "key string, low timestamp_ntz, high timestamp_ntz, no long")
    for closed in (False, True):
        inside = lambda ts, a, b: ts is not None and a is not None and a <= ts and (b is None or ts < b or closed and ts == b)  # noqa: B023, E731
        want = sorted((i, no) for i, key, ts in rows for k, a, b, no in ranges if k is not None and k == key and inside(ts, a, b))
        got = asof.range_join(df, rdf, ["key"], "ts", "low", "high", closed=closed, how="inner", bucket_s=bucket_s).collect()
        assert sorted((r["id"], r["no"]) for r in got) == want
        outer = asof.range_join(df, rdf, ["key"], "ts", "low", "high", closed=closed, bucket_s=bucket_s).collect()
        assert {r["id"] for r in outer} == {r[0] for r in rows} and sum(r["no"] is not None for r in outer) == len(want)
    plan = asof.range_join(df, rdf, ["key"], "ts", "low", "high")._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan and "Join LeftOuter" in plan
    assert asof.range_join(df.limit(0), rdf, ["key"], "ts", "low", "high").count() == 0
    assert asof.range_join(df, rdf.limit(0), ["key"], "ts", "low", "high").count() == len(rows)


def test_event_credit_counts_rows_of_hot_events(spark):
    from datetime import timedelta

    rows, log, df, _ = skewed(spark, 300)
    events = [(k, t, t + timedelta(hours=30), no) for k, t, _, no in log if k and t][:20] + [("none", log[0][1], log[0][1], 99)]
    edf = spark.createDataFrame(events, "key string, start_ts timestamp_ntz, end_ts timestamp_ntz, no long")
    got = {r["no"]: (r["n_rows"], r["first_odd"]) for r in mechanisms.event_credit(edf, df.withColumn("odd", F.col("id") % 2 == 1), ["key"], "ts", ["odd"]).collect()}
    own = lambda k, a, b: [(i, ts) for i, key, ts in rows if key == k and ts and a <= ts <= b]
    assert got == {no: (len(own(k, a, b)), min((ts for i, ts in own(k, a, b) if i % 2), default=None)) for k, a, b, no in events}


def test_counts_and_joins_by_number_equal_loops(spark):
    """rows meet one range each, by its number, also where a bucket holds many ranges."""
    rows, log, df, ldf = skewed(spark)
    known = [r for r in log if r[0] and r[1]]
    got = {r["no"]: r["n"] for r in windows.counted(ldf, df, ["key"], "at", "ts", "n", "day").collect()}
    assert got == {no: sum(k == key and ts is not None and t is not None and k is not None and ts <= t for _, key, ts in rows) for k, t, _, no in log}
    want = {i: max(((t, no) for k, t, _, no in known if k == key and ts and t <= ts), default=(None, None))[1] for i, key, ts in rows}
    joined = asof.counted_join(df, ldf, ["key"], "ts", "at", ["no"], tie="no")
    assert {r["id"]: r["no"] for r in joined.collect()} == want and joined.count() == len(rows)
    assert "_range" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_of_a_fused_pass_and_counters_around_equal_plain_ones(spark):
    """a key's rows are numbered in the pass that joins its log, counters around an event by bucket."""
    _, _, df, ldf = skewed(spark)
    plain = {r["id"]: r["n"] for r in windows.numbered(df.where("key is not null and ts is not null"), ["key"], ["ts", "id"], "n").collect()}
    for bucket in (None, "day"):
        fused = asof.asof_fused(df, ldf, ["key"], "ts", "at", "kind", ["a"], ["no"], tie="no", bucket=bucket, number=("id", "n"))
        assert {r["id"]: r["n"] for r in fused.collect() if r["n"] is not None} == plain
    x = df.withColumn("later", F.when(F.col("id") % 50 != 0, F.col("ts") >= F.lit("2026-01-03").cast("timestamp_ntz")))
    by = [{(r["id"], r["c"]) for r in windows.around(x, ["key"], ["ts", "id"], "later", "c", bucket).collect()} for bucket in (None, "day")]
    assert by[0] == by[1] and len(by[0]) == df.count()
