"""Edge cases of the operators on small frames, recurrences against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantlens.functions import scalars as S
from plantlens.operators import anomaly, asof, capability, checks, curves, deviation, drift, evaluate, labels, spc, windows

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "key string, i int, value double")


@pytest.mark.parametrize("bucket", [None, "hour"])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_equals_a_loop(spark, direction, bucket):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", None]), at(rng.randrange(600))) for i in range(80)]
    right = [(i, rng.choice(["a", "b", None]), at(rng.randrange(0, 600, 7))) for i in range(60)]
    lf = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    rf = spark.createDataFrame(right, "rid int, k string, rts timestamp_ntz")
    got = {r["id"]: r["rid"] for r in asof.asof_join(lf, rf, ["k"], "ts", "rts", ["rid"], direction=direction, tie="rid", bucket=bucket).collect()}
    for i, k, ts in left:
        if direction == "backward":
            best = max(((rts, rid) for rid, rk, rts in right if k is not None and rk == k and rts <= ts), default=(None, None))
        else:
            ahead = [(rts, rid) for rid, rk, rts in right if k is not None and rk == k and rts >= ts]
            first = min((x[0] for x in ahead), default=None)
            best = max((x for x in ahead if x[0] == first), default=(None, None))
        assert got[i] == best[1]


def test_asof_tolerance_and_misses(spark):
    lf = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(100)), (3, "b", at(5))], "id int, k string, ts timestamp_ntz")
    rf = spark.createDataFrame([("a", at(90), 7)], "k string, rts timestamp_ntz, v int")
    got = {r["id"]: (r["v"], r["at"]) for r in asof.asof_join(lf, rf, ["k"], "ts", "rts", ["v"], tolerance_s=900).collect()}
    assert got == {1: (None, None), 2: (7, at(90)), 3: (None, None)}
    assert asof.asof_join(lf, rf.limit(0), ["k"], "ts", "rts", ["v"]).where("v is not null").count() == 0


def test_interval_and_nearest(spark):
    lf = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(15)), (3, "a", at(25))], "id int, k string, ts timestamp_ntz")
    rf = spark.createDataFrame([("a", at(10), 1), ("a", at(20), 2)], "k string, rts timestamp_ntz, v int")
    assert {r["id"]: r["v"] for r in asof.interval_join(lf, rf, ["k"], "ts", "rts", ["v"]).collect()} == {1: None, 2: 1, 3: 2}
    assert {r["id"]: r["v"] for r in asof.nearest_join(lf, rf, ["k"], "ts", "rts", ["v"]).collect()} == {1: 1, 2: 1, 3: 2}


def test_boundaries_count_starts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 59), datetime(2024, 1, 1, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(S.boundaries("hour", F.col("a"), F.col("b"))).first()[0] == 1


def test_codes(spark):
    df = spark.createDataFrame([("Sink marks",), ("  ",), (None,), ("zzz",)], "t string")
    assert [r[0] for r in df.select(S.normalized_code(F.col("t"), [("sink", "sink")])).collect()] == ["sink", "other", "other", "other"]
    assert [r[0] for r in labels.exploded_codes(spark.createDataFrame([(1, "a:2;b:3"), (2, None), (3, "")], "i int, c string"), "c", ["i"]).select("qty").collect()] == [2.0, 3.0]


def test_deviation_and_state(spark):
    df = spark.createDataFrame([(1.5, 1.0, 0.0, 2.0), (0.5, 1.0, 0.0, 2.0), (2.0, 2.0, 1.0, 2.0), (None, 1.0, 0.0, 2.0)], "v double, t double, lo double, hi double")
    v, t, lo, hi = (F.col(c) for c in ("v", "t", "lo", "hi"))
    assert [r[0] for r in df.select(deviation.deviation(v, t, lo, hi)).collect()] == [0.5, -0.5, None, None]
    assert [r[0] for r in df.select(deviation.alarm_state([deviation.outside(v, lo, hi)], [], v.isNull())).collect()] == ["none"] * 4


def test_rules_and_constant_series(spark):
    x = spc.charted(series(spark, [1, 1, 1, 1]), ["key"], ["i"])
    fit = spc.ar1_fit(x, ["key"], 0, 10).first()
    assert fit["phi"] == 0.98 and fit["ar_sd"] == 0.0
    z = spc.run_rules(series(spark, [2.5, 2.5, 0, None]), ["key"], ["i"], "value")
    assert [r["we2"] for r in z.orderBy("i").collect()] == [False, True, True, False]


def test_new_alarms(spark):
    df = spark.createDataFrame([("a", n, n in (2, 3, 5)) for n in range(1, 7)], "key string, point_no int, we1 boolean")
    assert sorted(r["point_no"] for r in spc.new_alarms(df, ["key"], {"we1": "WE1"}).collect()) == [2, 5]


def test_ewma_loop(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(300)]
    marks = [i in (50, 51, 200) for i in range(300)]
    df = spark.createDataFrame([("a", i, v, r) for i, (v, r) in enumerate(zip(values, marks))], "key string, i int, value double, reset boolean")
    got = [r["ewma"] for r in drift.ewma(df, ["key"], ["i"], "value", baseline=40).orderBy("i").collect()]
    prev = sum(values[:40]) / 40
    for i, v in enumerate(values):
        prev = v if marks[i] else prev
        prev = 0.2 * v + 0.8 * prev
        assert got[i] == pytest.approx(prev, abs=1e-6)


def test_cusum_loop(spark):
    rng = random.Random(2)
    z = [None if i % 17 == 3 else rng.gauss(0.4, 1) for i in range(120)]
    resets = [i in (30, 77) for i in range(120)]
    df = spark.createDataFrame([("a", i, v, r) for i, (v, r) in enumerate(zip(z, resets))], "key string, i int, z double, reset boolean")
    got = [(r["cusum"], r["cusum_signal"]) for r in drift.cusum(df, ["key"], "i", h=2.0).orderBy("i").collect()]
    s = 0.0
    for i, v in enumerate(z):
        s = 0.0 if resets[i] else s
        fired = False
        if v is not None:
            s = max(0.0, s + v - 0.375)
            fired = s > 2.0
        assert got[i] == (pytest.approx(s), fired)
        s = 0.0 if fired else s


def test_rearm(spark):
    df = spark.createDataFrame([("a", i, i in (5, 2999 + 5, 3005, 6100), i == 6050) for i in range(6200)], "key string, i int, signal boolean, reset boolean")
    got = sorted(r["position"] for r in drift.rearmed(df, ["key"], ["i"], "signal").collect())
    assert got == [5, 6100]  # 3004 and 3005 are one run that starts 2,999 rows on


def test_counters_and_nearest_rows(spark):
    df = spark.createDataFrame([("a", i, at(i), i >= 3) for i in range(6)], "key string, i int, ts timestamp_ntz, after boolean")
    assert [r["counter"] for r in windows.around(df, ["key"], ["ts"], "after").orderBy("i").collect()] == [-3, -2, -1, 0, 1, 2]
    ev = spark.createDataFrame([("a", at(3), 9)], "key string, ets timestamp_ntz, eid int")
    near = windows.nearest_rows(df, ev, ["key"], "ts", "i", "ets", "eid", 2)
    assert sorted((r["i"], r["side"]) for r in near.collect()) == [(1, "before"), (2, "before"), (3, "after"), (4, "after")]


def test_capability_single_piece_groups(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)], "k string, g int, v double")
    row = capability.capability(df, ["k"], "g", "v", F.lit(0.0), F.lit(4.0)).first()
    assert row["cpk"] is None and row["ppk"] == pytest.approx(2 / (3 * 1.5811388), abs=1e-6)


def test_incremental_flags_are_disjoint(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "a boolean, b boolean")
    assert [(r["a_only"], r["b_only"]) for r in evaluate.incremental(df, ["a", "b"]).collect()] == [(True, False), (False, True), (False, False)]


def test_allocation_sums_up(spark):
    totals = spark.createDataFrame([("a", 6.0), ("b", 1.0)], "k string, qty double")
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, h int, n int")
    got = labels.allocated(totals, rows, ["k"], "qty", "n")
    assert got.agg(F.sum("allocated")).first()[0] == pytest.approx(6.0) and got.count() == 2


def test_forest_finds_the_odd_row(spark):
    rng = random.Random(5)
    rows = [("g", i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [("g", 400, 12.0, -12.0), ("none", 401, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    forest = anomaly.fit_forest(df, "g", "id", ["x", "y"], trees=20)
    scores = {r["id"]: r["anomaly"] for r in anomaly.score_forest(df, forest, "g", ["x", "y"]).collect()}
    assert scores[400] == max(v for k, v in scores.items() if k != 401)


def test_resampled_curve(spark):
    """Three curves of two jobs against numpy: bins of their own length, the tail's median off, the job's median peak as scale."""
    import numpy as np

    rng = random.Random(4)
    shape = {1: ("a", 50), 2: ("a", 33), 3: ("b", 9)}
    rows = [(k, job, t * 10, 3 + 5 * t * (n - t) / n + rng.random()) for k, (job, n) in shape.items() for t in range(n)]
    bins, tail, want, peak = 16, 4, {}, {}
    for k, (_, n) in shape.items():
        own = [(t, v) for i, _, t, v in rows if i == k]
        grid, level = [], 0.0
        for b in range(bins):
            inside = [v for t, v in own if int(t / ((n - 1) * 10 + 10) * bins) == b]
            level = float(np.mean(inside)) if inside else level
            grid.append(level)
        want[k] = np.array(grid) - np.median(grid[-tail:])
        peak[k] = want[k].max()
    df = spark.createDataFrame(rows, "id int, job string, t int, v double")
    got = {}
    for r in curves.resampled(df, ["id"], "t", "v", bins=bins, margin=10, tail=tail, scale_by=["job"]).collect():
        got[r["id"], r["bin"]] = r["level"]
    scale = {"a": np.median([peak[1], peak[2]]), "b": peak[3]}
    assert got == {(k, b): pytest.approx(want[k][b] / scale[shape[k][0]]) for k in want for b in range(bins)}
    own = curves.resampled(df, ["id"], "t", "v", bins=bins, tail=tail).groupBy("id").agg(F.max("level").alias("m")).collect()
    assert [r["m"] for r in own] == [1.0] * 3


def test_checks_on_empty(spark):
    df = spark.createDataFrame([], "a int, b double")
    assert checks.not_unique(df, ["a"]).count() == 0
    assert [r["passed"] for r in checks.range_checks({"m": (df, F.avg("b"), 0, 1)}).collect()] == [False]


def test_streamed_folds_are_linear_and_keep_series_apart(spark):
    from plantlens.operators import drift

    rows = [(k, i, float(1 if i % 7 else -2), i == 40) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, i int, z double, reset boolean")
    got = {(r["k"], r["i"]): (r["cusum"], r["cusum_signal"]) for r in drift.cusum(df, ["k"], "i", k=0.25, h=3.0).collect()}
    for k in range(3):
        s = 0.0
        for i in range(100):
            s = 0.0 if i == 40 else s
            s = max(0.0, s + (1 if i % 7 else -2) - 0.25)
            assert got[k, i] == (s, s > 3.0)
            s = 0.0 if s > 3.0 else s


def test_kth_largest_and_recall_with_ties(spark):
    import random

    from plantlens.operators import evaluate

    rng = random.Random(4)
    rows = [(i, rng.choice([0.1, 0.5, rng.random(), None]), rng.random() < 0.2) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, s double, bad boolean")
    held = sorted((s for _, s, _ in rows if s is not None), reverse=True)
    for k in (1, 2, 300, len(held)):
        v, larger = evaluate.kth_largest(df, "s", k)
        assert v == held[k - 1] and larger == sum(x > v for x in held)
    top = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0]))[:600]
    r = evaluate.recall_at_rate(df, "s", "bad", "i", 0.2).first()
    assert (r["k"], r["captured"]) == (600, sum(b for _, _, b in top))


def test_median_interval_is_near_numpys(spark):
    import numpy as np

    from plantlens.operators import evaluate

    x = np.random.default_rng(2).exponential(10, 60)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "g string, i int, v double")
    r = evaluate.median_interval(df, ["g"], "i", "v").first()
    rng = np.random.default_rng(3)
    m = np.median(x[rng.integers(0, 60, (2000, 60))], axis=1)
    assert r["median"] == np.median(x) and abs(r["low"] - np.quantile(m, 0.025)) < 1.5 and abs(r["high"] - np.quantile(m, 0.975)) < 2.5


def test_sizes_between_the_tables_take_the_nearest(spark):
    from pyspark.sql import functions as F

    from plantlens.operators import capability

    df = spark.createDataFrame([(n,) for n in (2, 10, 11, 12, 13, 14, 17, 18, 20, 50)], "n int")
    got = {r["n"]: r["d"] for r in df.select("n", capability.by_size(capability.D2, F.col("n")).alias("d")).collect()}
    assert got == {2: 1.128, 10: 3.078, 11: 3.078, 12: 3.258, 13: 3.258, 14: 3.472, 17: 3.472, 18: 3.735, 20: 3.735, 50: 3.735}


def test_models_find_a_planted_signal_and_keep_rows_without_features(spark):
    import random

    from plantlens.operators import evaluate, metrology

    rng = random.Random(8)
    rows = []
    for i in range(1200):
        a, b = rng.random(), rng.random()
        rows.append((i, None if i % 100 == 0 else a, b, 2.0 * (a > 0.5) + rng.gauss(0, 0.1), a > 0.5 and rng.random() < 0.9, ("train", "valid", "test")[i % 3]))
    df = spark.createDataFrame(rows, "i int, a double, b double, y double, bad boolean, split string")
    x = metrology.boosted(df, ["a", "b"], "y", "split", rounds=10, depth=3)
    assert x.count() == 1200 and x.where("predicted is null").count() == 12
    from pyspark.sql import functions as F

    test = x.where("split = 'test' and predicted is not null")
    # y spreads by 1; trees cut at bins of a 32nd, so rows near the step cost most of the error.
    assert test.agg(F.sqrt(F.avg((F.col("y") - F.col("predicted")) ** 2))).first()[0] < 0.3
    z = metrology.classified(df, ["a", "b"], "bad", "split", rounds=5, depth=3)
    assert z.count() == 1200 and z.where("score is null").count() == 12
    assert evaluate.average_precision(z.where("split = 'test' and score is not null"), "score", "bad").first()[0] > 0.8


def test_numbers_of_a_text(spark):
    from pyspark.sql import functions as F

    from plantlens.functions import scalars

    df = spark.createDataFrame([("1;2.5;x",), (None,)], "t string")
    assert [r[0] for r in df.select(scalars.numbers(F.col("t"))).collect()] == [[1.0, 2.5, None], None]
