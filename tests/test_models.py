"""Exact quantiles, isolation forests and rolling origins against plain versions and planted cases."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import anomaly, evaluate, metrology, quantiles

T0 = datetime(2025, 1, 1)


@pytest.mark.parametrize("bins, few", [(1024, 20_000), (4, 0), (7, 5)])
def test_quantiles_equal_numpys(spark, bins, few):
    rng = random.Random(bins)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 0.5, 1e12, -3.0])) for _ in range(900)] + [("flat", 2.5)] * 40 + [("one", -1.0), ("none", None), ("none", float("nan")), ("wide", 1.7e308), ("wide", -1.7e308), ("wide", 0.0), (None, 1.0), (None, 4.0)]
    rng.shuffle(rows)
    shares = {"a": 0.0, "b": 0.31, "c": 0.5, "d": 0.997, "e": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in quantiles.grouped_quantiles(df, ["k"], "v", shares, bins=bins, few=few).collect()}
    own = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            own.setdefault(k, []).append(v)
    assert set(got) == set(own)
    for k, values in own.items():
        assert got[k]["n"] == len(values)
        for name, p in shares.items():
            want = sorted(values)[round(p * (len(values) - 1))] if k == "wide" else np.quantile(values, p)
            if k != "wide" or name in "ace":
                assert got[k][name] == pytest.approx(want), (k, name)


def test_quantiles_of_a_whole_table(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    r = quantiles.grouped_quantiles(df, [], "v", {"q": 0.25}, few=10).collect()
    assert len(r) == 1 and r[0]["n"] == 1000 and r[0]["q"] == 250.75
    assert quantiles.grouped_quantiles(df.limit(0), [], "v", {"q": 0.25}).count() == 0


def test_no_sort_of_the_table_for_an_edge(spark):
    df = spark.range(5000).select((F.col("id") % 97).cast("double").alias("s"))
    assert evaluate.kth_largest(df, "s", 1) == (96.0, 0)
    assert evaluate.kth_largest(df, "s", 53) == (95.0, 51) or evaluate.kth_largest(df, "s", 53)[0] in (95.0, 96.0)
    values = sorted((i % 97 for i in range(5000)), reverse=True)
    for k in (1, 60, 2500, 5000):
        edge, larger = evaluate.kth_largest(df, "s", k)
        assert edge == values[k - 1] and larger == sum(v > edge for v in values)
    with pytest.raises(ValueError):
        evaluate.kth_largest(df, "s", 5001)


def test_trees_split_all_rows_and_paths_are_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    feature, cut, low = (np.array(a) for a in anomaly.grown(x, np.random.default_rng(2), 9))
    got = anomaly.depths(feature, cut, low, x)

    def walk(row):
        node, steps = 0, 0
        while feature[node] >= 0:
            node = low[node] + (row[feature[node]] >= cut[node])
            steps += 1
        return steps + cut[node]

    assert got.tolist() == [walk(r) for r in x] and (feature < 0).sum() == (feature >= 0).sum() + 1


def forest_rows(n, seed=1, groups=("a", "b")):
    rng = random.Random(seed)
    return [(i, groups[0] if rng.random() < 0.85 else groups[1], rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(n)]


def test_each_tree_has_its_own_whole_sample(spark):
    df = spark.createDataFrame(forest_rows(3000), "id long, g string, x double, y double")
    trees = anomaly.fit_forest(df, "g", "id", ["x", "y"], trees=12, sample=128, fit_rows=1500).collect()
    by = {}
    for t in trees:
        by.setdefault(t["g"], []).append(t)
    assert {g: len(ts) for g, ts in by.items()} == {"a": 12, "b": 12}
    assert all(t["n"] == 128 for t in trees) and len({tuple(t["cut"][:3]) for t in by["a"]}) == 12
    small = anomaly.fit_forest(df.limit(50), "g", "id", ["x", "y"], trees=3, sample=4096).collect()
    assert sum(t["n"] for t in small if t["tree"] == 1) == 50
    plan = anomaly.fit_forest(df, "g", "id", ["x", "y"])._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(filter(" in plan  # trees are drawn within the row


def test_forest_scores_equal_plain_ones_in_chunks(spark):
    rows = [*forest_rows(700), (5000, "c", 0.0, 0.0), (5001, None, 0.0, 0.0), (5002, "a", None, 40.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double").withColumn("note", F.lit("kept"))
    forest = anomaly.fit_forest(df.where("g in ('a', 'b')"), "g", "id", ["x", "y"], trees=20, sample=64)
    got = {r["id"]: r for r in anomaly.score_forest(df, forest, "g", ["x", "y"], chunk=100).collect()}
    assert len(got) == len(rows) and all(r["note"] == "kept" for r in got.values())
    trees = {}
    for t in forest.collect():
        trees.setdefault(t["g"], []).append(t)
    for i, g, x, y in rows:
        if g in trees:
            p = np.array([[x or 0.0, y or 0.0]])
            mean = np.mean([anomaly.depths(np.array(t["feature"]), np.array(t["cut"]), np.array(t["low"]), p)[0] for t in trees[g]])
            assert got[i]["anomaly"] == pytest.approx(2 ** (-mean / anomaly.average_path(trees[g][0]["n"])))
        else:
            assert got[i]["anomaly"] is None
    assert got[5002]["anomaly"] > np.quantile([r["anomaly"] for r in got.values() if r["g"] == "a"], 0.8)


def month(k):
    return datetime(2025, 1 + k, 1)


def test_rolling_forest_finds_planted_months_and_sees_no_future(spark):
    rng = random.Random(9)
    rows = []
    for m in range(4):
        for i in range(500):
            cell = "A" if i % 2 else "B"
            odd = cell == "A" and m == 2 and i > 450
            rows.append((m * 1000 + i, cell, month(m), month(m) + timedelta(hours=i), rng.gauss(0, 1) + 9 * odd, rng.gauss(0, 1), not odd))
    df = spark.createDataFrame(rows, "id long, cell string, m timestamp_ntz, ts timestamp_ntz, x double, y double, good boolean")
    args = ("cell", "m", "2025-02-01", "id", ["x", "y"], F.col("good"), ["cell"], ["ts", "id"])
    options = {"rate": 0.02, "least": 200, "trees": 40, "sample": 128}
    got = {r["id"]: r for r in metrology.rolling_forest(df, *args, **options).collect()}
    assert set(got) == {r[0] for r in rows if r[0] >= 1000}
    assert {(r["cell"], r["m"], r["n_fit"]) for r in got.values()} == {(c, month(m), sum(1 for x in rows if x[1] == c and x[2] < month(m) and x[6])) for c in "AB" for m in (1, 2, 3)}
    planted = [i for i, c, *_, ok in rows if not ok]
    assert sum(got[i]["alarm"] for i in planted) >= 0.9 * (len(planted) - 1)
    assert sum(r["alarm"] for r in got.values() if r["id"] not in planted and r["cell"] == "B") <= 0.08 * 750
    # What comes later changes no earlier score or threshold.
    early = {r["id"]: (r["anomaly"], r["threshold"]) for r in metrology.rolling_forest(df.where("m < '2025-04-01'"), *args, **options).collect()}
    assert early == {i: (r["anomaly"], r["threshold"]) for i, r in got.items() if r["m"] < month(3)}
    few = metrology.rolling_forest(df, *args, **(options | {"least": 10_000})).collect()
    assert len(few) == 1500 and all(r["anomaly"] is None and not r["alarm"] for r in few)


def test_boosting_by_origin_follows_drift_and_holds_a_month_out(spark):
    rng = random.Random(2)
    rows = [(m * 1000 + i, month(m), x := rng.random(), (2.0 if m < 2 else -2.0) * x) for m in range(5) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, m timestamp_ntz, x double, y double")
    seen = []

    def fit(train, valid):
        seen.append((train.agg(F.max("m")).first()[0], {r[0] for r in valid.select("m").distinct().collect()}))
        return metrology.boosted_model(train, valid, ["x"], "y", rounds=8, depth=3)

    got = metrology.rolling_origin(df, "m", "2025-01-01", fit, held_out=True).collect()
    assert {r["m"] for r in got} == {month(m) for m in (2, 3, 4)} and len(got) == 450
    assert seen == [(month(k - 2), {month(k - 1)}) for k in (2, 3, 4)]
    off = {m: np.mean([abs(r["predicted"] - r["y"]) for r in got if r["m"] == month(m)]) for m in (2, 4)}
    # The slope turns in the third month: fits that know only the months before are wrong then, and mend later.
    assert off[2] > 1.5 and off[4] < off[2] / 1.5


def test_boosting_fits_sums_of_equal_rows_and_gives_what_all_rows_give(spark, monkeypatch):
    from pyspark.ml.base import Estimator
    from pyspark.ml.regression import GBTRegressor

    rng = random.Random(5)
    level, rows = {(a, b): rng.gauss(0, 5) for a in range(12) for b in range(8)}, []
    for i in range(3000):
        m, a, b = i % 4, rng.randrange(12), rng.randrange(8)
        missing = rng.random() < 0.02
        rows.append((i, month(m), None if missing else float(a), float(b), None if rng.random() < 0.02 else level[a, b] + rng.gauss(0, 3)))
    df = spark.createDataFrame(rows, "id long, m timestamp_ntz, a double, b double, y double").repartition(3)
    sizes, trees = [], []

    def counted(self, dataset, params=None):
        sizes.append(dataset.count())
        model = Estimator.fit(self, dataset, params)
        trees.append(model.getNumTrees)
        return model

    monkeypatch.setattr(GBTRegressor, "fit", counted)
    fit = lambda train, valid, **k: metrology.boosted_model(train, valid, ["a", "b"], "y", rounds=30, depth=3, **k)
    got = metrology.rolling_origin(df, "m", "2025-01-01", fit, held_out=True).collect()
    # 96 whole vectors of features, each as two rows at most for train and for valid, however many rows there are.
    assert len(sizes) == 2 and max(sizes) <= 2 * 2 * 96 and len(got) == 1500
    sums = metrology.alike(df, ["a", "b"], "y", ["m"])
    once = metrology.rolling_origin(df, "m", "2025-01-01", lambda t, v: fit(t, v, summed=True), held_out=True, learn=sums).collect()
    split = F.when(F.col("m") < "2025-03-01", "train").when(F.col("m") < "2025-04-01", "valid").otherwise("test")
    by_split = metrology.boosted(df.withColumn("s", split), ["a", "b"], "y", "s", rounds=30, depth=3).where("s = 'test'").collect()
    assert max(sizes) <= 2 * 2 * 96
    # The same fits on all rows, by MLlib alone; noise within equal rows counts when validation stops them.
    plain = {}
    for k in (2, 3):
        x = metrology._assembled(df.where((F.col("m") < str(month(k))) & F.col("y").isNotNull()).withColumn("_valid", F.col("m") == F.lit(month(k - 1))), ["a", "b"])
        model = GBTRegressor(featuresCol="_features", labelCol="y", maxIter=30, maxDepth=3, maxBins=256, seed=7, validationIndicatorCol="_valid").fit(x)
        plain |= {r["id"]: r["prediction"] for r in model.transform(metrology._assembled(df.where(F.col("m") == F.lit(month(k))), ["a", "b"])).collect()}
    assert trees[:2] == trees[2:4] == trees[5:] and trees[4] == trees[6] and all(1 < t < 30 for t in trees), trees
    for found, n in ((got, 1500), (once, 1500), (by_split, 750)):
        assert len(found) == n
        for r in found:
            assert (r["predicted"] is None) == (r["a"] is None)
            assert r["a"] is None or abs(r["predicted"] - plain[r["id"]]) < 1e-9, (r, plain[r["id"]])


@pytest.mark.parametrize("size, block", [(5, 7), (31, 40), (301, 20_000)])
def test_sliding_median_equals_plain_windows(spark, size, block):
    from plantlens.operators import mechanisms

    rng = random.Random(size)
    rows = [(k, i, None if rng.random() < 0.1 else float(rng.randrange(40))) for k, n in (("hot", 500), ("b", 90), (None, 3), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    got = {(r["k"], r["i"]): r["residual"] for r in mechanisms.centred_median(df, ["k"], ["i"], "v", size, 3, block).collect()}
    assert len(got) == len(rows)
    for k, i, v in rows:
        near = [w for key, j, w in rows if key == k and abs(j - i) <= size // 2 and w is not None]
        assert got[k, i] == (None if v is None or len(near) < 3 else v - float(np.median(near))), (k, i)


def test_events_and_the_first_response_of_any_log(spark):
    from plantlens.operators import mechanisms

    at = lambda m: T0 + timedelta(minutes=m)
    events = spark.createDataFrame([("e1", "j", at(10), at(50)), ("e2", "j", at(100), at(120)), ("e3", "none", at(0), at(9))], "id string, job string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    rows = spark.createDataFrame([("j", at(m), m in (30, 110), m == 50) for m in range(0, 200, 10)], "job string, ts timestamp_ntz, flag boolean, alarm boolean")
    logs = {"review": (spark.createDataFrame([("j", at(5)), ("j", at(45))], "job string, r timestamp_ntz"), "r"), "change": (spark.createDataFrame([("j", at(42)), ("x", at(11))], "job string, c timestamp_ntz"), "c")}
    x = mechanisms.detected_events(events, rows, logs, ["job"], "ts", "flag", "alarm")
    got = {r["id"]: r for r in x.collect()}
    assert set(got) == {"e1", "e2"}
    e = got["e1"]
    assert (e["started_at"], e["n_rows"], e["flag_rate"], e["minutes_to_flag"], e["minutes_to_alarm"]) == (at(10), 5, 0.2, 20.0, 40.0)
    assert (e["response_at"], e["response_kind"], e["lead_over_response"]) == (at(42), "change", 12.0)
    assert got["e2"]["response_at"] is None and got["e2"]["lead_over_response"] is None and got["e2"]["detected"]
    s = mechanisms.detection_summary(x, "flag").first()
    assert (s["events"], s["detected"], s["minutes_to_flag"], s["lead_over_response"]) == (2, 2, 15.0, 12.0)


def test_curve_errors_equal_numpys_by_cell(spark):
    rng = np.random.default_rng(4)
    base = {g: rng.normal(size=(3, 12)) for g in ("a", "b")}
    rows = [(i, g, (rng.normal(size=3) @ base[g] + 0.05 * rng.normal(size=12) + (2.0 * rng.normal(size=12) if i % 50 == 7 else 0)).tolist(), i % 50 != 7) for i in range(400) for g in [("a", "b")[i % 3 == 0]]]
    rows += [(900, "few", [0.0] * 12, True), (901, "a", None, True)]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>, good boolean").repartition(4)
    got = {r["id"]: r for r in anomaly.curve_errors(df, "g", "v", F.col("good"), k=3, rate=0.02, least=50).collect()}
    assert len(got) == len(rows) and got[900]["error"] is None and got[901]["error"] is None and not got[901]["flagged"]
    for g in "ab":
        fit = np.array([v for i, h, v, ok in rows if h == g and ok and v])
        mean = fit.mean(axis=0)
        axes = np.linalg.svd(fit - mean, full_matrices=False)[2][:3]
        error = lambda v: float((((v - mean) - (v - mean) @ axes.T @ axes) ** 2).mean())  # noqa: B023, E731
        limit = np.quantile([error(v) for v in fit], 0.98)
        for i, h, v, _ in rows:
            if h == g and v:
                assert got[i]["error"] == pytest.approx(error(np.array(v)), abs=1e-9) and got[i]["threshold"] == pytest.approx(limit, abs=1e-9)
    assert all(got[i]["flagged"] for i, g, _, ok in rows if not ok)
