"""Intervals, leads and chance against plain Python, with the same hashed draws."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import evaluate, mechanisms


def uniform(*parts, seed=7):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 2**32


def weight(unit, replicate):
    u, k, total, term = uniform(unit, replicate), 0, math.exp(-1), math.exp(-1)
    while u >= total and k < 12:
        k += 1
        term /= k
        total += term
    return k


def test_weights_are_poisson_and_alike_everywhere(spark):
    df = spark.range(3000).select(F.col("id"), evaluate.poisson_weight(F.col("id"), F.lit(5), 7).alias("w"))
    got = {r["id"]: r["w"] for r in df.collect()}
    assert got == {i: weight(i, 5) for i in range(3000)}
    assert abs(np.mean(list(got.values())) - 1) < 0.06 and abs(np.var(list(got.values())) - 1) < 0.12


def test_rates_with_intervals_equal_loops(spark):
    rng = random.Random(6)
    rows = [(i, f"c{rng.randrange(25)}", rng.choice("xy"), rng.random() < 0.4, rng.random() < 0.3, None if rng.random() < 0.1 else rng.random() < 0.5) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, audit string, code string, bad boolean, l1 boolean, l2 boolean")
    got = {(r["layer"], r["target"]): r for r in evaluate.rates_with_intervals(df, [], "audit", ["l1", "l2"], {"all": F.lit(True), "x": F.col("code") == "x"}, "bad", replicates=40).collect()}
    assert set(got) == {(a, t) for a in ("l1", "l2") for t in ("all", "x")}
    for (layer, target), r in got.items():
        k = {"l1": 4, "l2": 5}[layer]
        held = lambda row: target == "all" or row[2] == "x"  # noqa: B023, E731
        values = []
        for rep in range(41):
            w = {c: 1 if rep == 0 else weight(c, rep) for c in {row[1] for row in rows}}
            total = lambda keep: sum(w[row[1]] for row in rows if keep(row))  # noqa: B023, E731
            p = total(lambda row: row[3] and held(row) and row[k]) / max(1, total(lambda row: row[3] and held(row)))
            q = total(lambda row: not row[3] and row[k]) / max(1, total(lambda row: not row[3]))
            values.append((p, q, p - q))
        for j, c in enumerate(evaluate.RATES):
            assert r[c] == pytest.approx(values[0][j])
            ends = np.quantile([v[j] for v in values[1:]], [0.025, 0.975])
            assert (r[f"{c}_low"], r[f"{c}_high"]) == (pytest.approx(ends[0]), pytest.approx(ends[1]))


def test_a_hot_cluster_is_one_row_a_replicate(spark):
    df = spark.range(20_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("audit"), (F.col("id") % 2 == 0).alias("bad"), (F.col("id") % 5 == 0).alias("flag"))
    x = evaluate.rates_with_intervals(df, [], "audit", ["flag"], {"all": F.lit(True)}, "bad", replicates=3)
    plan = x._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # Rows are summed by cluster below the point where clusters are drawn.
    drawn = max(i for i, line in enumerate(plan) if "Generate explode" in line and "replicate" in line)
    assert any("Aggregate [" in line and "_cluster" in line for line in plan[drawn:]), plan
    assert x.first()["n_bad"] == 10_000


def test_only_whole_windows_rise_and_leads_are_strict(spark):
    events = {"a": [1] * 4 + [0] * 20, "b": [0] * 10 + [1] * 10, "c": [0] * 24, "d": [1] * 3}
    rows = [(k, i, v) for k, vs in events.items() for i, v in enumerate(vs)]
    rises = mechanisms.first_exceedance(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], "v", size=4, least=2, times=0.5, base_rows=8)
    got = {r["k"]: (r["exceeds_at"], r["n"]) for r in rises.collect()}
    # a: the first whole window ends at 3 with a sum of 4, over max(2, half of the base 2); b: three of four at 12.
    assert got == {"a": (3, 24), "b": (12, 20), "c": (None, 24), "d": (None, 3)}
    fires = spark.createDataFrame([("a", 3), ("b", 11), ("c", 0)], "k string, fires_at int")
    lead = {r["k"]: (r["ahead"], r["lead"]) for r in mechanisms.lead(fires, rises, ["k"]).collect()}
    assert lead == {"a": (False, None), "b": (True, 1), "c": (False, None), "d": (False, None)}


def test_chance_draws_the_rise(spark):
    leads = [("a", 3000, 1500, 5000), ("b", 4000, None, 6000), ("c", None, 10, 7000), ("d", 2000, 900, 2500)]
    df = spark.createDataFrame(leads, "k string, exceeds_at int, fires_at int, n int")
    r = mechanisms.chance_of_lead(df, ["k"], first=1000, draws=50).first()
    shares, middles = [], []
    for draw in range(1, 51):
        drawn = [(f, 1000 + (n - 1000) * uniform(k, draw)) for k, e, f, n in leads if e is not None]
        ahead = [x - f for f, x in drawn if f is not None and f < x]
        shares.append(len(ahead) / len(drawn))
        if ahead:
            middles.append(np.median(ahead))
    assert r["chance"] == pytest.approx(np.mean(shares)) and r["chance_lead"] == pytest.approx(np.median(middles))
    assert (r["chance_low"], r["chance_high"]) == (pytest.approx(np.quantile(shares, 0.025)), pytest.approx(np.quantile(shares, 0.975)))


def test_chance_leaves_metrology_out(spark):
    alarms = spark.createDataFrame([("j", 5, "virtual_metrology"), ("j", 50, "rules")], "key string, hour int, layer string")
    defects = spark.createDataFrame([(1, "j", 6, 2), (2, "j", 51, 1)], "id int, key string, hour int, qty int")
    layers = {"rules": 8, "virtual_metrology": 24}
    good = spark.createDataFrame([(1, "j", 6), (2, "j", 51), (3, "j", 90)], "gid int, key string, hour int")
    credited = evaluate.lookback_credit(defects, alarms, "key", "hour", layers)
    r = evaluate.coverage_and_chance(credited, "qty", good, ["gid"], alarms, "key", "hour", layers).first()
    assert r["detected"] == 1.0 and r["chance"] == pytest.approx(1 / 3)


def test_weights_of_a_batch_are_those_of_the_hash(spark):
    units = ["", "0", "7", "12345", "x" * 49, "x" * 60, "é"]
    df = spark.createDataFrame([(u,) for u in units], "u string").select("u", F.explode(F.sequence(F.lit(1), F.lit(101))).alias("r"))
    one = {(r["u"], r["r"]): r["w"] for r in df.select("u", "r", evaluate.poisson_weight(F.col("u"), F.col("r"), 7).alias("w")).collect()}
    drawn = evaluate.poisson_weights(units, 101, 7)
    assert all(drawn[r - 1, k] == one[u, r] for k, u in enumerate(units) for r in range(1, 102))


def test_resampled_rates_give_a_row_a_replicate_and_task(spark):
    """No row a cluster and replicate: what is shuffled after the draw doesn't grow with clusters."""
    rows = [(k, k % 3 == 0, None if k % 7 == 0 else k % 2 == 0, "w" if k % 5 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "unit int, bad boolean, flag boolean, season string").unionByName(spark.createDataFrame([(None, True, True, "w")], "unit int, bad boolean, flag boolean, season string"))
    x = evaluate.rates_with_intervals(df, ["season"], "unit", ["flag"], {"all": F.lit(True)}, "bad", replicates=20)
    assert "explode(sequence" not in x._jdf.queryExecution().optimizedPlan().toString()
    got = {r["season"]: r for r in x.collect()}
    assert set(got) == {"w", None}
    for season, r in got.items():
        own = [v for v in [*rows, (None, True, True, "w")] if v[3] == season]
        drawn = evaluate.poisson_weights(["" if v[0] is None else str(v[0]) for v in own], 20, 7)
        on, bad = (np.array([bool(v[k]) for v in own]) for k in (2, 1))
        rate = (drawn @ (on & bad)) / np.maximum(drawn @ bad, 1)
        assert (r["flagged_bad"], r["n_bad"], r["n_good"]) == ((on & bad).sum(), bad.sum(), (~bad).sum())
        assert (r["rate_bad_low"], r["rate_bad_high"]) == (pytest.approx(np.quantile(rate, 0.025)), pytest.approx(np.quantile(rate, 0.975)))
