"""Trailing means from differences of running sums: those of the frame alone, at a cost that doesn't grow with it."""

import math
import random

from plantlens.operators import spc


def test_trailing_level_is_that_of_the_frame(spark):
    draw, n = random.Random(1), 700
    values = {
        "constant": [0.1] * n,
        "steps": [(0.1, 1234.567, 0.001, 7.3)[k // 175] for k in range(n)],
        "nulls": [draw.gauss(200, 30) if k % 17 else None for k in range(n)],
        "wide": [draw.gauss(0, 1) * 10.0 ** draw.randint(-6, 9) for k in range(n)],
        "odd": [{300: math.nan, 420: math.inf, 500: -math.inf}.get(k, draw.random()) for k in range(n)],
    }
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, i int, value double")
    x = spc.trailing_level(df, ["k"], ["i"], 50)
    for r in x.collect():
        before = [v for v in values[r["k"]][max(0, r["i"] - 50) : r["i"]] if v is not None]
        assert r["recent_n"] == len(before)
        if not before:
            assert r["recent_mean"] is None
        elif all(map(math.isfinite, before)):
            assert abs(r["recent_mean"] - math.fsum(before) / len(before)) <= 1e-15 * max(map(abs, before))
        else:
            assert r["recent_mean"] == sum(before) or math.isnan(r["recent_mean"]) and math.isnan(sum(before))
        if r["k"] == "constant" and before or r["k"] == "steps" and len(set(before)) == 1:
            assert r["recent_mean"] == before[0]
