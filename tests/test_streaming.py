"""State is carried over batches: two files, one a batch, against one loop."""

import random
from datetime import datetime, timedelta

import pytest

from plantlens.streaming.drift_state import drift_stream, run_available


def test_state_over_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 3, i, datetime(2024, 1, 1) + timedelta(minutes=i), None if i % 11 == 5 else rng.gauss(1, 1)) for i in range(90)]
    schema = "k int, id int, ts timestamp_ntz, v double"
    for part in range(2):
        spark.createDataFrame(rows[part * 45 : part * 45 + 45], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r["id"]: r for r in run_available(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], schema).schema, lambda s: drift_stream(s, "k", "ts", "id", "v", 0.0, 1.0, h=2.0), str(tmp_path / "out")).collect()}
    assert len(got) == 90
    for k in range(3):
        ewma, total, seen = None, 0.0, 0
        for key, i, _, v in rows:
            if key == k:
                fired = False
                if v is not None:
                    ewma = v if not seen else 0.2 * v + 0.8 * ewma
                    total, seen = max(0.0, total + v - 0.375), seen + 1
                    fired = total > 2.0
                assert got[i]["cusum"] == pytest.approx(total) and got[i]["signal"] == fired
                assert ewma is None or got[i]["ewma"] == pytest.approx(ewma)
                total = 0.0 if fired else total
