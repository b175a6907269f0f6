"""molding_drift_state on one long job: all five detectors have what they need to read."""

import datetime
import random

from plantlens.plans import molding
from plantlens.plans import queries as own


def test_every_detector_of_the_drift_query_reads(spark, tmp_path):
    draw, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(minutes=5 * k), 0, "view", 40.0 - 20 * (k >= 600) + draw.gauss(0, 1 + 4 * (k >= 700))) for k in range(1000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = own.queries()["molding_drift_state"](spark, str(tmp_path)).collect()
    assert len(got) == 1000 - 24
    for d in molding.DETECTORS:
        assert any(r[d] != 0 for r in got), d
        assert any(r[f"{d}_fire"] for r in got), d
