"""The streaming drift state over events read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from ..streaming.drift_state import drift_stream, run_available
from .binding import Bound, table

BOUND = Bound()


@BOUND("""
with recursive n as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as p from events),
e as (select user_id, event_id, p, value as ewma, greatest(0, (value - 20) / 20 - 0.375) as s from n where p = 1
    union all select n.user_id, n.event_id, n.p, 0.2 * n.value + 0.8 * e.ewma, greatest(0, case when e.s > 5 then 0 else e.s end + (n.value - 20) / 20 - 0.375) from e join n on n.user_id = e.user_id and n.p = e.p + 1)
select user_id, event_id, round(ewma, 5) as ewma, round(s, 5) as cusum, s > 5 as signal from e""")
def streaming_drift(spark, d):
    schema = table(spark, d, "events").schema
    out = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder, pattern = (d, "events.parquet")
    x = run_available(spark, folder, pattern, schema, lambda s: drift_stream(s, "user_id", "ts", "event_id", "value", 20.0, 20.0), out)
    return x.select("user_id", "event_id", F.round("ewma", 5).alias("ewma"), F.round("cusum", 5).alias("cusum"), "signal")
