"""EWMA and CUSUM of each series over a stream, in one pass with a state of three numbers a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "ewma double, cusum double, seen long"


def drift_stream(stream: DataFrame, key: str, ts: str, row_id: str, value: str, target: float, sigma: float, weight: float = 0.2, k: float = 0.375, h: float = 5.0) -> DataFrame:
    """key, row_id, ewma, cusum, signal for each row of the stream.

    A series starts at its first value; the sum starts anew after a signal. Rows of a batch are taken in time order; a
    row that comes in a later batch than its successors is taken when it comes. A null value leaves the state as it is.
    """
    kind = dict(stream.dtypes)
    out = f"{key} {kind[key]}, {row_id} {kind[row_id]}, ewma double, cusum double, signal boolean"

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ewma, total, seen = state.get if state.exists else (0.0, 0.0, 0)
        pdf = pd.concat(list(batches)).sort_values([ts, row_id])
        rows = []
        for i, x in zip(pdf[row_id], pdf[value], strict=True):
            signal = False
            if not pd.isna(x):
                ewma = float(x) if seen == 0 else weight * float(x) + (1 - weight) * ewma
                total, seen = max(0.0, total + (float(x) - target) / sigma - k), seen + 1
                signal = total > h
            rows.append((group[0], i, ewma if seen else None, total, signal))
            total = 0.0 if signal else total
        state.update((ewma, total, seen))
        yield pd.DataFrame(rows, columns=[key, row_id, "ewma", "cusum", "signal"])

    return stream.groupBy(key).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, folder: str, pattern: str, schema, transform, out: str, files_a_batch: int = 1) -> DataFrame:
    """All that a folder's files now hold through a streaming transform into a table at `out`, exactly once; the table."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    result = transform(stream)
    query = result.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/data")
