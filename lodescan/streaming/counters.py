"""Requests per kind, ip and UTC day, counted on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.limits import KEYS, day_of, keyed
from ..sources.upserts import BUCKETS, upsert

COUNT_KEYS = [*KEYS, "day"]


def daily_count_stream(requests: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts of tumbling days as they change: (kind, ip, day, requests).

    A day's counter leaves the state once the watermark has passed its end by ``delay``.
    """
    timed = keyed(requests).withColumn("at", F.timestamp_micros("ts")).withWatermark("at", delay)
    counts = timed.groupBy(*KEYS, F.window("at", "1 day").alias("day")).agg(
        F.count("*").alias("requests")
    )
    return counts.select(*KEYS, day_of(F.unix_micros("day.start")).alias("day"), "requests")


def write_daily_counts(
    requests: DataFrame, path: str, checkpoint: str, delay: str = "1 day",
    buckets: int = BUCKETS, **trigger: object,
) -> StreamingQuery:
    """Merge the changed counters of each batch into the table at ``path``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, path, COUNT_KEYS, "requests", buckets)

    return (
        daily_count_stream(requests, delay).writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
