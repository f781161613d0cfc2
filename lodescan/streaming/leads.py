"""Lead stream: validate each micro-batch, append the accepted and set the rejected aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.leads import is_complete, shortened
from ..sources.sinks import LEAD_KEYS
from ..sources.upserts import BUCKETS, upsert


def write_lead_stream(
    leads: DataFrame, path: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Write leads under ``path``/batch=n/accepted=true and false, in one pass per batch.

    Each batch replaces its own folder, so a repeated batch leaves no second copy. ``trigger``
    is that of a stream writer; without one the source is processed as far as it goes now.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # a task keeps both folders' files open and need not sort its rows by folder; the
        # session is the query's own
        batch.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", 2)
        marked = batch.withColumn("accepted", is_complete())
        shortened(marked, F.col("accepted")).write.mode("overwrite") \
            .partitionBy("accepted").parquet(f"{path}/batch={batch_id}")

    return (
        leads.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def upsert_lead_stream(
    leads: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, **trigger: object
) -> StreamingQuery:
    """Keep the last accepted lead of each (received_at, email) under ``path``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(shortened(batch.filter(is_complete())), batch_id, path, LEAD_KEYS, "lead_id", buckets)

    return (
        leads.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
