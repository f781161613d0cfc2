import random

import pytest
from pyspark.sql import functions as F

from lodescan.operators import limits as M
from lodescan.session import new_folder
from lodescan.streaming.leads import write_lead_stream
from lodescan.streaming.limiter import DAY, late_counts, limit_stream, live_ttl, run_available

SCHEMA = "kind string, ip string, ts bigint, event_id bigint"


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, seed):
    """Micro-batches of random size in time order decide as the batch job does."""
    r = random.Random(seed)
    times = sorted(r.randrange(4 * M.SLICES_PER_WINDOW * 86_400_000) * 1000 for _ in range(300))
    rows = [("audit", r.choice("ab"), t, i) for i, t in enumerate(times)]
    folder, start = new_folder(spark, "requests"), 0
    while start < len(rows):
        end = start + r.randrange(40, 120)
        spark.createDataFrame(rows[start:end], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        start = end
    window, soft, daily = 3 * 3_600_000_000, 3, 8
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run_available(limit_stream(stream, window, soft, daily, ttl_ms=None), spark, "limited")
    batch = M.limiter(spark.createDataFrame(rows, SCHEMA), window, soft, daily)
    key = ["event_id", "soft_ok", "daily_ok", "admitted"]
    assert {tuple(x) for x in out.select(*key).collect()} == {tuple(x) for x in batch.select(*key).collect()}
    assert live_ttl(window) == 90_000_000


def test_late_rows_are_decided_on_arrival(spark):
    """One request per batch: every day has its own counter, however late a request comes."""
    days = [10, 10, 9, 10, 9, 10, 11, 9]
    folder = new_folder(spark, "late")
    for event, day in enumerate(days):
        row = [("audit", None, day * DAY + event, event)]
        spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = run_available(limit_stream(stream, 1, 9, 1, ttl_ms=None), spark, "late-out")
    rows = sorted(out.collect(), key=lambda r: r.event_id)
    used, newest, expected = set(), -1, []
    for event, day in enumerate(days):
        expected.append((event, day not in used, day * DAY + event < newest))
        used.add(day)
        newest = max(newest, day * DAY + event)
    assert [(r.event_id, r.admitted, r.late) for r in rows] == expected
    assert {(r.day, r.late_requests) for r in late_counts(out).collect()} == {(9, 3)}
    assert {r.ip for r in rows} == {"0.0.0.0"}


def test_lead_stream_keeps_rejects(spark):
    rows = [(1, "Ann", "a@x.y"), (2, "", "b@x.y"), (3, "Cy", None)]
    source = new_folder(spark, "lead-source")
    spark.createDataFrame(rows, "lead_id int, name string, email string").write.parquet(source)
    blank = {c: F.lit(None).cast("string") for c in ("url", "tier", "score", "business", "works", "broken", "budget")}
    leads = spark.readStream.schema("lead_id int, name string, email string").parquet(source)
    leads = leads.withColumns({**blank, "mockup": F.lit(True)})
    path = new_folder(spark, "leads")
    write_lead_stream(leads, path, new_folder(spark, "checkpoint")).awaitTermination()
    rows = spark.read.parquet(path).select("lead_id", "accepted", "name", "url").collect()
    assert {(r.lead_id, str(r.accepted)) for r in rows} == {(1, "true"), (2, "false"), (3, "false")}
    assert {r.lead_id: r.url for r in rows} == {1: "", 2: None, 3: None}


def test_a_lead_batch_is_written_without_a_sort(spark):
    """Sorted by folder, a task would hold the whole rows of its part of the batch."""
    columns = ("name", "email", "url", "tier", "score", "business", "works", "broken", "budget")
    rows = [(i, "Ann" if i % 3 else "", *["a"] * 8, True) for i in range(50)]
    schema = "lead_id int, " + ", ".join(f"{c} string" for c in columns) + ", mockup boolean"
    source, path = new_folder(spark, "unsorted-source"), new_folder(spark, "unsorted-leads")
    spark.createDataFrame(rows, schema).write.parquet(source)
    log = spark._jsparkSession.sharedState().statusStore()
    before = log.executionsCount()
    write_lead_stream(spark.readStream.schema(schema).parquet(source), path, new_folder(spark, "unsorted-checkpoint")) \
        .awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = log.executionsList(before, 100)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    writes = [p for p in plans if path in p]
    assert writes and not any("Sort" in p for p in writes)
    out = spark.read.parquet(path).groupBy("accepted").count().collect()
    assert {str(r.accepted): r["count"] for r in out} == {"true": 33, "false": 17}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
