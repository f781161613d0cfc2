"""Merged tables and repeatable sinks: replays, failures in between, repeated runs."""

import random

import pytest
from pyspark.sql import functions as F

from lodescan.session import new_folder
from lodescan.sources import sinks, upserts as U
from lodescan.streaming.counters import write_daily_counts
from lodescan.streaming.leads import upsert_lead_stream

SCHEMA = "k string, v int, n bigint"


def table(spark, path):
    return {(r.k, r.v, r.n) for r in U.read_upserts(spark, path, SCHEMA).collect()}


def test_batches_merge_by_key(spark):
    """Each batch against a dictionary; batches repeat, at once and later."""
    draw = random.Random(3)
    path, wanted = new_folder(spark, "merged"), {}
    parts = [[(draw.choice(["a", "b", "c", "", None, f"k{i}"]), n, 100 * b + n) for n, i in enumerate(range(8))]
             for b in range(3)]
    for batch_id, part in [(0, parts[0]), (0, parts[0]), (1, parts[1]), (2, parts[2]), (1, parts[1]), (3, [])]:
        U.upsert(spark.createDataFrame(part, SCHEMA), batch_id, path, ["k"], "n", buckets=3)
        for k, v, n in part:
            if k not in wanted or n >= wanted[k][1]:
                wanted[k] = (v, n)
        assert table(spark, path) == {(k, *rest) for k, rest in wanted.items()}


def test_the_latest_row_is_found_without_sorting_whole_files(spark):
    """A key of many rows, null keys and null orders; rows are shuffled before any is sorted."""
    draw = random.Random(4)
    rows = [("hot", n, n) for n in range(400)] + [(draw.choice(["a", "b", None, ""]), n, 1000 + n) for n in range(200)]
    rows += [("unordered", 7, None), ("a", 8, None)]
    draw.shuffle(rows)
    wanted = {}
    for k, v, n in rows:
        if n is not None and n >= wanted.get(k, (0, -1))[1]:
            wanted[k] = (v, n)
    found = U.latest(spark.createDataFrame(rows, SCHEMA), ["k"], "n")
    assert {tuple(r) for r in found.collect()} == {(k, *v) for k, v in wanted.items()} | {("unordered", None, None)}
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in reversed(plan.splitlines()) if "Exchange" in line or "Aggregate" in line]
    assert "Exchange" in steps[0]


def test_a_batch_that_failed_in_between_is_put_in_place_again(spark, monkeypatch):
    path = new_folder(spark, "failed")
    U.upsert(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA), 0, path, ["k"], "n", buckets=1)
    # the driver fails after the merged buckets were stored, and a bucket is lost on the way
    second = spark.createDataFrame([("a", 2, 2)], SCHEMA)
    whole = U._ready
    monkeypatch.setattr(U, "_ready", lambda *_: False)
    U.upsert(second, 1, path, ["k"], "n", buckets=1)
    monkeypatch.setattr(U, "_ready", whole)
    bucket = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=0")
    bucket.getFileSystem(spark._jsc.hadoopConfiguration()).delete(bucket, True)
    U.upsert(second, 1, path, ["k"], "n", buckets=1)
    assert table(spark, path) == {("a", 2, 2), ("b", 1, 1)}


def test_only_touched_buckets_are_written(spark):
    path = new_folder(spark, "touched")
    U.upsert(spark.createDataFrame([(f"k{i}", i, 1) for i in range(40)], SCHEMA), 0, path, ["k"], "n", buckets=8)
    files = {r[0] for r in U.read_upserts(spark, path, SCHEMA).select(F.input_file_name()).distinct().collect()}
    U.upsert(spark.createDataFrame([("k3", 0, 2)], SCHEMA), 1, path, ["k"], "n", buckets=8)
    after = {r[0] for r in U.read_upserts(spark, path, SCHEMA).select(F.input_file_name()).distinct().collect()}
    assert len(files - after) == 1 and len(files & after) == len(files) - 1


def test_leads_of_a_stream_keep_the_last(spark):
    schema = "lead_id int, received_at string, name string, email string"
    folder = new_folder(spark, "lead-batches")
    for part in ([(1, "d1", "Ann", "a@x.y"), (2, "d1", "Bob", "b@x.y")], [(3, "d1", "Ann Lee", "a@x.y"), (4, "d1", "", "b@x.y")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    leads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    blank = {c: F.lit(None).cast("string") for c in ("url", "tier", "score", "business", "works", "broken", "budget")}
    leads = leads.withColumns({**blank, "mockup": F.lit(True)})
    path = new_folder(spark, "latest")
    upsert_lead_stream(leads, path, new_folder(spark, "checkpoint"), 2).awaitTermination()
    rows = U.read_upserts(spark, path, "lead_id int, name string, email string").collect()
    assert {(r.lead_id, r.name) for r in rows} == {(3, "Ann Lee"), (2, "Bob")}


@pytest.mark.parametrize("cut", [1, 3])
def test_days_are_counted_across_batches(spark, cut):
    day = 86_400_000_000
    rows = [("a", "x", 0, 1), ("a", "x", day - 1, 2), ("a", None, day, 3), ("a", "x", 5, 4)]
    schema = "kind string, ip string, ts bigint, event_id bigint"
    folder = new_folder(spark, "day-batches")
    for part in (rows[:cut], rows[cut:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    path = new_folder(spark, "days")
    write_daily_counts(stream, path, new_folder(spark, "checkpoint"), buckets=2).awaitTermination()
    found = U.read_upserts(spark, path, "kind string, ip string, day bigint, requests bigint").collect()
    assert {(r.ip, r.day, r.requests) for r in found} == {("x", 0, 3), ("0.0.0.0", 1, 1)}


def test_a_repeated_run_replaces_its_rows(spark):
    path = new_folder(spark, "runs")
    first = spark.createDataFrame([("s1", "small"), ("s2", "large")], "site_key string, tier string")
    sinks.write_audits(first, path, "monday")
    sinks.write_audits(first, path, "tuesday")
    # site s2 has another tier when monday is run again
    sinks.write_audits(first.withColumn("tier", F.lit("small")), path, "monday")
    rows = spark.read.schema("site_key string, tier string, run string").json(path).collect()
    assert sorted((r.run, r.site_key, r.tier) for r in rows) == [
        ("monday", "s1", "small"), ("monday", "s2", "small"), ("tuesday", "s1", "small"), ("tuesday", "s2", "large")]
