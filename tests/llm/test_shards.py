import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodescan.llm import kd_shards as K


def check(rows, texts, shards, share=1.0):
    """Sizes and sums of the right rows, gapless slots, and near equal bytes."""
    assert len(rows) == len(texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )
    places, sizes = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    total = sum(sizes.values())
    largest = max((r["size"] for r in rows), default=0)
    for shard in range(shards):
        # every cut on the way to a leaf may be off by half of its largest row
        assert abs(sizes[shard] - total / shards) <= share * largest + total / shards / 100


def test_generated_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = K.kd_shards(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 24)


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_hot_values_are_split(spark, shards):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 37).cast("int")).alias("text"),
        F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"),
        F.lit(7).cast("long").alias("n_chars"),
    ).repartition(6)
    rows = K.kd_shards(docs, shards).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], shards)


def test_leaves_are_boxes(spark):
    """With room in one dimension only, shards are its consecutive ranges."""
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), ((F.col("id") * 617) % 1000).alias("n_chars"),
    )
    placed = K.kd_shards(docs, 8).join(docs, "doc_id").groupBy("shard").agg(
        F.min("n_chars").alias("low"), F.max("n_chars").alias("high")
    ).orderBy("shard").collect()
    assert [(r["low"], r["high"]) for r in placed] == [(125 * n, 125 * n + 124) for n in range(8)]


def test_odd_documents(docs, no_docs):
    rows = K.kd_shards(docs, 4).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    assert K.kd_shards(no_docs).collect() == []


def test_written_shards_hold_every_row(spark, small, tmp_path):
    K.write_shards(small, K.kd_shards(small), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == small.count()
    assert back.select("shard").distinct().count() == 24
