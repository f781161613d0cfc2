"""A table that keeps one row per key, merged batch by batch from a stream.

The table lies in buckets of its keys. A batch reads the buckets that it touches, keeps the row
of the highest ``order`` per key, stores the merged buckets aside, and only then puts them in
place with a dynamic partition overwrite. A driver that fails in between finds the merged
buckets complete when the batch is repeated and puts them in place again; a batch that repeats
later merges anew and changes nothing, as its rows no longer win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64
# parts that the rows of one key are dealt to before they are reduced
KEY_PARTS = 16
# hidden from readers of the table
ASIDE = "_merge"


def _ready(spark: SparkSession, path: str) -> bool:
    return _store(spark, path).exists(_path(spark, f"{path}/_SUCCESS"))


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the highest ``order`` of each key; null is a key like any other.

    Whole rows are sorted for this, so they are shuffled first: a task then holds a part of the
    shuffle, not what a file of well compressed rows unfolds to. A key of many rows is dealt to
    ``KEY_PARTS`` parts, of which each sends one row on.
    """
    rest = [c for c in rows.columns if c not in keys]
    by_key = [*keys, "_part"]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(KEY_PARTS))).repartition(*by_key)
    parts = dealt.groupBy(*by_key).agg(F.max_by(F.struct(*rest), order).alias("last"))
    last = parts.groupBy(*keys).agg(F.max_by("last", F.col(f"last.`{order}`")).alias("last"))
    return last.select(*keys, "last.*").select(*rows.columns)


def read_upserts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(path)


def upsert(
    rows: DataFrame, batch_id: int, path: str, keys: list[str], order: str, buckets: int = BUCKETS
) -> None:
    """Merge the rows of one batch into the table at ``path``."""
    spark = rows.sparkSession
    aside = f"{path}/{ASIDE}/batch={batch_id}"
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if not _ready(spark, aside):
        # of a repeated key a batch sends one row on
        fresh = latest(dealt, [*keys, "bucket"], order)
        merged = fresh
        if _store(spark, path).exists(_path(spark, path)):
            touched = fresh.select(F.col("bucket").alias("touched")).distinct()
            stored = read_upserts(spark, path, schema)
            stored = stored.join(F.broadcast(touched), F.col("bucket") == F.col("touched"), "left_semi")
            merged = latest(stored.unionByName(fresh), [*keys, "bucket"], order)
        for old in _store(spark, path).globStatus(_path(spark, f"{path}/{ASIDE}/batch=*")) or []:
            _store(spark, path).delete(old.getPath(), True)
        merged.write.mode("overwrite").parquet(aside)
    done = spark.read.schema(f"{schema}, bucket int").parquet(aside)
    done.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("bucket").parquet(path)

