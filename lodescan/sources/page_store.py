"""A page table laid out for look-ups: buckets of page keys, sorted by key inside.

The store is written once and serves both kinds of look-up. A crawl carries the bucket of each
page it is about to read, so the join with a round's few pages prunes the partitions of the html
scan at run time. A request for one address computes its bucket as a constant; inside it the
statistics and Bloom filter on ``page_key`` leave one row group to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.urls import Url
from ..session import new_folder

BUCKETS = 1024
ROW_GROUP_BYTES = 32 << 20
# distinct keys a Bloom filter of a row group is laid out for
BLOOM_KEYS = 20_000


def bucket_of(page_key: Column, buckets: int) -> Column:
    """The bucket of a page key; pages without a key have one too."""
    return F.pmod(F.xxhash64(page_key), F.lit(buckets)).cast("int")


def write_pages(
    pages: DataFrame, path: str, buckets: int = BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Store (page_id, url, html, ...) with its ``page_key`` under ``bucket=n`` folders.

    The rebalance keeps a bucket together where it fits and splits one that a hot key fills.
    """
    keyed = pages.withColumn("page_key", Url(F.col("url")).key)
    dealt = keyed.withColumn("bucket", bucket_of(F.col("page_key"), buckets)).hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "page_key", "page_id").write.partitionBy("bucket").options(**{
        "parquet.block.size": row_group_bytes,
        "parquet.bloom.filter.enabled#page_key": "true",
        "parquet.bloom.filter.expected.ndv#page_key": BLOOM_KEYS,
    }).parquet(path)


def read_pages_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored pages; ``schema`` is that of the table without page_key and bucket."""
    return spark.read.schema(f"{schema}, page_key string, bucket int").parquet(path)


def stored_pages(pages: DataFrame, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """``pages`` as a store of its own, under the shared folder unless ``path`` says where."""
    path = path or new_folder(pages.sparkSession, "page-store")
    write_pages(pages, path, buckets)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return read_pages_of(pages.sparkSession, path, schema)


def html_of(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (page_id, bucket, ...) with the html of its pages.

    Only the buckets of ``wanted`` are scanned when ``pages`` is a store and the planner
    broadcasts ``wanted``; a table without buckets is joined by id.
    """
    if "bucket" in pages.columns and "bucket" in wanted.columns:
        # the range marks the join as selective, which dynamic pruning asks for
        chosen = wanted.filter(F.col("bucket") >= 0)
        return pages.select("page_id", "bucket", "html").join(chosen, ["bucket", "page_id"])
    return pages.select("page_id", "html").join(wanted, "page_id")


def page_of(pages: DataFrame, key: Column, buckets: int) -> DataFrame:
    """Rows of a store under one page key, a constant: one bucket, and in it the row groups that
    may hold the key."""
    return pages.filter((F.col("page_key") == key) & (F.col("bucket") == bucket_of(key, buckets)))
