"""Grace hash deduplication of whole texts.

Rows are first combined where they lie, so that a text leaves an input task once however many
copies it has there. The surviving texts are written to spill files in the shared folder and
dealt to buckets by hash. A bucket whose texts exceed the byte limit is dealt again under
another seed, with a salt per input task, and combined once more, until every bucket fits the
open-addressing table of one task. Two texts are equal only if their complete contents are.

Rows: a null text counts as empty. Of equal texts the row with the smallest id stays; null ids
come last, and of rows that tie in their id the first in table order stays. An empty table
gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .text import one_spaced

# contents that one task's table may hold
BUCKET_BYTES = 16 << 20
# tasks of one level at most, unless the session asks for more; a task takes its buckets in turn
MOST_TASKS = 10_000
# spill files hold whole texts: the denser codec
SPILL = {"compression": "zstd"}

LINKS = "entry long, root long, hash long, content binary, bucket long"


class ContentTable:
    """Open addressing with linear probing; a slot matches if its complete content is equal."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.labels: list[int] = []
        self.bytes = 0

    def label_of(self, digest: int, content: bytes, label: int) -> int:
        """The label under which an equal content was entered first, else ``label``."""
        mask = len(self.slots) - 1
        at = digest & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == digest and self.contents[found] == content:
                return self.labels[found]
            at = (at + 1) & mask
        self.slots[at] = len(self.labels)
        self.hashes.append(digest)
        self.contents.append(content)
        self.labels.append(label)
        self.bytes += len(content)
        if 2 * len(self.labels) > len(self.slots):
            self._grow()
        return label

    def _grow(self) -> None:
        slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for entry, digest in enumerate(self.hashes):
            at = digest & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry
        self.slots = slots


def _combine_rows(limit: int):
    """Input rows: the first row of a content in this task becomes its entry and keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            rids = batch.column("rid").to_pylist()
            contents = batch.column("content").to_pylist()
            entries, kept = [], []
            for rid, digest, content in zip(
                rids, batch.column("hash").to_pylist(), contents, strict=True
            ):
                if table.bytes > limit:
                    table.clear()
                entry = table.label_of(digest, content, rid)
                entries.append(entry)
                kept.append(content if entry == rid else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"), batch.column("doc_id"), batch.column("hash"),
                    batch.column("digest"), pa.array(entries, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["rid", "doc_id", "hash", "digest", "entry", "content"],
            )

    return run


def _combine_entries(keep_content: bool):
    """Entries in bucket order: each gets the label of the first equal one of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, current = ContentTable(), None
        for batch in batches:
            entries = batch.column("entry").to_pylist()
            roots, kept = [], []
            for entry, digest, content, bucket in zip(
                entries, batch.column("hash").to_pylist(),
                batch.column("content").to_pylist(), batch.column("bucket").to_pylist(),
                strict=True,
            ):
                if bucket != current:
                    table.clear()
                    current = bucket
                root = table.label_of(digest, content, entry)
                roots.append(root)
                kept.append(content if keep_content and root == entry else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("entry"), pa.array(roots, pa.int64()), batch.column("hash"),
                    pa.array(kept, pa.binary()), batch.column("bucket"),
                ],
                ["entry", "root", "hash", "content", "bucket"],
            )

    return run


def _dealt(entries: DataFrame, buckets: int, *keys: str) -> DataFrame:
    wanted = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(buckets, max(MOST_TASKS, wanted))
    return entries.repartition(tasks, *keys).sortWithinPartitions("bucket")


def _resolve(entries: DataFrame, limit: int) -> DataFrame:
    """(entry, root): entries of equal content share a root."""
    total = entries.agg(F.sum(F.length("content"))).first()[0] or 0
    parts = max(1, math.ceil(total / limit))
    waiting = entries.withColumn("bucket", F.pmod("hash", F.lit(parts)))
    fitting: list[DataFrame] = []
    merged: list[DataFrame] = []
    level, last = 0, 0
    while True:
        sizes = materialize(
            waiting.groupBy("bucket").agg(
                F.sum(F.length("content")).alias("bytes"), F.count("*").alias("entries")
            ).filter((F.col("bytes") > 2 * limit) & (F.col("entries") > 1)),
            "dedup-sizes",
        )
        over = sizes.agg(F.sum("bytes"), F.sum("entries")).first()
        if over[0] is None or (merged and over[1] >= last):
            fitting.append(waiting)
            break
        last = over[1]
        level += 1
        fitting.append(waiting.join(sizes, "bucket", "left_anti"))
        share = F.ceil(F.col("bytes") / limit)
        again = (
            waiting.join(sizes, "bucket")
            .withColumn("salt", F.pmod(F.shiftright("entry", 33), share))
            .withColumn(
                "bucket",
                F.xxhash64("bucket", F.pmod(F.xxhash64(F.lit(level), "hash"), share)),
            )
            .select("entry", "hash", "content", "bucket", "salt")
        )
        split = materialize(
            _dealt(again, max(1, math.ceil(over[0] / limit)), "bucket", "salt")
            .select("entry", "hash", "content", "bucket")
            .mapInArrow(_combine_entries(True), LINKS),
            "dedup-spill", **SPILL,
        )
        merged.append(split.filter(F.col("entry") != F.col("root")).select("entry", "root"))
        waiting = split.filter(F.col("entry") == F.col("root")).select(
            "entry", "hash", "content", "bucket"
        )
    final = fitting[0]
    for part in fitting[1:]:
        final = final.unionByName(part)
    roots = materialize(
        _dealt(final, parts, "bucket").mapInArrow(_combine_entries(False), LINKS)
        .select("entry", "root"),
        "dedup-roots",
    )
    for links in reversed(merged):
        upper = roots.select(F.col("entry").alias("root"), F.col("root").alias("upper"))
        roots = roots.unionByName(
            links.join(upper, "root").select("entry", F.col("upper").alias("root"))
        )
    return roots


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    content = one_spaced(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("rid"),
        F.xxhash64("content").alias("hash"),
        F.unhex(F.sha2("content", 256)).alias("digest"),
        F.col("content").cast("binary").alias("content"),
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    spilled = materialize(
        rows.mapInArrow(
            _combine_rows(bucket_bytes),
            f"rid long, doc_id {id_type}, hash long, digest binary, entry long, content binary",
        ),
        "dedup-spill", **SPILL,
    )
    entries = spilled.filter(F.col("content").isNotNull()).select("entry", "hash", "content")
    roots = _resolve(entries, bucket_bytes)

    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    by_entry = spilled.groupBy("entry").agg(
        F.min(rank).alias("first"), F.count("*").alias("rows")
    ).join(roots, "entry")
    by_root = by_entry.groupBy("root").agg(
        F.min("first").alias("first"), F.sum("rows").alias("group_size")
    )
    keepers = by_entry.select("entry", "root").join(by_root, "root").drop("root")
    return spilled.select("rid", "doc_id", "entry", "digest").join(keepers, "entry").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Joined by id and content, so an id used by several texts is decided for each of them;
    of rows that agree in both, one stays.
    """
    stay = decided.filter("kept").select(
        F.col("doc_id").alias("_dedup_id"), F.col("text_sha256").alias("_dedup_digest")
    )
    own = docs.withColumn("_dedup_digest", F.sha2(one_spaced(text_col).cast("binary"), 256)) \
        .withColumn("_dedup_id", F.col(id_col))
    joined = own.join(
        stay.withColumnsRenamed({"_dedup_id": "_stay_id", "_dedup_digest": "_stay_digest"}),
        F.col("_dedup_id").eqNullSafe(F.col("_stay_id"))
        & (F.col("_dedup_digest") == F.col("_stay_digest")),
    )
    return joined.dropDuplicates(["_dedup_id", "_dedup_digest"]).select(*docs.columns)
