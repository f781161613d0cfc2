"""Token ids of documents in ORC files, in the order of the document ids.

An ORC file is a sequence of stripes, each readable alone: ids are integer columns under ORC's
run-length encoding (two bytes an id here), every ``STRIDE`` rows have an entry in the row
index, and a Bloom filter on the document id stands beside it. Spark's reader deals stripes to
tasks, and a filter on ``doc_id`` goes to stripe statistics, row index and Bloom filter before
an id is decoded.

Texts are put in order by ranges of their ids, encoded, and written, one file a range: the
texts are what is shuffled, as they take less room than ids. A row also holds its ``part`` and
its ``place`` in the order; the number of ids before a document follows from the lengths, added
up inside a part and over the parts.

Rows: a null text counts as empty and holds the end id alone. Rows without a document id come
first; rows of equal ids follow a hash of their texts, repeated rows their order in the input,
so a hot id is shared by several ranges. Texts are encoded whole. An empty table gives no rows.
Only the two named columns are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize, new_folder
from .order import ROW_BITS
from .packing import encoder
from .text import tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
# rows under one entry of the row index and one Bloom filter
STRIDE = 1_000
STRIPE_BYTES = 16 << 20
# rows after which a writer looks at the size of its stripe; a row may be a very long document
CHECKED_ROWS = 100
FALSE_POSITIVES = 0.01
# texts encoded together
TOGETHER = 256


def in_id_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, content) in ranges of the document ids, each sorted."""
    ties = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content")
    ).select(
        "doc_id", F.xxhash64("content").alias("tie"), F.monotonically_increasing_id().alias("row"),
        "content",
    )
    order = ["doc_id", "tie", "row"]
    return ties.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "content")


def encoded(texts: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of (doc_id, content): the token ids of every whole text, the end id last."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                ends, values = encoder(path).ids(part["content"])
                values = np.insert(values, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([part["doc_id"], ids], ["doc_id", "ids"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def write_tokens(
    rows: DataFrame, path: str, stride: int = STRIDE, stripe_bytes: int = STRIPE_BYTES,
) -> None:
    """Write (doc_id, ids), which lie in the order of the ids, as one ORC file a part."""
    place = F.monotonically_increasing_id()
    placed = rows.select(
        "doc_id", F.shiftright(place, ROW_BITS).cast("int").alias("part"),
        place.bitwiseAND((1 << ROW_BITS) - 1).alias("place"), "ids",
    )
    placed.write.options(**{
        "compression": "zstd",
        "orc.stripe.size": stripe_bytes,
        "orc.rows.between.memory.checks": CHECKED_ROWS,
        "orc.create.index": "true",
        "orc.row.index.stride": stride,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": FALSE_POSITIVES,
    }).orc(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(doc_id, part, place, ids) as stored; filters on doc_id, part and place skip stripes."""
    return spark.read.schema(f"doc_id {id_type}, part int, place long, ids array<int>").orc(path)


def tokens_of(store: DataFrame, wanted: list[int]) -> DataFrame:
    """The rows of some documents, found by statistics, row index and Bloom filter."""
    return store.filter(F.col("doc_id").isin(wanted))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        ends = ids.offsets.to_numpy()
        words = memoryview(ids.values.to_numpy()).cast("B")
        codes = [zlib.crc32(words[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["part"], batch["place"],
             pa.array(np.diff(ends), pa.int64()), pa.array(codes, pa.int64())],
            ["doc_id", "part", "place", "n_tokens", "ids_crc32"],
        )


def token_index(store: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    Only narrow rows are shuffled, by part, and a part is what one task wrote.
    """
    kind = store.schema["doc_id"].dataType.simpleString()
    lengths = materialize(
        store.mapInArrow(
            _sums, f"doc_id {kind}, part int, place long, n_tokens long, ids_crc32 long"
        ),
        "token-lengths",
    )
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.groupBy("part").agg(F.sum("n_tokens").alias("held")).select(
        "part", F.coalesce(F.sum("held").over(parts), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(
        bases, "part"
    ).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def stored_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, end_id: int = END_ID, path: str | None = None,
) -> DataFrame:
    """Encode, write to ``path`` (by default a new shared folder) and index what was read back."""
    spark = docs.sparkSession
    path = path or os.path.join(new_folder(spark, "token-store"), "orc")
    write_tokens(encoded(in_id_order(docs, id_col, text_col), vocabulary, end_id), path)
    kind = docs.schema[id_col].dataType.simpleString()
    return token_index(read_tokens(spark, path, kind))
