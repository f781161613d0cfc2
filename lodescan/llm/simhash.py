"""SimHash fingerprints and multi-index hashing.

A fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most two
bits, their high segments differ in at most one bit, or their low segments are equal. So each
fingerprint enumerates the Hamming ball of radius 1 around its high segment (33 probes) and of
radius 0 around its low segment, fetches what the table holds under these keys, and verifies
the complete distance.

A segment value that very many distinct fingerprints share would be compared in pairs. Such
buckets are counted, taken out of the table, and all fingerprints that own or probe one go
another, equally exact way: two fingerprints are at most two bits apart if and only if some
64-bit word is at most one bit from both, so each enumerates the 65 words around itself, and
those that meet at a word are linked to the smallest there. At most 65 can meet at one word.

Rows: a null or empty text has fingerprint zero, which links like any other. Ids may repeat;
null ids get a component but never name it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .components import components

WORDS_PER_SHINGLE = 3
SEED = 42
DISTANCE = 2
# distinct fingerprints under one segment value that are still compared in pairs
BUCKET_LIMIT = 64
# shingle hashes turned into bits at a time
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = WORDS_PER_SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [
            xxh64_intdigest(joined[i:j], SEED)
            for i, j in zip(
                starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(),
                strict=True,
            )
        ]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, ">u8")
    for at in range(0, len(values), BLOCK):
        bits = np.unpackbits(values[at:at + BLOCK].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array(
            [fingerprint(t.as_buffer().to_pybytes()) for t in batch.column("content")],
            np.uint64,
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as the long with the same bits."""
    id_type = docs.schema[id_col].dataType.simpleString()
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).mapInArrow(
        _fingerprints, f"doc_id {id_type}, fp long"
    )


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _key(segment: int, value: Column) -> Column:
    return value * 2 + segment


def links(prints: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all that link."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    table = prints.select(
        F.col("fp").alias("b"), F.explode(F.array(_key(0, high), _key(1, low))).alias("key")
    )
    ball = [high] + [high.bitwiseXOR(F.lit(1 << k)) for k in range(32)]
    probes = prints.select(
        F.col("fp").alias("a"),
        F.explode(F.array(*[_key(0, v) for v in ball], _key(1, low))).alias("key"),
    )
    crowded = materialize(
        table.groupBy("key").count().filter(F.col("count") > bucket_limit).select("key"),
        "crowded",
    )
    verified = (
        probes.join(table.join(crowded, "key", "left_anti"), "key")
        .filter((F.col("a") < F.col("b")) & (_differing("a", "b") <= DISTANCE))
        .select("a", "b")
    )
    around = probes.join(crowded, "key", "left_semi").select("a").distinct()
    words = [F.col("a")] + [F.col("a").bitwiseXOR(F.lit(_signed(k))) for k in range(64)]
    met = (
        around.select("a", F.explode(F.array(*words)).alias("word"))
        .groupBy("word").agg(F.collect_list("a").alias("near"))
        .filter(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
        .filter("a < b")
    )
    return verified.unionByName(met)


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64 if bit == 63 else 0)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-prints"
    )
    roots = components(links(distinct, bucket_limit))
    classed = distinct.join(
        roots.withColumnRenamed("node", "fp"), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    named = classed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = classed.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, with their own columns.

    Rows without an id can't be told apart and stay; so do all rows with an id that names one.
    """
    found = simhash_components(docs, id_col, text_col)
    stay = (
        found.filter(F.col("doc_id") == F.col("component_id"))
        .select(F.col("doc_id").alias("_stay_id")).distinct()
    )
    return docs.join(stay, F.col(id_col) == F.col("_stay_id"), "left_semi").unionByName(
        docs.filter(F.col(id_col).isNull())
    )
