"""WARC archives with revisit records.

The headers of all records are shuffled by payload digest; per digest the record with the
largest page id is the original. Records that are not are joined with it and written as
revisits, which name the original and carry no payload. Archives are text files with one
record per row and the empty lines between records as the line separator, so Spark's own
writer and its commits write them, to any store. They are read back by the lengths the
headers declare, and the digests are taken again from the payloads found; a revisit gets its
payload's facts from its original in the archive.

Rows: a null html is an empty payload, a null url is left out of the record. Null page ids
come before all others; of records that tie in page id and payload all are responses. An
empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize, new_folder

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
# payloads of fewer bytes are always written as responses
MIN_PAYLOAD = 0
# records of one archive file: a reader holds a file packed, and one record of it unpacked
FILE_RECORDS = 1_000
END = "\r\n"
BASE32_FROM, BASE32_TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits as four numbers of eight digits."""
    digest = F.sha1(content.cast("binary"))
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * n, 10), 16, 32), 8, "0") for n in range(4)
    ]
    return F.translate(F.concat(*parts), BASE32_FROM, BASE32_TO)


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name-based identifier, the same whenever the archive is written again."""
    code = F.md5(F.concat_ws(":", page_id.cast("string"), digest).cast("binary"))
    parts = [F.substring(code, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null; controls, which would break the line, are escaped."""
    plain = F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", "%20")
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit(END)), F.lit(""))


def resolve_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Pages as page_id, url, payload, payload_digest, refers_to and its url; headers only
    are shuffled by digest, and a page's payload at most once, by its own id."""
    headers = pages.select(
        F.col("page_id"), F.col("url"),
        F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"),
        base32_sha1(F.coalesce("html", F.lit(""))).alias("digest"),
    )
    # stored, so that the join meets it as a table of its own and can split a hot digest
    originals = materialize(
        headers.filter(F.col("bytes") >= min_payload).groupBy("digest").agg(
            F.max(F.struct("page_id", "url")).alias("original")
        ),
        "originals",
    )
    revisits = (
        headers.join(originals, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("original.page_id")))
        .select(
            F.col("page_id").alias("_id"), F.col("digest").alias("_digest"),
            F.col("original.page_id").alias("refers_to"),
            F.col("original.url").alias("refers_to_url"),
            F.lit(True).alias("revisit"),
        ).distinct()
    )
    own = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumn("payload_digest", base32_sha1(F.col("payload")))
    return own.join(
        revisits,
        F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")),
        "left",
    ).drop("_id", "_digest").withColumn("revisit", F.coalesce("revisit", F.lit(False)))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """One text per record, as it stands in the archive without its closing empty lines."""
    size = F.octet_length("payload")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        size.cast("string"), F.lit(END * 2),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    original = F.when(F.col("revisit"), _record_id(F.col("refers_to"), F.col("payload_digest")))
    made = resolved.withColumn("_block", block)
    return made.select(F.concat(
        F.lit(VERSION + END),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", digest),
        _line("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _line("WARC-Refers-To", original),
        _line("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.col("refers_to_url"))),
        _line("Page-ID", F.col("page_id")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        _line("Content-Length", F.octet_length("_block")),
        F.lit(END), F.col("_block"),
    ).alias("record"))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD,
                   file_records: int = FILE_RECORDS) -> None:
    """Write the deduplicated archive of ``pages`` (page_id, url, html) as gzip files."""
    records(resolve_revisits(pages, min_payload)).write.options(
        lineSep=END * 2, compression="gzip", maxRecordsPerFile=file_records
    ).text(path)


def _parsed(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by the declared lengths."""
    end = END.encode()
    while version := archive.readline():
        if version != VERSION.encode() + end:
            raise ValueError(f"no record starts with {version[:40]!r}")
        fields = {}
        while (line := archive.readline()) != end:
            name, _, value = line.decode("utf-8").removesuffix(END).partition(": ")
            fields[name] = value
        block = archive.read(int(fields["Content-Length"]))
        if archive.read(4) != end * 2:
            raise ValueError(f"{fields.get('WARC-Record-ID')} does not end where it says")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_type", "record_id", "refers_to_id", "page_id", "url", "payload_bytes",
             "payload_digest"]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in _parsed(gzip.open(pa.BufferReader(content.as_buffer()))):
                response = fields["WARC-Type"] == "response"
                payload = block[block.index(b"\r\n\r\n") + 4:] if response else b""
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if response and fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                page = fields.get("Page-ID")
                rows.append((
                    fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"),
                    None if page is None else int(page), fields.get("WARC-Target-URI"),
                    len(payload) if response else None, digest if response else None,
                ))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive with its payload's facts, revisits by their original."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path) \
        .select("content")
    found = materialize(files.mapInArrow(
        _read,
        "record_type string, record_id string, refers_to_id string, page_id long, url string, "
        "payload_bytes long, payload_digest string",
    ), "warc-records")
    originals = materialize(
        found.filter("record_type = 'response'").groupBy("record_id").agg(
            F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("bytes"),
            F.max("payload_digest").alias("digest"),
        ).withColumnRenamed("record_id", "original_id"),
        "warc-originals",
    )
    # a response looks itself up: rows without a reference would all meet in one task
    wanted = F.coalesce("refers_to_id", "record_id")
    return found.join(originals, wanted == F.col("original_id"), "left").select(
        "page_id", "url", F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"),
    )


def archived(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, min_payload)
    return read_archives(spark, path)
