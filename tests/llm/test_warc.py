import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from lodescan.llm import warc as W

PAGES = [
    (1, "http://a.example/1", "<p>same</p>"),
    (2, "http://a.example/2", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (4, "http://b.example/\r\nx", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (5, "http://b.example/5", None),
    (6, "http://b.example/6", ""),
    (7, "http://b.example/é", "<p>日本 \r\n\r\n é</p>\n"),
    (8, "http://c.example", "x" * 300_000),
    (None, "http://c.example/none", "<p>same</p>"),
    (9, "http://c.example/9", "twice"),
    (9, "http://c.example/9", "twice"),
]
SCHEMA = "page_id long, url string, html string"


def expected(rows, least=0):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        top = max((p for p in groups[html or ""] if p is not None), default=None)
        again = len(payload) >= least and page != top
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def got(result):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in result.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5, 100])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    assert got(W.archived(pages, least)) == expected(PAGES, least)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    copies = pages.selectExpr("page_id + 1000 as page_id", "url", "html").filter("page_id % 3 = 0")
    both = pages.unionByName(copies)
    assert got(W.archived(both)) == expected([tuple(r) for r in both.collect()])


def test_no_pages(spark):
    assert W.archived(spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    """A reader that knows nothing but the format finds every payload."""
    pages = spark.createDataFrame(PAGES, SCHEMA)
    W.write_archives(pages, str(tmp_path / "out"), file_records=3)
    files = sorted((tmp_path / "out").glob("*.gz"))
    assert len(files) > 1
    payloads, kinds = [], []
    for file in files:
        data = gzip.decompress(file.read_bytes())
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            block, data = data[:size], data[size:]
            assert data[:4] == b"\r\n\r\n"
            data = data[4:]
            kinds.append(fields["WARC-Type"])
            if fields["WARC-Type"] == "response":
                payloads.append(block.partition(b"\r\n\r\n")[2].decode())
            else:
                assert fields["WARC-Refers-To"].startswith("<urn:uuid:")
                assert fields["WARC-Profile"] == W.PROFILE
    assert len(kinds) == len(PAGES)
    assert set(payloads) == {html or "" for _, _, html in PAGES}
