import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodescan.llm import exact_dedup as E


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    """doc_id, keep_id, size, digest of each row, by plain grouping."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[normal(text)]
        known = [i for i in ids if i is not None]
        out.append((doc_id, min(known) if known else None, len(ids),
                    hashlib.sha256(normal(text).encode()).hexdigest()))
    return sorted(out, key=str)


def got(result):
    return sorted(
        ((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])
         for r in result.collect()), key=str,
    )


# bytes per bucket: one bucket, a few, and so few that every level of recursion is needed
@pytest.mark.parametrize("size", [16 << 20, 20_000, 40])
def test_groups_equal_plain_grouping(docs, size):
    result = E.exact_dedup(docs.repartition(3, F.rand(1)), bucket_bytes=size)
    assert got(result) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_one_row_of_a_group_stays(docs):
    rows = E.exact_dedup(docs).collect()
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_no_rows(no_docs):
    assert E.exact_dedup(no_docs).collect() == []


@pytest.mark.parametrize("size", [16 << 20, 30_000])
def test_generated_documents(small, size):
    many = small.unionByName(small.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 9000))
    for _ in range(3):  # a group that outweighs all others
        many = many.unionByName(
            many.filter("doc_id = 3 or doc_id > 20000").withColumn("doc_id", F.col("doc_id") + 20000)
        )
    result = E.exact_dedup(many.repartition(5, "doc_id"), bucket_bytes=size)
    assert got(result) == expected([(r["doc_id"], r["text"]) for r in many.collect()])


def test_kept_rows_carry_their_columns(docs):
    kept = E.kept_rows(docs, E.exact_dedup(docs))
    assert kept.columns == docs.columns
    texts = [normal(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({normal(r["text"]) for r in docs.collect()})


def test_table_compares_contents_not_hashes():
    table = E.ContentTable()
    assert table.label_of(5, b"a", 1) == 1
    assert table.label_of(5, b"b", 2) == 2
    assert table.label_of(5, b"a", 3) == 1
    for n in range(500):
        assert table.label_of(64 * n, str(n).encode(), 100 + n) == 100 + n
    assert table.label_of(64 * 7, b"7", 0) == 107
