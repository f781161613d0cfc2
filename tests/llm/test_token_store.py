import array
import glob
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodescan.llm import token_store as T
from lodescan.llm.text import tokenizer_path


def slow(rows):
    """Encode with the library, in the order of the ids; rows of equal ids in any order."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(T.VOCABULARY))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_generated_documents(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    random.Random(1).shuffle(rows)
    assert got(T.stored_tokens(small)) == slow(rows)


def test_odd_documents(docs, no_docs):
    found, wanted = got(T.stored_tokens(docs)), slow([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((str(r[0]), *r[2:]) for r in found) == sorted((str(r[0]), *r[2:]) for r in wanted)
    assert [r[0] for r in found] == [r[0] for r in wanted]  # nulls first, then by id
    start = 0
    for _, begins, length, _ in found:
        assert begins == start
        start += length
    assert T.stored_tokens(no_docs).collect() == []


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """20,000 rows of 60 ids in many stripes."""
    path = str(tmp_path_factory.mktemp("orc") / "store")
    rows = spark.range(0, 20_000, 1, 2).select(
        (F.col("id") * 3).alias("doc_id"),
        F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (F.hash("id", i) % 49_000).cast("int")).alias("ids"),
    )
    T.write_tokens(rows, path, stripe_bytes=100_000)
    return path


def test_files_have_stripes_index_and_bloom_filters(store):
    from pyarrow import orc

    files = [orc.ORCFile(f) for f in glob.glob(f"{store}/*.orc")]
    assert sum(f.nrows for f in files) == 20_000
    assert max(f.nstripes for f in files) > 1
    assert {f.row_index_stride for f in files} == {T.STRIDE}
    # a stripe is read alone
    assert files[0].read_stripe(files[0].nstripes - 1).num_rows > 0


def scanned(df):
    """Rows that the scan below a filter gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_ids_are_found_by_metadata(spark, store):
    rows = T.read_tokens(spark, store)
    assert scanned(rows) == 20_000
    found = T.tokens_of(rows, [30_000])
    assert [r["doc_id"] for r in found.collect()] == [30_000]
    assert scanned(found) <= 2 * T.STRIDE  # one group of the row index
    # an id between others is in the range of a group, and in no Bloom filter
    assert scanned(T.tokens_of(rows, [30_001])) == 0


def test_stripes_are_dealt_to_tasks(spark, store):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = T.read_tokens(spark, store)
        files = len(glob.glob(f"{store}/*.orc"))
        assert rows.rdd.getNumPartitions() > files
        assert rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_of_a_hot_id_keep_an_order(spark):
    rows = [(7 if n % 3 else n, f"word{n} " * (n % 5)) for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, wanted = got(T.stored_tokens(df)), slow(rows)
    assert sorted((r[0], *r[2:]) for r in found) == sorted((r[0], *r[2:]) for r in wanted)
    assert sum(r[2] for r in found[:-1]) == found[-1][1]
