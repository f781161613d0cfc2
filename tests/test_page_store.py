"""What a crawl round and a look-up of one page read of a page store."""

import re

import pytest
from pyspark.sql import functions as F

from lodescan.operators import crawl as C
from lodescan.operators.signals import single_page
from lodescan.plans.audits import page_audit
from lodescan.session import new_folder
from lodescan.sources import page_store as S

PAGES = "page_id bigint, url string, html string"
BUCKETS = 16


def scans(df):
    """Metrics of the file scans of an executed query: partitions, files and rows read."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        while plan.nodeName().startswith("AdaptiveSparkPlan") or "QueryStage" in plan.nodeName():
            plan = plan.plan() if "QueryStage" in plan.nodeName() else plan.executedPlan()
        if plan.nodeName().startswith("Scan"):
            read = plan.metrics()
            names = ("numPartitions", "numFiles", "numOutputRows")
            found.append({n: read.apply(n).value() for n in names if read.contains(n)})
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def site(spark, sites, pages):
    """Page n of each site links to its pages 2n and 2n + 1."""
    return spark.range(sites * pages).select(
        F.col("id").alias("page_id"), (F.col("id") % sites).alias("s"), (F.floor(F.col("id") / sites) + 1).alias("n")
    ).select(
        "page_id", F.expr("concat('https://s', s, '.com/', n)").alias("url"),
        F.expr("""concat('<a href="/', 2 * n, '">l</a><a href="/', 2 * n + 1, '">r</a>', repeat('x', 500))""").alias("html"),
    )


@pytest.mark.parametrize("pages", [40, 400])
def test_a_round_reads_the_buckets_of_its_frontier(spark, pages):
    """At two sizes: partitions and rows read follow the frontier, not the table."""
    store = S.stored_pages(site(spark, 5, pages), BUCKETS)
    index = C.page_index(store).filter("page_key in ('s0.com/1', 's3.com/2')")
    rows = index.select("page_id", "bucket", "url", "origin", F.lit(1).alias("filled"),
                        F.col("site_key").alias("crawl_site"), F.lit(1).alias("parent_rank"))
    path = new_folder(spark, "frontier")
    rows.write.parquet(path)
    frontier = spark.read.schema(rows.schema).parquet(path).filter("filled < 12")
    found = C.queued_links(frontier, store, None)
    assert sorted(r.page_key for r in found.collect()) == ["s0.com/2", "s0.com/3", "s3.com/4", "s3.com/5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan)
    buckets = {r.bucket for r in rows.collect()}
    html = [s for s in scans(found) if s.get("numPartitions")]
    assert [s["numPartitions"] for s in html] == [len(buckets)]
    assert html[0]["numOutputRows"] == store.filter(F.col("bucket").isin(sorted(buckets))).count()
    assert html[0]["numOutputRows"] < store.count() / 4


def test_the_crawl_of_a_store_is_that_of_a_table(spark):
    pages = site(spark, 3, 30).union(spark.createDataFrame(
        [(900, None, "<p>"), (901, "", "<p>"), (902, "https://s0.com/1", "copy")], PAGES))
    store = S.stored_pages(pages, BUCKETS)
    names = ["site_key", "page_id", "url", "crawl_rank", "level"]
    plain = C.select_crawl(pages, cap=9).select(names).collect()
    assert sorted(C.select_crawl(store, cap=9).select(names).collect()) == sorted(plain) and len(plain) == 27


def test_one_page_is_read_of_a_store(spark):
    path = new_folder(spark, "one-bucket")
    pages = site(spark, 1, 4_000)
    S.write_pages(pages, path, buckets=2, row_group_bytes=64 << 10)
    store = S.read_pages_of(spark, path, PAGES)
    found = single_page(store, "HTTP://www.S0.com/777/", 2)
    assert [r.page_id for r in found.collect()] == [776]
    (read,) = scans(S.page_of(store, F.lit("s0.com/777"), 2).select("page_id", "html"))
    bucket = F.pmod(F.xxhash64(F.lit("s0.com/777")), F.lit(2))
    files = store.filter(F.col("bucket") == bucket).select(F.input_file_name()).distinct().count()
    assert read["numFiles"] == files < store.select(F.input_file_name()).distinct().count()
    assert 1 <= read["numOutputRows"] <= 400
    # an address that no page has passes no Bloom filter
    (read,) = scans(S.page_of(store, F.lit("s0.com/777x"), 2).select("page_id", "html"))
    assert read["numOutputRows"] == 0
    assert page_audit(store, "https://s0.com/5", 2).first().page_id == 4


def test_a_hot_key_is_split(spark):
    """Copies of one address fill a bucket; all of them are stored, and the lowest is read."""
    rows = [(n, "https://a.com/x" if n % 3 else f"https://a.com/{n}", f"<p>{n}") for n in range(200)]
    store = S.stored_pages(spark.createDataFrame(rows, PAGES), 4)
    assert store.count() == 200 and store.columns == ["page_id", "url", "html", "page_key", "bucket"]
    assert single_page(store, "https://a.com/x", 4).first().page_id == 1
    assert S.stored_pages(spark.createDataFrame([], PAGES), 4).collect() == []
