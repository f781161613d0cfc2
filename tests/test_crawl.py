import random

import pytest
from pyspark.sql import functions as F

from lodescan.operators import crawl as C
from lodescan.operators.grouping import first_per_key, number_within, top_per_group
from lodescan.plans import audits as P
from lodescan.sources.sitemaps import sitemap_seeds, sitemap_totals, sitemap_urls
from lodescan.sources.tables import usable_pages


def fifo(pages, seeds, cap, per_page):
    """The crawl as a queue, one site at a time, over lower-case single-host paths."""
    by_path = {}
    for page_id, host, path, links in sorted(pages):
        by_path.setdefault((host, path), (page_id, links))
    plan = []
    for host in sorted({p[1] for p in pages}):
        root = min(p for p in pages if p[1] == host)
        queue, seen, found = [root[2]] + seeds.get(host, []), set(), []
        while queue and len(found) < cap:
            path = queue.pop(0)
            if path in seen:
                continue
            seen.add(path)
            if (host, path) not in by_path:
                continue
            page_id, links = by_path[host, path]
            found.append(page_id)
            queue += links[:per_page]
        plan += [(host, page_id, rank + 1) for rank, page_id in enumerate(found)]
    return set(plan)


def random_sites(seed):
    r = random.Random(seed)
    pages, page_id = [], 0
    for host, size in [("big.example", 60), ("mid.example", 14), ("one.example", 1)]:
        for n in range(size):
            links = [f"/p{r.randrange(size + 10)}" for _ in range(r.randrange(7))]
            pages.append((page_id, host, f"/p{n // 2 if n % 9 == 8 else n}", links))
            page_id += 1
    seeds = {"big.example": [f"/p{r.randrange(70)}" for _ in range(4)]}
    return pages, seeds


@pytest.mark.parametrize("seed, cap, per_page", [(1, 12, 80), (2, 15, None), (3, 4, 2)])
def test_crawl_equals_queue(spark, seed, cap, per_page):
    pages, seeds = random_sites(seed)
    rows = [
        (i, f"https://{h}{p}", "".join(f'<a href="{x}">x</a>' for x in links) + "<p>")
        for i, h, p, links in pages
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    seed_rows = [
        (f"https://{h}", 0, pos, h + path, f"https://{h}{path}") for h, paths in seeds.items() for pos, path in enumerate(paths)
    ]
    seed_df = spark.createDataFrame(seed_rows, "origin string, file_no int, pos int, page_key string, url string")
    plan = C.select_crawl(df, seed_df, cap, per_page)
    got = {(r.site_key, r.page_id, r.crawl_rank) for r in plan.collect()}
    assert got == fifo(pages, seeds, cap, per_page)


def test_links_to_other_origins_and_assets_are_not_followed(spark):
    html = '<a href="http://a.com/b">o</a><a href="https://www.a.com/c">w</a><a href="/d.pdf">f</a><a href="/e">e</a>'
    rows = [(0, "https://a.com/", html)] + [
        (i, f"https://a.com/{p}", "<p>") for i, p in enumerate(["b", "c", "d.pdf", "e"], 1)
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    plan = C.select_crawl(df)
    assert [r.page_id for r in plan.orderBy("crawl_rank").collect()] == [0, 4]


def test_links_are_resolved_against_the_queued_address(spark):
    """A page stored under another spelling of its site goes on linking inside the crawl."""
    rows = [
        (0, "https://a.com/", '<a href="/b">b</a>'), (1, "http://www.a.com/b", '<a href="/c">c</a>'),
        (2, "https://a.com/C/", '<a href="?q=1">q</a><a href="d">d</a>'), (3, "https://www.a.com/d", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    plan = C.select_crawl(df).orderBy("crawl_rank").collect()
    assert [(r.page_id, r.url) for r in plan] == [
        (0, "https://a.com/"), (1, "https://a.com/b"), (2, "https://a.com/c"), (3, "https://a.com/d")]


def test_only_frontier_pages_are_searched_for_links(spark, monkeypatch):
    """A site that its sitemap fills needs no link; of the others, pages found last only."""
    read = []
    whole = C.page_links

    def watched(pages, *rest):
        read.append(sorted(r.page_id for r in pages.select("page_id").collect()))
        return whole(pages, *rest)

    monkeypatch.setattr(C, "page_links", watched)
    rows = [(i, f"https://a.com/{i}", '<a href="/1">x</a><a href="/4">y</a>') for i in range(6)]
    rows += [(10 + i, f"https://b.com/{i}", '<a href="/1">x</a>') for i in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame(
        [("https://a.com", 0, i, f"a.com/{i}", f"https://a.com/{i}") for i in range(6)],
        "origin string, file_no int, pos int, page_key string, url string")
    plan = C.select_crawl(df, seeds, cap=3)
    assert sorted(r.page_id for r in plan.collect()) == [0, 1, 2, 10, 11]
    assert read == [[10], [11]]


def test_a_large_site_keeps_all_its_sitemap_pages(spark, monkeypatch):
    from checks import inputs as I

    monkeypatch.setattr(I, "SITEMAP_PLAIN_PAGES", 5)
    host = next(h for h in (f"abc{c}defgh.example" for c in "abcdefghijklmnop") if spark.sql(
        f"SELECT {I.SITE_NO.replace('host', repr(h))} % 4 = 2 AS x").first().x)
    rows = [(i, f"https://{host}/{i}", host, f"https://{host}", i + 1) for i in range(12)]
    numbered = spark.createDataFrame(rows, "page_id long, url string, site_key string, origin string, page_no long")
    files = I.sitemaps(numbered)
    assert {r.path for r in files.collect()} == {
        "/wp-sitemap.xml", "/sitemap-misc-0.xml", "/sitemap-post-1.xml"}
    assert sitemap_totals(sitemap_urls(files)).first().sitemap_total == 12 + 2 * 2  # each file adds two


def test_link_budget_counts_resolvable_links_only(spark):
    html = '<a href="http://">bad</a><a href="mailto:x">m</a><a href="/1">1</a><a href="/2">2</a>'
    df = spark.createDataFrame([(0, "https://a.com/", html)], "page_id bigint, url string, html string")
    assert [r.href for r in C.page_links(df, 2).collect()] == ["mailto:x", "https://a.com/1"]


SITE = "https://a.com"


def locs(*urls):
    return "".join(f"<loc>{u}</loc>" for u in urls)


def test_sitemap_index(spark):
    children = {f"/product-{n}.xml": 30 for n in range(2)}
    children |= {"/other.xml": 5, "/post.xml": 40, "/page.xml": 20}
    index = "<sitemapindex>" + locs(*[SITE + c for c in children], SITE + "/page-feed/") + "</sitemapindex>"
    files = [(SITE, "/sitemap_index.xml", "<html>"), (SITE, "/wp-sitemap.xml", index), (SITE, "/sitemap.xml", "<urlset>" + locs(SITE + "/no"))]
    files += [(SITE, c, "<urlset>" + locs(*[f"{SITE}{c}/{i}" for i in range(n)])) for c, n in children.items()]
    df = spark.createDataFrame(files, "origin string, path string, xml string")
    urls = sitemap_urls(df).orderBy("file_no", "pos").collect()
    # page, then post crosses the limit: the product files are not read
    assert [u.loc for u in urls][:21] == [f"{SITE}/page.xml/{i}" for i in range(20)] + [f"{SITE}/post.xml/0"]
    assert len(urls) == 60


def test_sitemap_total_and_seeds(spark):
    xml = "<urlset>" + locs(
        "http://www.a.com/x/", "https://a.com/tag/y/", "https://a.com/z.png", "https://b.com/", "not an address", SITE + "/feed"
    ).replace("<loc>not an address</loc>", "<loc>nonsense</loc>")
    df = spark.createDataFrame([(SITE, "/sitemap.xml", xml)], "origin string, path string, xml string")
    urls = sitemap_urls(df)
    assert sitemap_totals(urls).first().sitemap_total == 5
    assert {r.page_key for r in sitemap_seeds(urls).collect()} == {"a.com/x", "a.com/tag/y", "a.com/feed"}


def test_summary_and_deep_plans(spark):
    head = '<head><title>The harbour cafe, Newport</title><script type="application/ld+json">{"@type":"Organization"}</script></head>'
    rows = [
        (0, "https://a.com/", head + '<a href="/b">b</a>'), (1, "https://a.com/b", "<h2>Open?</h2>"),
        (2, "https://b.com/", "x"), (3, "https://c.com/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    maps = spark.createDataFrame(
        [("https://b.com", "/sitemap.xml", "<urlset>" + locs(*[f"https://b.com/{i}" for i in range(60)]))],
        "origin string, path string, xml string",
    )
    crawl = P.crawl_sites(pages, maps)
    audit = {r.site_key: r for r in P.summary_audit(crawl, 2026).collect()}
    assert set(audit) == {"a.com", "b.com"}
    assert (audit["a.com"].page_count, audit["a.com"].tier, audit["a.com"].crawled_pages) == (2, "small", ["https://a.com/", "https://a.com/b"])
    assert (audit["b.com"].site_size, audit["b.com"].tier, audit["b.com"].quote_total) == (60, "enterprise", None)
    assert audit["a.com"].question_heading_pages == ["/b"]
    replies = spark.createDataFrame([(0, '{"role":"Home","findings":[]}'), (1, "nonsense")], "page_id bigint, text string")
    panels = spark.createDataFrame([("a.com", '{"panel":[{"name":"N","role":"R","comment":"C"}]}')], "site_key string, text string")
    deep = {r.site_key: r for r in P.deep_report(crawl, replies, panels).collect()}
    assert [(p.url, p.role) for p in deep["a.com"].pages] == [("https://a.com/", "Home")]
    assert deep["a.com"].panel[0].name == "N" and deep["b.com"].panel is None
    assert deep["b.com"].synthesis == "https://b.com/ (): "
    one = P.page_audit(pages, "http://www.a.com/B/").collect()
    assert [(r.page_id, r.question_headings) for r in one] == [(1, 1)]


def test_usable_pages(spark):
    rows = [(1, "a", 200, "text/html; charset=x"), (2, "", 200, "text/html"), (3, "a", 404, "text/html"), (4, "a", 200, "image/png")]
    df = spark.createDataFrame(rows, "page_id int, html string, status int, content_type string")
    assert [r.page_id for r in usable_pages(df).collect()] == [1]


def test_number_within_small_blocks(spark):
    r = random.Random(5)
    ids = r.sample(range(10_000), 500)
    rows = [(i, "hot" if i % 3 else f"g{i % 30}") for i in ids]
    df = spark.createDataFrame(rows, "id bigint, g string")
    got = {x.id: x.n for x in number_within(df, ["g"], "id", "n", block=64).collect()}
    seen = {}
    for i, g in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        assert got[i] == seen[g]


def test_first_and_top(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in first_per_key(df, ["k"], [F.col("o")]).collect()} == {("a", "y"), ("b", "z")}
    top = top_per_group(df, ["k"], [F.desc("o")], 1, "n").collect()
    assert {(r.k, r.v) for r in top} == {("a", "x"), ("b", "z")}


def test_html_of_a_small_crawl_is_read_in_place(spark):
    from lodescan.operators.signals import crawled_signals
    from lodescan.session import materialize

    pages = materialize(spark.range(100).selectExpr("id AS page_id", "concat('https://s', id % 7, '.com/', id) AS url", "'<p>' AS html"), "pages")
    crawl = materialize(C.select_crawl(pages), "crawl")
    plan = crawled_signals(pages, crawl)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert any("BroadcastExchange" in line for line in exchanges)
    assert not any("html" in line for line in exchanges)
