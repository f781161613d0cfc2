import itertools
import json
import random
from collections import defaultdict

import pytest
import xxhash

from lodescan.llm import wrappers as W


@pytest.mark.parametrize("html, text", [
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ('<div class="comments"><p>hi</p></div><p>Main text here.</p>', "Main text here."),
    ("<article><header><h1>T</h1></header><p>a<b>b</b>c<br>d</p><form>x</form><aside>q</aside>"
     "</article><footer>f</footer>", "T abc d"),
    ('<p>x<script>if(a<b){"</p>"}</script>y</p>', "x y"),
    ("<div><p>one<p>two</div>", "one two"),
    ("<ul><li>a<li>b</ul>", "a b"),
    ('<nav>menu</nav><main><p>body</p><div id="ad-1">buy</div></main>', "body"),
    ('<div class="with-sidebar"><article><p>kept</p></article></div>', "kept"),
    ("<p title='a > b'>x &lt;y&gt; &#233;&eacute;&nbsp; z</p>", "x <y> éé z"),
    ('<p>seen <span hidden>not</span>this</p><p style="display: none">nor this</p>', "seen this"),
    ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<p>never closed", "never closed"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<h2>One</h2><p>" + "long " * 30 + "</p><p>short</p>", "One " + "long " * 30 + "short"),
    ("a < b and c > d", "a < b and c > d"),
    ("<article>One</article><article>Two is another article</article>", "One Two is another article"),
    ("<article>One<article>in it</article></article><aside><article>no</article></aside>", "One in it"),
    ("<p title='it's'>hello</p><p title='x'>you</p>", "hello you"),
    ('<p title="open>hello</p>', "hello"),
])
def test_parts_that_are_no_text(html, text):
    assert W.extract(html, {}) == text


def induced(pages):
    """Templates of the pages of one host, counted in plain loops over all of them."""
    roots = [(page, W.parse(page)) for page in pages]
    mains, chosen = defaultdict(set), {}
    for page, root in roots:
        code = xxhash.xxh64(page.encode(), seed=42).intdigest()
        key = code - 2**64 if code >= 2**63 else code, page
        for name in W.layouts(root):
            mains[name].add(W.extract(page, {}))
            chosen[name] = min(chosen.get(name, key), key)
    level = lambda name: name.split(":")[0]
    names = [n for n in mains if len(mains[n]) >= 3]
    names = [n for n in names if sum(level(m) == level(n) for m in names) <= W.MOST_LAYOUTS]
    trees = {n: W.shape(W.parse(chosen[n][1])) for n in names}
    found = defaultdict(set)
    for page, root in roots:
        name = next((n for n in W.layouts(root) if n in trees), None)
        main = W.extract(page, {})
        if name is not None:
            for slot, code in W.slot_texts(trees[name], W.shape(root)):
                found[name, slot, code].add(main)
    done = {}
    for name in names:
        constants = defaultdict(list)
        for (own, slot, code), texts in found.items():
            if own == name and code >= 0 and len(texts) >= 3 and (
                    len(texts) >= 0.66 * len(found[name, -1, -1])) and (
                    len(texts) >= 0.9 * len(found[name, slot, -1])):
                constants[slot].append(code)
        done[name] = W._unpacked(json.loads(W.packed(trees[name], constants)))
    return done


def site(article, n):
    return (f'<html><body><div class="top"><p>Welcome to our site</p><p>Since 1990</p></div>'
            f'<div class="x">{article}</div><div class="end"><p>Call us: 12345</p><p>{n}</p></div></body></html>')


ARTICLES = ["<p>First long story about the sea.</p>", "<p>Second story, of hills.</p><p>And dales.</p>",
            "<p>A third one on towns and people.</p>", "<h2>Four</h2><p>The last of the stories.</p>"]


def test_constant_nodes_are_template():
    pages = [site(a, "Open all week") for a in ARTICLES]
    template = induced(pages)
    assert W.extract(pages[1], template) == "Second story, of hills. And dales."
    new = site("<p>Never seen before, but long enough to be the text of the page.</p>", "Open all week")
    assert W.extract(new, template) == "Never seen before, but long enough to be the text of the page."


def test_matching_counts_the_most_pairs():
    a = W.shape(W.parse("<div><ul><li>1</li></ul><section><p>x</p></section><section><h2>y</h2></section></div>"))
    b = W.shape(W.parse("<div><section><h2>z</h2></section><ul><li>2</li></ul></div>"))
    # root, div, and section with h2 or ul with li
    assert W.matched(a, b)[0] == 4
    assert W.matched(a, a)[0] == a.size


def test_deep_and_long_pages():
    """Depth and number of blocks of a page are not bounded."""
    deep = "<div>" * 5_000 + "<p>x</p>" + "</div>" * 5_000
    long, *others = ("".join(f"<h2>h{k}-{n}</h2><p>t{k}-{n}</p>" for n in range(10_000 - k)) for k in range(4))
    template = induced([f"<p>top</p>{deep}<p>a{n}</p>" for n in range(4)])
    assert W.extract(f"<p>top</p>{deep.replace('x', 'y')}<p>a9</p>", template) == "y a9"
    assert W.extract(deep, {}) == "x"
    wide = induced([long, *others])
    assert W.extract(long, wide).split()[:4] == ["h0-0", "t0-0", "h0-1", "t0-1"]
    assert len(W.extract(long, wide).split()) == 20_000


def test_articles_are_never_template():
    """Copies of one article that differ elsewhere, and articles that repeat a line."""
    pages = [f"<p>track {n}</p><article><p>The one article.</p></article><p>Call us</p>" for n in range(4)]
    assert W.extract(pages[0], induced(pages)) == "The one article."
    pages = [f"<main><p>By the editor</p><p>Story {n}</p></main><p>Call us</p>" for n in range(4)]
    assert W.extract(pages[1], induced(pages)) == "By the editor Story 1"


def tried(a, b):
    """Most matched pairs by trying every order-keeping pairing of the children."""
    if a.label != b.label:
        return 0
    most = 0
    for n in range(1, min(len(a.children), len(b.children)) + 1):
        for left in itertools.combinations(a.children, n):
            for right in itertools.combinations(b.children, n):
                counts = [tried(x, y) for x, y in zip(left, right)]
                most = max(most, sum(counts))
    return 1 + most


def test_matching_equals_brute_force():
    draw = random.Random(5)

    def tree(depth):
        kinds = "".join(
            f"<{tag}>{tree(depth - 1) if depth and draw.random() < 0.6 else '<b>x</b>'}</{tag}>"
            for tag in draw.choices(["div", "section", "ul", "h2"], k=draw.randint(1, 4))
        )
        return kinds

    for _ in range(60):
        a, b = (W.shape(W.parse(tree(2))) for _ in range(2))
        assert W.matched(a, b)[0] == tried(a, b) == len(W.matched(a, b)[1])


def test_few_pages_make_no_template():
    pages = [site("<p>Same.</p>", "1")] * 5
    assert "Same." in W.extract(pages[0], induced(pages))
    assert induced([]) == induced(pages) == {}


def layout_pages():
    """Two layouts on one host, one of them rare on another, single odd pages, copies."""
    def article(n):
        return (f'<body><div class="top"><p>Our slogan</p></div><div class="post p{n}"><p>Story {n} of the town.</p>'
                f'<p>It ended well {n}.</p></div><div class="end"><p>Call us</p></div></body>')

    def listing(n):
        return (f'<body><div class="top"><p>Our slogan</p></div><section class="list"><p>All our stories</p>'
                f'<ul><li>Item {n}</li><li>Item {n + 1} too</li></ul><p>Ask at the desk</p></section></body>')

    rows = []
    for n in range(20):
        rows += [("a.example", article(n), f"Story {n} of the town. It ended well {n}."),
                 ("a.example", listing(n), f"Item {n} Item {n + 1} too"),
                 ("b.example", article(n), f"Story {n} of the town. It ended well {n}.")]
    rows += [("a.example", article(3), "Story 3 of the town. It ended well 3.")] * 30
    rows += [("b.example", listing(1), "Our slogan All our stories Item 1 Item 2 too Ask at the desk")]
    rows += [("c.example", article(1), "Our slogan Story 1 of the town. It ended well 1. Call us")] * 9
    return rows


def test_layouts_have_templates_of_their_own(spark):
    rows = layout_pages()
    pages = spark.createDataFrame(
        [(n, f"http://{host}/{n}", html) for n, (host, html, _) in enumerate(rows)],
        "page_id long, url string, html string").repartition(5)
    found = {r["page_id"]: r["text"] for r in W.main_texts(pages).collect()}
    for host in {r[0] for r in rows}:
        trees = induced([html for own, html, _ in rows if own == host])
        for n, (own, html, text) in enumerate(rows):
            if own == host:
                assert found[n] == W.extract(html, trees)
                if (own, "list" in html) != ("b.example", True):
                    assert found[n] == text


def test_hosts_of_many_layouts(spark, monkeypatch):
    """Too many at one level are told at a coarser one; pages of no layout share the host's."""
    monkeypatch.setattr(W, "MOST_LAYOUTS", 2)
    draw = random.Random(3)
    htmls = [f'<div class="{draw.choice("abc")}"><section class="{draw.choice("xyzuv")}"><p>Hello all</p>'
             f"<p>text {n}</p></section><p>Bye</p></div>" for n in range(60)]
    htmls += [f"<table><tr><td>cell {n}</td><td>{n}</td></tr></table><p>Bye</p>" for n in range(2)]
    pages = spark.createDataFrame([(n, "http://h.example/", h) for n, h in enumerate(htmls)],
                                  "page_id long, url string, html string")
    trees = induced(htmls)
    found = {r["page_id"]: r["text"] for r in W.main_texts(pages).collect()}
    assert [found[n] for n in range(len(htmls))] == [W.extract(h, trees) for h in htmls]
    assert set(trees) == {"0"}


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = W.main_texts(pages).collect()
    assert len(rows) == pages.count()
    by_id = {r["page_id"]: r for r in rows}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        assert by_id[r["page_id"]]["text"] == W.extract(inner, {})
        assert by_id[r["page_id"]]["n_chars"] == len(by_id[r["page_id"]]["text"])


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "no url", ""), (None, "http://h.example/", "<p>a</p>"),
            (3, "http://h.example/x", "<p>" + "long " * 50_000 + "</p>"), (3, "http://h.example/x", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' as text", "'y' as host", "'z' as template")
    found = sorted((str(r["page_id"]), r["url"] or "", r["n_chars"]) for r in W.main_texts(pages).collect())
    assert found == sorted([("1", "", 0), ("2", "no url", 0), ("None", "http://h.example/", 1),
                            ("3", "http://h.example/x", 249_999), ("3", "http://h.example/x", 1)])
    assert W.main_texts(pages.limit(0)).collect() == []
