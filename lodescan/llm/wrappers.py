"""Main text of web pages by wrapper induction.

Pages are parsed to trees of block elements. Pages of a host whose trees have the same upper
levels are one layout, with the tree of one of them as its reference. Every page is aligned with
the reference of its layout by simple tree matching, and the texts at each slot are counted over
all pages of the layout: a text that nearly all of them share is constant and becomes template,
slots with varying texts are content. Each page is then aligned with its template: constant
nodes go, and the rest is the page's content, or that of its article and main elements if it has
some. Parts that are never an article's own (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments) go by their element or their class words, on hosts of a single
page too.

Layouts are told at ``LEVELS`` levels below the body, at fewer, and at none (the host as one). A
page belongs to the finest that ``LEAST_SHARED`` pages of different main texts have; a host with
more than ``MOST_LAYOUTS`` such layouts at one level is told at the next coarser one. So the
templates of a host are of bounded number, no page is left out, and pages are counted without
gathering a host anywhere: only counts and one reference a layout come together.

Rows: a null html is an empty page and gives the empty text. A null or odd url has the empty
host. Page ids may be null or repeat, one row comes out per row. An empty table gives an empty
result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# levels below the body that tell layouts apart, and layouts of a host at one level
LEVELS = 2
MOST_LAYOUTS = 64
# pages of different main texts that must share a text before it counts as template, and the
# least part of a layout's pages and of those with the slot, in per cent
LEAST_SHARED = 3
SHARED_OF_PAGES = 66
SHARED_OF_SLOT = 90
# levels of a tree that are matched; blocks further down count as lines of the element there
DEEPEST = 150
# characters of stored templates that a Python worker keeps parsed
REMEMBERED = 4_000_000
# slot rows a Python worker hands over at once
SLOT_ROWS = 20_000

# fixed values: elements of the html standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
NOT_TEXT = frozenset(
    "head script style noscript template iframe svg canvas audio video object embed map math "
    "nav footer aside form button select input textarea option dialog menu title noembed "
    "noframes".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# an element ends an open one of these kinds, up to the nearest of the limits
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar "
    "sidenav aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer comment comments disqus replies respond share sharing "
    "social related recommended newsletter subscribe subscription signup login search widget "
    "toolbar skip copyright legal disclaimer".split()
)
SIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar".split()
)
WORD = re.compile(r"[a-z]+")
MODIFIER = re.compile(r"\b(?:with|has|have|no|without|show|hide|is)[-_]+[a-z]+")
TOKEN = re.compile(
    # a quote opens a value behind an equals sign only; elsewhere it is a character of a tag
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I
)


@dataclass
class Node:
    label: str
    side: bool = False
    children: list["Node"] = field(default_factory=list)
    text: str = ""  # of a text node, label "#"

    @property
    def code(self) -> int:
        return crc32(self.text.encode("utf-8", "surrogatepass"))


def _attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(value.strip("\"'")).lower())
    return found


def _is_side(tag: str, own: dict[str, str], in_article: bool) -> bool:
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return True
    if not own:
        return False
    if "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if own.get("role") in SIDE_ROLES:
        return True
    # "with-sidebar" and its like tell what a page has, not what the element is
    names = MODIFIER.sub(" ", own.get("class", "") + " " + own.get("id", ""))
    words = set(WORD.findall(names))
    if in_article:
        words -= {"header"}
    return not SIDE_WORDS.isdisjoint(words)


def parse(html: str) -> Node:
    """The block elements of a page; text, inline elements included, is in text nodes."""
    root = Node("root")
    stack: list[tuple[str, Node]] = [("root", root)]
    pending: list[str] = []
    articles = 0

    def flush() -> None:
        text = " ".join(unescape("".join(pending)).split())
        pending.clear()
        if text:
            stack[-1][1].children.append(Node("#", text=text))

    def pop_to(index: int) -> None:
        nonlocal articles
        for tag, _ in stack[index:]:
            articles -= tag in ("article", "main")
        del stack[index:]

    def close(tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        for index in range(len(stack) - 1, 0, -1):
            if stack[index][0] in tags:
                flush()
                pop_to(index)
                return
            if stack[index][0] in limits:
                return

    at, size = 0, len(html)
    lower = None
    while at < size:
        found = TOKEN.search(html, at)
        if found is None:
            pending.append(html[at:])
            break
        if found.start() > at:
            pending.append(html[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in INLINE:
                continue
            for index in range(len(stack) - 1, 0, -1):
                if stack[index][0] == tag:
                    flush()
                    pop_to(index)
                    break
            continue
        if tag in INLINE:
            if not _is_side(tag, _attributes(found[3]), articles > 0):
                continue
            # a hidden or side part inside a line: its text up to its end is not the line's
            close_at = _inline_end(html, tag, at)
            at = close_at
            continue
        if tag == "br":
            pending.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if tag in RAW:
            if lower is None:
                lower = html.lower()
            end = lower.find(f"</{tag}", at)
            at = size if end < 0 else end
            if end >= 0:
                closing = html.find(">", end)
                at = size if closing < 0 else closing + 1
            continue
        if tag in ENDS_PARAGRAPH:
            close(("p",), ("article", "section", "div", "td", "th", "li", "button", "main"))
        if tag in ENDS:
            close(*ENDS[tag])
        own = _attributes(found[3])
        words = f"{tag}.{own.get('class', '')}#{own.get('id', '')}"
        node = Node(words.removesuffix(".#"), _is_side(tag, own, articles > 0))
        stack[-1][1].children.append(node)
        stack.append((tag, node))
        articles += tag in ("article", "main")
    flush()
    return root


def _inline_end(html: str, tag: str, at: int) -> int:
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>", re.I).finditer(html, at):
        depth += -1 if found[1] else 1
        if not depth:
            return found.end()
    return at


@dataclass
class Shape:
    """A node for matching: neighbouring leaves of one label are one run with their texts."""

    label: str
    children: list["Shape"]
    nodes: list[Node]
    texts: list[int]
    size: int


def _leaf(node: Node) -> bool:
    return node.label == "#" or all(c.label == "#" for c in node.children)


def _leaf_code(node: Node) -> int:
    if node.label == "#":
        return node.code
    return crc32("\n".join(c.text for c in node.children).encode("utf-8", "surrogatepass"))


def _leaves(node: Node) -> list[Node]:
    """The leaves below a node, in page order."""
    found, waiting = [], node.children[::-1]
    while waiting:
        here = waiting.pop()
        if _leaf(here):
            found.append(here)
        else:
            waiting += here.children[::-1]
    return found


def shape(node: Node, depth: int = 0) -> Shape:
    children: list[Shape] = []
    for child in node.children if depth < DEEPEST else _leaves(node):
        if _leaf(child):
            if children and not children[-1].children and children[-1].label == child.label:
                children[-1].nodes.append(child)
                children[-1].texts.append(_leaf_code(child))
            else:
                children.append(Shape(child.label, [], [child], [_leaf_code(child)], 1))
        else:
            children.append(shape(child, depth + 1))
    return Shape(node.label, children, [node], [], 1 + sum(c.size for c in children))


def matched(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the largest number of node pairs in order, and the pairs."""
    if a.label != b.label:
        return 0, []
    # leaves of one label at either end count one pair whatever else they could match
    ends: list[tuple[Shape, Shape]] = []
    left, right = list(a.children), list(b.children)
    for side in (0, -1):
        start = 0
        for own, its in zip(left[::-1] if side else left, right[::-1] if side else right):
            if own.children or its.children or own.label != its.label:
                break
            ends.append((own, its))
            start += 1
        left = left[:len(left) - start] if side else left[start:]
        right = right[:len(right) - start] if side else right[start:]
    rows, columns = len(left), len(right)
    if not rows or not columns:
        return 1 + len(ends), [(a, b), *ends]
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    found: dict[tuple[int, int], tuple[int, list]] = {}
    for i, own in enumerate(left, 1):
        for j, its in enumerate(right, 1):
            score = max(best[i - 1][j], best[i][j - 1])
            if own.label == its.label:
                found[i, j] = matched(own, its)
                score = max(score, best[i - 1][j - 1] + found[i, j][0])
            best[i][j] = score
    pairs = [(a, b), *ends]
    i, j = rows, columns
    while i and j:
        if (i, j) in found and best[i][j] == best[i - 1][j - 1] + found[i, j][0]:
            pairs += found[i, j][1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[rows][columns] + 1 + len(ends), pairs


def layouts(root: Node) -> list[str]:
    """Names of a page's layout, the finest first: the kinds of element at its upper levels."""
    paths: list[set[str]] = [set() for _ in range(LEVELS)]
    waiting = [(root, "", 0)]
    while waiting:
        here, path, level = waiting.pop()
        for child in here.children:
            if child.side or _leaf(child):
                continue
            tag = re.split(r"[.#]", child.label, maxsplit=1)[0]
            if tag in ("html", "body"):
                waiting.append((child, path, level))
                continue
            below = f"{path}/{re.sub('[0-9]+', '', child.label.split('#', 1)[0])}"
            paths[level].add(below)
            if level + 1 < LEVELS and tag not in ("article", "main"):
                waiting.append((child, below, level + 1))
    names, seen = ["0"], ""
    for level, found in enumerate(paths, 1):
        seen += "\n" + "\n".join(sorted(found))
        names.append(f"{level}:{blake2b(seen.encode('utf-8', 'replace'), digest_size=8).hexdigest()}")
    return names[::-1]


def packed(node: Shape, constants: dict[int, list[int]]) -> str:
    """A tree as text, with the constant texts of its slots: leaf runs, numbered in page order."""
    slot = iter(range(node.size))

    def walk(here: Shape) -> list:
        own = [] if here.children else sorted(constants.get(next(slot), []))
        return [here.label, own, [walk(c) for c in here.children]]

    return json.dumps(walk(node), separators=(",", ":"))


def slot_texts(reference: Shape, page: Shape) -> set[tuple[int, int]]:
    """(slot, code) of a page's texts at the slots of its reference; code -1 says it has the slot.

    What stands inside article and main elements is never template and is left out; slot -1
    stands for the page itself.
    """
    numbers: dict[int, int] = {}
    waiting, count = [(reference, False)], 0
    while waiting:
        here, inside = waiting.pop()
        inside = inside or _is_article(here.label)
        if not here.children:
            if not inside:
                numbers[id(here)] = count
            count += 1
        waiting += [(child, inside) for child in reversed(here.children)]
    found = {(-1, -1)}
    for own, its in matched(reference, page)[1]:
        slot = numbers.get(id(own))
        if slot is not None and not its.children:
            found.add((slot, -1))
            found |= {(slot, code) for code in its.texts}
    return found


def _is_article(label: str) -> bool:
    return label.startswith(("article", "main")) and re.split(r"[.#]", label, maxsplit=1)[0] in (
        "article", "main"
    )


def _unpacked(packed: list) -> Shape:
    label, constant, children = packed
    below = [_unpacked(c) for c in children]
    return Shape(label, below, [], constant, 1 + sum(c.size for c in below))


def _texts(node: Node, wanted: bool) -> list[str]:
    """Texts outside side parts, in page order; ``wanted`` asks for those of articles only.

    All outermost article and main elements count.
    """
    found: list[str] = []
    waiting = [(node, not wanted)]
    while waiting:
        here, inside = waiting.pop()
        if here.side:
            continue
        inside = inside or _is_article(here.label)
        if here.text and inside:
            found.append(here.text)
        waiting += [(child, inside) for child in reversed(here.children)]
    return found


def _text(root: Node) -> str:
    return " ".join(_texts(root, True) or _texts(root, False))


def extract(html: str, templates: dict[str, Shape]) -> str:
    root = parse(html)
    template = _own(templates, root)
    if template is not None:
        for own, its in matched(template[1], shape(root))[1]:
            if own.texts:
                constant = set(own.texts)
                for node, code in zip(its.nodes, its.texts, strict=True):
                    if code in constant:
                        node.side = True
    return _text(root)


def _own(trees: dict[str, Shape], root: Node) -> tuple[str, Shape] | None:
    """The finest layout of a page that its host has a tree of."""
    if not trees:
        return None
    return next(((name, trees[name]) for name in layouts(root) if name in trees), None)


TREES: dict[str, dict[str, Shape]] = {}


def _trees(source: str | None) -> dict[str, Shape]:
    """Trees by layout of one host, parsed once and remembered up to a number of characters."""
    if not source:
        return {}
    if source not in TREES:
        if sum(map(len, TREES)) + len(source) > REMEMBERED:
            TREES.clear()
        TREES[source] = {
            s["layout"]: _unpacked(json.loads(s["tree"])) for s in json.loads(source)
        }
    return TREES[source]


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")),
                                    r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _digest(root: Node) -> int:
    """Of the main text, by which pages count once."""
    text = _text(root).encode("utf-8", "replace")
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "big", signed=True)


def _page_layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mains, names = [], []
        for html in batch.column("html"):
            root = parse(html.as_py())
            mains.append(_digest(root))
            names.append(layouts(root))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("html_key"), pa.array(mains, pa.int64()),
             pa.array(names, pa.list_(pa.string()))],
            ["host", "html_key", "main", "layouts"],
        )


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = set()  # copies of a reference give the same tree
    for batch in batches:
        for host, layout, html in zip(*map(batch.column, ("host", "layout", "html")), strict=True):
            own = host.as_py(), layout.as_py()
            if own in done:
                continue
            done.add(own)
            tree = packed(shape(parse(html.as_py())), {})
            yield pa.RecordBatch.from_pydict({"host": [own[0]], "layout": [own[1]], "tree": [tree]})


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "layout", "main", "slot", "code"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
        )

    rows: list[tuple] = []
    for batch in batches:
        for html, host, trees in zip(*map(batch.column, ("html", "host", "trees")), strict=True):
            root = parse(html.as_py())
            own = _own(_trees(trees.as_py()), root)
            if own is None:
                continue
            same = host.as_py(), own[0], _digest(root)
            rows += [(*same, *at) for at in slot_texts(own[1], shape(root))]
            if len(rows) >= SLOT_ROWS:
                yield out(rows)
                rows = []
    if rows:
        yield out(rows)


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees = []
        for tree, found in zip(batch.column("tree").to_pylist(),
                               batch.column("constants").to_pylist(), strict=True):
            constants: dict[int, list[int]] = {}
            for c in found:
                constants.setdefault(c["slot"], []).append(c["code"])
            trees.append(packed(_unpacked(json.loads(tree)), constants))
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("layout"), pa.array(trees, pa.string())],
            ["host", "layout", "tree"],
        )


TREE_ROWS = "host string, layout string, tree string"


def _of_hosts(trees: DataFrame) -> DataFrame:
    """All trees of a host in one row, at most ``MOST_LAYOUTS`` a level."""
    return trees.groupBy("host").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("layout", "tree")))).alias("trees")
    )


def references(pages: DataFrame) -> DataFrame:
    """(host, layout, tree) of each layout of enough pages; ``pages`` has host, html, html_key."""
    level = F.substring_index("layout", ":", 1)
    found = (
        pages.select("host", "html", "html_key")
        .mapInArrow(_page_layouts, "host string, html_key long, main long, layouts array<string>")
        .select("host", "html_key", "main", F.explode("layouts").alias("layout"))
        .groupBy("host", "layout", "main").agg(F.min("html_key").alias("html_key"))
        .groupBy("host", "layout")
        .agg(F.count("*").alias("n"), F.min("html_key").alias("html_key"))
        .filter(F.col("n") >= LEAST_SHARED)
        .withColumn("level", level)
    )
    from ..session import materialize

    found = materialize(found, "layouts")
    told = found.groupBy("host", "level").agg(F.count("*").alias("n")) \
        .filter(F.col("n") <= MOST_LAYOUTS).select("host", "level")
    chosen = found.join(told, ["host", "level"]).select("host", "layout", "html_key")
    return (
        pages.join(chosen, ["host", "html_key"]).select("host", "layout", "html")
        .mapInArrow(_references, TREE_ROWS)
        .groupBy("host", "layout").agg(F.min("tree").alias("tree"))
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, trees): the layouts of each host with their constant texts, counted over all pages."""
    from ..session import materialize

    known = pages.filter(F.col("html").isNotNull()).select(
        host_of().alias("host"), "html", F.xxhash64("html").alias("html_key")
    )
    trees = materialize(references(known), "references")
    # pages of one main text count once: first the distinct ones, then their number
    counts = (
        known.join(_of_hosts(trees), "host").select("host", "html", "trees")
        .mapInArrow(_slots, "host string, layout string, main long, slot int, code long")
        .distinct()
        .groupBy("host", "layout", "slot", "code").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= LEAST_SHARED)
    )
    counts = materialize(counts, "slot-texts")
    all_pages = counts.filter("slot = -1").select("host", "layout", F.col("n").alias("pages"))
    slots = counts.filter("slot >= 0 AND code = -1").select(
        "host", "layout", "slot", F.col("n").alias("seen")
    )
    constants = (
        counts.filter("code >= 0").join(all_pages, ["host", "layout"])
        .filter(100 * F.col("n") >= SHARED_OF_PAGES * F.col("pages"))
        .join(slots, ["host", "layout", "slot"])
        .filter(100 * F.col("n") >= SHARED_OF_SLOT * F.col("seen"))
        .groupBy("host", "layout")
        .agg(F.collect_list(F.struct("slot", "code")).alias("constants"))
    )
    # a layout without constants stays: its pages are not those of a coarser one
    both = trees.join(constants, ["host", "layout"], "left").withColumn(
        "constants", F.coalesce("constants", F.expr("array()").cast("array<struct<slot:int,code:bigint>>"))
    )
    return _of_hosts(both.mapInArrow(_templates, TREE_ROWS))


def _extract_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [
                extract(html, _trees(trees))
                for html, trees in zip(
                    part.column("html").to_pylist(), part.column("trees").to_pylist(), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    from ..session import materialize

    known = materialize(templates(pages), "templates").withColumnRenamed("host", "_host")
    kind = pages.schema["page_id"].dataType.simpleString()
    own = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("_own")
    )
    return (
        own.join(known, F.col("_own") == F.col("_host"), "left")
        .select("page_id", "url", "html", "trees")
        .mapInArrow(_extract_batch, f"page_id {kind}, url string, text string")
        .withColumn("n_chars", F.length("text").cast("long"))
    )
