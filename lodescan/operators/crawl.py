"""Bounded crawl of many sites at once over stored pages and sitemaps.

A first-in-first-out crawl visits pages level by level, so the plan is level-synchronous.
Level 0, the root and the sitemap's addresses, is ranked first; a site it fills needs no link
at all. Each later round reads the html of the pages found last only, takes their links,
keeps the first mention of each page, drops pages already visited and ranks the rest inside
the site. Every round finds at least one new page for each site still open, so the page cap
also bounds the rounds.

From a page store (``sources.page_store``) a round scans the buckets of its pages only: levels
carry the bucket of every page, and the join with the html prunes partitions at run time.

A page is looked up by its key, under which several addresses meet. Its links are resolved
against the address it was queued by, as a crawler does, and that address is its ``url``.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions import html as H
from ..functions.urls import Url, absolute_link, is_asset, is_resolvable, key_of, link_text
from ..session import materialize
from ..sources.page_store import html_of
from ..sources.tables import page_index
from .grouping import compute_once, first_per_key, top_per_group


def page_links(
    pages: DataFrame, per_page: int | None = V.SUMMARY_LINKS_PER_PAGE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(page_id, site_key, pos, href): links of each page in document order; map-only.

    ``href`` is absolute, ``site_key`` the site of the page itself; ``keep`` names columns of
    ``pages`` that come along.

    Links that cannot be resolved are dropped before the per-page budget is applied.
    ``Url(href)`` gives the parts of a link.
    """
    url = Url(F.col("url"))
    staged = pages.select(
        "page_id",
        *keep,
        url.site.alias("link_site"),
        url.scheme.alias("link_scheme"),
        url.origin.alias("link_origin"),
        url.path.alias("link_path"),
        url.query.alias("link_query"),
        H.link_hrefs(F.col("html")).alias("hrefs"),
    )
    # only the cheap check runs on the array; the rest is compiled code over exploded rows
    usable = F.filter("hrefs", lambda h: is_resolvable(h, F.col("link_origin").isNotNull()))
    if per_page is not None:
        usable = F.slice(usable, 1, per_page)
    parts = ["link_scheme", "link_origin", "link_path", "link_query"]
    base = SimpleNamespace(**{c.removeprefix("link_"): F.col(c) for c in parts})
    ids = ["page_id", *keep, "link_site"]
    found = staged.select(*ids, *parts, F.posexplode(usable).alias("pos", "raw"))
    tidy = compute_once(found, *ids, "pos", *parts, link=link_text(F.col("raw"), base))
    return compute_once(tidy, *ids, "pos", href=absolute_link(F.col("link"), base)).select(
        "page_id", *keep, F.col("link_site").alias("site_key"), "pos", "href"
    )


def queued_links(frontier: DataFrame, pages: DataFrame, per_page: int | None) -> DataFrame:
    """Links of the frontier's pages that stay on their crawl's origin, assets aside.

    Only pages of the frontier are read: the join comes before the links are searched. Of the
    mentions of a page the first one stays, before any of them meets the stored pages.
    """
    carried = ("crawl_site", "origin", "parent_rank", "filled")
    reached = html_of(pages, frontier)
    url = Url(F.col("href"))
    parts = compute_once(
        page_links(reached, per_page, carried), *carried, "pos",
        link=F.struct(
            url.origin.alias("origin"), url.site.alias("site"), url.path.alias("path"),
            url.href.alias("href"),
        ),
    )
    own = parts.filter((F.col("link.origin") == F.col("origin")) & ~is_asset(F.col("link.path")))
    return own.groupBy(
        F.col("crawl_site").alias("site_key"),
        key_of(F.col("link.site"), F.col("link.path")).alias("page_key"),
    ).agg(
        F.min(F.struct("parent_rank", "pos", "origin", "filled", F.col("link.href").alias("url")))
        .alias("first")
    ).select("site_key", "page_key", "first.*")


def key_table(index: DataFrame) -> DataFrame:
    """(page_key, target): the page a key stands for, the lowest id among its copies.

    Pages of one key lie in one bucket of a store, which is a third column then.
    """
    bucket = [F.min(c).alias(c) for c in _bucket(index)]
    return index.groupBy("page_key").agg(F.min("page_id").alias("target"), *bucket)


def _bucket(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "bucket"]


def default_roots(index: DataFrame) -> DataFrame:
    """The lowest page id of each site is its root and fixes the crawl's origin."""
    known = index.filter(F.col("site_key").isNotNull())
    first = known.groupBy("site_key").agg(
        F.min_by(F.struct("page_key", "origin", "url"), "page_id").alias("root")
    )
    return first.select(
        "site_key", "root.page_key", "root.origin", Url(F.col("root.url")).href.alias("url")
    )


def _rank_level(found: DataFrame, order: list[str], cap: int) -> DataFrame:
    """Number a level after the pages already visited and cut it at the cap."""
    ranked = top_per_group(found, ["site_key"], [F.col(c) for c in order], cap, "_nth")
    site = Window.partitionBy("site_key")
    return (
        ranked.withColumn("crawl_rank", F.col("filled") + F.col("_nth"))
        .filter(F.col("crawl_rank") <= cap)
        .withColumn("filled", F.max("crawl_rank").over(site))
        .select("site_key", "origin", "page_id", "url", "crawl_rank", "filled", *_bucket(found))
    )


def select_crawl(
    pages: DataFrame,
    seeds: DataFrame | None = None,
    cap: int = V.SUMMARY_PAGE_CAP,
    per_page: int | None = V.SUMMARY_LINKS_PER_PAGE,
    roots: DataFrame | None = None,
) -> DataFrame:
    """Pages a crawl of each site visits: (site_key, origin, page_id, url, crawl_rank, level).

    Of a page store each page's ``bucket`` comes with it, for later look-ups of its html.

    ``seeds`` is ``sitemap_seeds(...)``, ``roots`` is (site_key, page_key, origin, url).
    ``per_page`` links of a page are followed. Stored are the key table and one short table
    per level.
    """
    index = page_index(pages)
    targets = materialize(key_table(index), "page-keys")
    roots = default_roots(index) if roots is None else roots

    queue = roots.select(
        "site_key", "origin", "page_key", "url", F.lit(-1).alias("file_no"), F.lit(0).alias("pos")
    )
    if seeds is not None:
        queue = queue.unionByName(
            seeds.join(roots.select("site_key", "origin"), "origin").select(
                "site_key", "origin", "page_key", "url", "file_no", "pos"
            )
        )
    first = first_per_key(
        queue, ["site_key", "origin", "page_key"], [F.col("file_no"), F.col("pos")]
    )
    fetched = first.join(targets, "page_key").withColumnRenamed("target", "page_id")
    level = _rank_level(fetched.withColumn("filled", F.lit(0)), ["file_no", "pos"], cap)
    levels = [materialize(level.withColumn("level", F.lit(0)), "crawl-level")]

    for depth in range(1, cap):
        visited = reduce(DataFrame.unionByName, levels)
        frontier = levels[-1].filter(F.col("filled") < cap).select(
            "page_id", "url", "origin", "filled", F.col("site_key").alias("crawl_site"),
            F.col("crawl_rank").alias("parent_rank"), *_bucket(index),
        )
        if frontier.isEmpty():
            break
        found = (
            queued_links(frontier, pages, per_page)
            .join(targets, "page_key").withColumnRenamed("target", "page_id")
            .join(visited.select("site_key", "page_id"), ["site_key", "page_id"], "left_anti")
        )
        level = _rank_level(found, ["parent_rank", "pos"], cap)
        levels.append(materialize(level.withColumn("level", F.lit(depth)), "crawl-level"))

    return reduce(DataFrame.unionByName, levels).drop("filled")
