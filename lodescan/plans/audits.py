"""The three audits end to end, each as one plan over stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..operators import audit as A
from ..operators import judgment as J
from ..operators.crawl import select_crawl
from ..operators.signals import (
    complete_signals, crawled_signals, page_facts, property_lists, single_page, site_rollup,
)
from ..session import materialize
from ..sources.page_store import html_of
from ..sources.sinks import deep_payload
from ..sources.sitemaps import sitemap_seeds, sitemap_totals, sitemap_urls
from ..sources.tables import usable_pages


@dataclass
class Crawl:
    pages: DataFrame
    plan: DataFrame
    totals: DataFrame | None


def crawl_sites(
    pages: DataFrame,
    sitemaps: DataFrame | None = None,
    cap: int = V.SUMMARY_PAGE_CAP,
    links_per_page: int | None = V.SUMMARY_LINKS_PER_PAGE,
) -> Crawl:
    """Bounded crawl of every site in ``pages``; ``sitemaps`` is (origin, path, xml).

    Rounds read what they visit if ``pages`` is a page store, and else scan all html each.
    """
    pages = usable_pages(pages)
    if sitemaps is None:
        return Crawl(pages, select_crawl(pages, None, cap, links_per_page), None)
    urls = materialize(sitemap_urls(sitemaps), "sitemap-urls")
    plan = select_crawl(pages, sitemap_seeds(urls), cap, links_per_page)
    origins = plan.filter("crawl_rank = 1").select("site_key", "origin")
    totals = sitemap_totals(urls).join(origins, "origin").select("site_key", "sitemap_total")
    return Crawl(pages, plan, totals)


def summary_signals(crawl: Crawl, as_of_year: int, pages: DataFrame | None = None) -> DataFrame:
    """Signals of every site; ``pages`` if their html differs from what the crawl followed."""
    rolled = site_rollup(crawled_signals(crawl.pages if pages is None else pages, crawl.plan))
    return property_lists(complete_signals(rolled, as_of_year, crawl.totals))


def summary_audit(
    crawl: Crawl,
    as_of_year: int,
    speed: DataFrame | None = None,
    reports: DataFrame | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Signals, tier, quote and scores per site, with speed readings and reports if given."""
    audit = A.site_audit(summary_signals(crawl, as_of_year, pages))
    return A.attach(audit, speed, reports).join(A.crawled_pages(crawl.plan), "site_key", "left")


def deep_facts(crawl: Crawl, pages: DataFrame | None = None) -> DataFrame:
    """Fact rows of the crawled pages, under the addresses they were queued by."""
    keyed = crawl.plan.select("page_id", "site_key", "crawl_rank")
    wanted = crawl.plan.drop("site_key", "origin", "crawl_rank", "level")
    html = html_of(crawl.pages if pages is None else pages, wanted)
    return page_facts(html).join(keyed, "page_id")


def deep_report(
    crawl: Crawl, responses: DataFrame, panels: DataFrame | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """One record per site: its page results, the synthesis line and the reader panel.

    ``responses`` is (page_id, text), ``panels`` (site_key, text).
    """
    facts = deep_facts(crawl, pages).select("site_key", "crawl_rank", "page_id", "url", "title")
    results = materialize(J.page_results(facts, responses), "page-results")
    report = deep_payload(results).join(J.synthesis_input(results), "site_key", "left")
    if panels is None:
        return report
    cleaned = panels.select("site_key", J.clean_panel(F.col("text")).alias("panel"))
    return report.join(cleaned, "site_key", "left")


def page_audit(pages: DataFrame, url: str, buckets: int | None = None) -> DataFrame:
    """Fact row of one page, of a page store with its number of ``buckets`` by one short read."""
    return page_facts(single_page(usable_pages(pages), url, buckets))
