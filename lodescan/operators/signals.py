"""Page facts and the site signals rolled up from the pages of a crawl.

All html work is one projection, before any shuffle. A crawl holds at most a dozen or so
pages per site, so the arrays collected per site are small whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions import html as H
from ..functions.text import choose
from ..functions.urls import page_key, path_or_root
from ..sources.page_store import html_of, page_of


def page_facts(pages: DataFrame, text_chars: int = V.DEEP_PAGE_CHARS) -> DataFrame:
    """Per-page fact row of the deep report; map-only."""
    html = F.col("html")
    types = F.col("schema_types")
    facts = pages.select(
        "page_id",
        "url",
        H.page_title(html).alias("title"),
        F.left(H.strip_to_text(html), F.lit(text_chars)).alias("text"),
        H.has_schema_mention(html).alias("has_schema"),
        H.schema_types_regex(html).alias("schema_types"),
        H.has_meta_description(html).alias("has_meta"),
        H.img_count(html).alias("images"),
        H.img_with_alt(html).alias("images_with_alt"),
        H.question_heading_count(html).alias("question_headings"),
        H.form_count(html).alias("forms"),
        H.field_count(html).alias("form_fields"),
        H.has_mailto(html).alias("has_mailto"),
        H.has_tel(html).alias("has_tel"),
    )
    return facts.withColumns(
        {
            "has_faq_schema": H.has_faq_type(types),
            "has_menu_schema": H.has_menu_type(types),
        }
    )


def single_page(pages: DataFrame, url: str, buckets: int | None = None) -> DataFrame:
    """The page behind one address, by page key; the filter runs before any html work.

    A stored ``page_key`` column lets the scan itself skip other pages, and the number of
    ``buckets`` of a page store all but one of its folders.
    """
    if buckets:
        return page_of(pages, page_key(F.lit(url)), buckets).orderBy("page_id").limit(1)
    stored = "page_key" in pages.columns
    wanted = pages.filter((F.col("page_key") if stored else page_key(F.col("url"))) == page_key(F.lit(url)))
    return wanted.orderBy("page_id").limit(1)


def page_signals(pages: DataFrame) -> DataFrame:
    """Everything a site roll-up needs from a page; drops the html."""
    html = F.col("html")
    keep = [c for c in pages.columns if c != "html"]
    staged = pages.select(
        *keep,
        "html",
        H.ld_json_blocks(html).alias("blocks"),
        H.strip_to_text(html).alias("text"),
    )
    props = [H.has_property(html, n).alias(f"prop_{n}") for n, _ in V.SCHEMA_PROPERTIES]
    return staged.select(
        *keep,
        path_or_root(F.col("url")).alias("path"),
        (F.size("blocks") > 0).alias("has_schema_block"),
        H.schema_types_in_blocks(F.col("blocks")).alias("types"),
        H.has_meta_description(html).alias("has_meta"),
        H.has_breadcrumb(html).alias("breadcrumb"),
        H.has_commerce_platform(html).alias("commerce_platform"),
        H.product_evidence(html).alias("product_evidence"),
        H.has_geo(html).alias("geo"),
        H.has_faqpage_markup(html).alias("faqpage_markup"),
        *props,
        H.question_heading_count(html).alias("question_headings"),
        H.is_form_page(html).alias("form_page"),
        H.has_mailto(html).alias("mailto"),
        H.has_tel(html).alias("tel"),
        H.has_noindex(html).alias("noindex"),
        H.newest_year(F.col("text")).alias("newest_year"),
        H.img_count(html).alias("images"),
        H.img_with_alt(html).alias("images_with_alt"),
        H.has_viewport(html).alias("viewport"),
        H.has_og(html).alias("og"),
        H.has_canonical(html).alias("canonical"),
        H.page_title(html).alias("title"),
        H.platform(html).alias("platform"),
        H.retail_hint(html).alias("retail_hint"),
    )


def crawled_signals(pages: DataFrame, crawl: DataFrame) -> DataFrame:
    """Signals of the crawled pages; paths are those of the addresses they were queued by.

    The crawl's ids meet the html before anything is parsed. The planner picks the join: a
    stored crawl that it sees to be small is broadcast and html is read in place, and a large
    one filters the scan at run time, so that only crawled pages are moved.
    """
    return page_signals(html_of(pages, crawl.drop("level")).drop("bucket"))


def site_rollup(signals: DataFrame) -> DataFrame:
    """One record per site from the signals of its crawled pages."""

    def paths(flag) -> object:
        rows = F.array_sort(F.collect_list(F.when(flag, F.struct("crawl_rank", "path"))))
        return F.transform(rows, lambda r: r["path"])

    home = F.min_by(
        F.struct(
            "origin", "images", "images_with_alt", "viewport", "og", "canonical", "title",
            "platform", "retail_hint",
        ),
        "crawl_rank",
    )
    rolled = signals.groupBy("site_key").agg(
        F.count("*").alias("page_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("schema_types"),
        F.count_if("has_schema_block").alias("pages_with_schema"),
        F.count_if("has_meta").alias("pages_with_meta"),
        F.count_if("form_page").alias("form_pages"),
        F.bool_or("breadcrumb").alias("has_breadcrumb"),
        F.bool_or("commerce_platform").alias("commerce_platform"),
        F.bool_or("geo").alias("has_geo"),
        F.bool_or("mailto").alias("has_mailto"),
        F.bool_or("tel").alias("has_tel"),
        F.bool_or("noindex").alias("has_noindex"),
        *[F.bool_or(f"prop_{n}").alias(f"prop_{n}") for n, _ in V.SCHEMA_PROPERTIES],
        F.sum("product_evidence").alias("product_evidence"),
        F.sum("question_headings").alias("question_headings"),
        F.max("newest_year").alias("newest_year"),
        paths(F.col("faqpage_markup")).alias("faq_pages"),
        paths(F.col("question_headings") > 0).alias("question_heading_pages"),
        home.alias("home"),
    )
    return rolled.select(
        *[c for c in rolled.columns if c != "home"],
        F.col("home.origin").alias("origin"),
        F.col("home.images").alias("home_img_count"),
        F.col("home.images_with_alt").alias("home_img_with_alt"),
        F.col("home.viewport").alias("has_viewport"),
        F.col("home.og").alias("has_og"),
        F.col("home.canonical").alias("home_canonical"),
        F.col("home.title").alias("home_title"),
        F.col("home.platform").alias("platform"),
        F.col("home.retail_hint").alias("retail_hint"),
    )


def commerce_state(evidence, has_platform) -> object:
    return choose(
        [(evidence >= V.STORE_EVIDENCE, "store"), (has_platform, "installed_empty")], "none"
    )


def complete_signals(
    rolled: DataFrame,
    as_of_year: int,
    sitemap_totals: DataFrame | None = None,
    page_cap: int = V.SUMMARY_PAGE_CAP,
) -> DataFrame:
    """Add the signals that follow from the rolled-up ones.

    ``sitemap_totals`` is (site_key, sitemap_total); a site without one counts its crawl.
    """
    if sitemap_totals is not None:
        rolled = rolled.join(sitemap_totals, "site_key", "left")
    else:
        rolled = rolled.withColumn("sitemap_total", F.lit(0).cast("bigint"))
    rolled = rolled.withColumn(
        "sitemap_total", F.coalesce(F.col("sitemap_total"), F.lit(0).cast("bigint"))
    )
    types = F.col("schema_types")
    flags = rolled.withColumns(
        {
            "has_faq_schema": H.any_type(types, V.FAQ_TYPES),
            "has_local_business": H.any_type(types, V.LOCAL_BUSINESS_TYPES),
            "has_organization": H.any_type(types, V.ORGANIZATION_TYPE),
            f"prop_{V.MENU_MARKUP}": H.any_type(types, V.MENU_TYPE),
            "commerce_state": commerce_state(
                F.col("product_evidence"), F.col("commerce_platform")
            ),
            "is_https": F.col("origin").startswith("https"),
            "looks_stale": F.coalesce(
                F.col("newest_year") <= as_of_year - V.STALE_AFTER_YEARS, F.lit(False)
            ),
            "site_size": F.greatest("page_count", "sitemap_total"),
            "crawl_capped": F.col("page_count") >= page_cap,
        }
    )
    derived = flags.withColumns(
        {
            "complete_local_entity": F.col("has_local_business") & F.col("has_geo"),
            "has_store": F.col("commerce_state") == "store",
        }
    ).withColumn(
        "has_entity_graph", F.col("complete_local_entity") | F.col("has_organization")
    )
    names = [n for n, _ in V.SCHEMA_PROPERTIES] + [V.MENU_MARKUP]
    props = F.struct(*[F.col(f"prop_{n}").alias(n) for n in names])
    return derived.withColumn("schema_props", props).drop(*[f"prop_{n}" for n in names])


def property_lists(signals: DataFrame) -> DataFrame:
    """Names of the schema properties found and not found, as readable lists."""
    names = [n for n, _ in V.SCHEMA_PROPERTIES] + [V.MENU_MARKUP]

    def listed(wanted: bool) -> object:
        hits = F.array(
            *[F.when(F.col(f"schema_props.{n}") == F.lit(wanted), F.lit(n)) for n in names]
        )
        text = F.array_join(F.array_compact(hits), ", ")
        return F.when(text == "", F.lit("none")).otherwise(text)

    return signals.withColumns(
        {"properties_found": listed(True), "properties_missing": listed(False)}
    )
