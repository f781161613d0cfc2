"""One registered query per operator group; each reads its whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from checks import inputs as I
from lodescan import fixed_values as V
from lodescan.functions import html as H
from lodescan.functions import scoring as S
from lodescan.functions import urls as U
from lodescan.operators import audit as A
from lodescan.operators import crawl as C
from lodescan.operators import intake as N
from lodescan.operators import judgment as J
from lodescan.operators import leads as L
from lodescan.operators import limits as M
from lodescan.operators import requests as R
from lodescan.operators import signals as G
from lodescan.operators.jsonld import schema_types_walk as walk_schema_types
from lodescan.operators.posts import posted_answers, read_posts
from lodescan.sources import sinks
from lodescan.sources.sitemaps import (
    child_sitemaps, choose_sitemaps, read_children, sitemap_files, sitemap_seeds,
    sitemap_totals, sitemap_urls,
)
from lodescan.plans import audits as P
from lodescan.sources.tables import page_index, tier_phases
from lodescan.sources.upserts import read_upserts
from lodescan.streaming.counters import write_daily_counts
from lodescan.streaming.leads import upsert_lead_stream, write_lead_stream
from lodescan.streaming.guard import guard_in_event_time, guard_stream, guarded
from lodescan.streaming.limiter import late_counts, limit_stream, run_available
from lodescan.session import materialize, new_folder

Query = Callable[[SparkSession, str], DataFrame]

AS_OF_YEAR = 2026
WINDOW = 3 * 86_400_000_000
SOFT, DAILY = 2, 1


def joined(array, separator: str = " | ") -> Column:
    return F.array_join(array, separator)


# --- addresses ------------------------------------------------------------------------


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return I.table(spark, sf, "pages").select(
        "page_id",
        U.normalize_url(F.concat(F.lit("  "), F.regexp_replace(url, "^https://", ""), F.lit(" "))).alias("normalized"),
        U.page_key(url).alias("page_key"),
        U.origin_of(url).alias("origin"),
        U.site_key(url).alias("site_key"),
        U.path_or_root(url).alias("path"),
        U.safe_host(url).alias("host"),
    )


def odd_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that are missing, blank, no address, upper-case, or have a port."""
    url = F.col("url")
    return I.odd_urls(spark, sf).select(
        "page_id",
        U.normalize_url(url).alias("normalized"),
        U.page_key(url).alias("page_key"),
        U.origin_of(url).alias("origin"),
        U.site_key(url).alias("site_key"),
        U.path_or_root(url).alias("path"),
        U.safe_host(url).alias("host"),
    )


def link_predicates(spark: SparkSession, sf: str) -> DataFrame:
    pages = I.site_pages(spark, sf)
    links = C.page_links(pages, V.SUMMARY_LINKS_PER_PAGE)
    origins = pages.select("page_id", U.Url(F.col("url")).origin.alias("page_origin"))
    url = U.Url(F.col("href"))
    return links.join(origins, "page_id").select(
        "page_id", "pos", F.coalesce(url.href, F.col("href")).alias("href"),
        F.coalesce(url.origin == F.col("page_origin"), F.lit(False)).alias("same_origin"),
        U.is_asset(url.path).alias("asset"),
        U.is_low_value_path(url.path).alias("low_value"),
    )


def all_page_links(spark: SparkSession, sf: str) -> DataFrame:
    links = C.page_links(I.site_pages(spark, sf), None)
    return links.groupBy("page_id").agg(
        F.count("*").alias("links"),
        F.count_if(F.col("href").rlike("^https?:")).alias("web_links"),
    )


# --- html -----------------------------------------------------------------------------


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return I.table(spark, sf, "pages").select("page_id", H.strip_to_text(F.col("html")).alias("text"))


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return I.site_pages(spark, sf).select("page_id", H.page_title(F.col("html")).alias("title"))


def ld_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = H.ld_json_blocks(F.col("html"))
    return I.site_pages(spark, sf).select(
        "page_id",
        F.size(blocks).alias("blocks"),
        joined(blocks).alias("bodies"),
        H.page_has_schema_block(F.col("html")).alias("has_block"),
        H.has_schema_mention(F.col("html")).alias("has_mention"),
    )


def schema_types_tree(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array_sort(H.schema_types_tree(F.col("html")))
    return I.site_pages(spark, sf).select("page_id", joined(types).alias("types"), F.size(types).alias("n"))


def schema_types_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The types of ``schema_types_tree``, found by walking the trees."""
    walked = walk_schema_types(I.site_pages(spark, sf))
    return walked.select(
        "page_id", joined("schema_types").alias("types"), F.size("schema_types").alias("n")
    )


def schema_types_regex(spark: SparkSession, sf: str) -> DataFrame:
    pages = I.site_pages(spark, sf).select("page_id", H.schema_types_regex(F.col("html")).alias("t"))
    return pages.select(
        "page_id",
        joined("t").alias("types"),
        joined(F.slice("t", 1, V.PROMPT_TYPES)).alias("prompt_types"),
        H.has_faq_type(F.col("t")).alias("has_faq"),
        H.has_menu_type(F.col("t")).alias("has_menu"),
    )


def page_meta_flags(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return I.site_pages(spark, sf).select(
        "page_id",
        H.has_meta_description(html).alias("meta"),
        H.img_count(html).alias("images"),
        H.img_with_alt(html).alias("images_with_alt"),
        H.has_viewport(html).alias("viewport"),
        H.has_og(html).alias("og"),
        H.has_breadcrumb(html).alias("breadcrumb"),
        H.has_commerce_platform(html).alias("commerce"),
        H.retail_hint(html).alias("retail"),
        H.platform(html).alias("platform"),
        H.has_geo(html).alias("geo"),
        H.has_faqpage_markup(html).alias("faqpage"),
        *[H.has_property(html, n).alias(f"prop_{n}") for n, _ in V.SCHEMA_PROPERTIES],
        H.has_mailto(html).alias("mailto"),
        H.has_tel(html).alias("tel"),
        H.has_canonical(html).alias("canonical"),
        H.has_noindex(html).alias("noindex"),
    )


def product_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return I.site_pages(spark, sf).select("page_id", H.product_evidence(F.col("html")).alias("evidence"))


def question_headings(spark: SparkSession, sf: str) -> DataFrame:
    return I.site_pages(spark, sf).select("page_id", H.question_heading_count(F.col("html")).alias("questions"))


def form_pages(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return I.site_pages(spark, sf).select(
        "page_id", H.form_count(html).alias("forms"), H.field_count(html).alias("fields"),
        H.is_form_page(html).alias("form_page"),
    )


def newest_year(spark: SparkSession, sf: str) -> DataFrame:
    text = H.strip_to_text(F.col("html"))
    return I.site_pages(spark, sf).select("page_id", H.newest_year(text).alias("newest_year"))


def page_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = G.page_facts(I.site_pages(spark, sf))
    return facts.withColumn("schema_types", joined("schema_types"))


def page_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return J.page_prompt(G.page_facts(I.site_pages(spark, sf)))


# --- sites ----------------------------------------------------------------------------


def _crawl(
    spark: SparkSession, sf: str, cap: int = V.SUMMARY_PAGE_CAP,
    per_page: int | None = V.SUMMARY_LINKS_PER_PAGE, sitemap: bool = True,
) -> P.Crawl:
    """Every site crawled from its root, sitemap and menus."""
    numbered = I.numbered_pages(spark, sf)
    linked = I.linked_pages(spark, sf, numbered)
    return P.crawl_sites(linked, I.site_maps(spark, sf, numbered) if sitemap else None, cap, per_page)


def _deep_crawl(spark: SparkSession, sf: str) -> P.Crawl:
    return _crawl(spark, sf, V.DEEP_PAGE_CAP, None)


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    return G.site_rollup(G.crawled_signals(I.site_pages(spark, sf), _crawl(spark, sf).plan))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return P.summary_signals(_crawl(spark, sf), AS_OF_YEAR, I.site_pages(spark, sf))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return A.site_audit(_signals(spark, sf))


def site_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).select(
        "site_key", "page_count", "pages_with_schema", "pages_with_meta", "form_pages",
        "has_breadcrumb", "commerce_platform", "has_geo", "has_mailto", "has_tel", "has_noindex",
        *[f"prop_{n}" for n, _ in V.SCHEMA_PROPERTIES],
        "product_evidence", "question_headings", "newest_year",
    )


def site_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).select(
        "site_key",
        joined("schema_types").alias("schema_types"),
        joined("faq_pages").alias("faq_pages"),
        joined("question_heading_pages").alias("question_heading_pages"),
    )


def home_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _rolled(spark, sf).select(
        "site_key", "origin", "home_img_count", "home_img_with_alt", "has_viewport", "has_og",
        "home_canonical", "home_title", "platform", "retail_hint",
    )


def site_entity_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select(
        "site_key", "has_faq_schema", "has_local_business", "has_organization",
        "complete_local_entity", "has_entity_graph", "is_https", "looks_stale", "crawl_capped",
        "properties_found", "properties_missing",
    )


def commerce_state(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("site_key", "product_evidence", "commerce_state", "has_store")


def tier_and_quote(spark: SparkSession, sf: str) -> DataFrame:
    """Tier by the whole stored size of each site, so that every tier occurs."""
    sizes = I.site_pages(spark, sf).select(U.site_key(F.col("url")).alias("site_key"), H.product_evidence(F.col("html")).alias("e"))
    sites = sizes.groupBy("site_key").agg(F.count("*").alias("site_size"), F.sum("e").alias("e"))
    tiers = A.with_quote(A.with_tier(sites.withColumn("has_store", F.col("e") >= V.STORE_EVIDENCE)))
    return tiers.select(
        "site_key", "site_size", "has_store", "tier", "quote_name", "enterprise", "quote_total",
        "first_price", joined("typical").alias("typical"), F.size("phases").alias("phase_count"), "photo",
    )


def site_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Phases of each site's tier that are part of its typical quote."""
    typical = _audit(spark, sf).select("site_key", "tier", F.explode("typical").alias("phase"))
    return typical.join(F.broadcast(tier_phases(spark)), ["tier", "phase"]).select(
        "site_key", "tier", "phase", "price"
    )


def site_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return A.scorecard(_audit(spark, sf))


def display_bands(spark: SparkSession, sf: str) -> DataFrame:
    bands = A.display_bands(_audit(spark, sf))
    meters = [f"{s}_{k}" for s in ("organic", "answer", "local") for k in ("meter", "color")]
    return bands.select("site_key", "pct", "grade", "grade_color", *meters, "offer", "first_price")


def _home_rows(crawl: P.Crawl, rows: DataFrame) -> DataFrame:
    homes = crawl.plan.filter("crawl_rank = 1").select("site_key", "page_id")
    return rows.join(homes, "page_id")


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary audit end to end, with the speed reading and report of the home page."""
    crawl = _crawl(spark, sf)
    speed = J.speed_readings(_home_rows(crawl, I.speed(spark, sf))).filter("score is not null")
    speed = speed.select("site_key", F.struct("score", "lcp", "read").alias("speed"))
    reports = J.site_reports(_home_rows(crawl, I.reports(spark, sf)))
    return P.summary_audit(crawl, AS_OF_YEAR, speed, reports, I.site_pages(spark, sf))


def site_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Audits with the speed reading and report of their home page, where there is one."""
    return _summary(spark, sf).select(
        "site_key", "tier", "pct",
        F.col("speed.score").alias("speed_score"),
        F.col("speed.lcp").alias("lcp"),
        F.col("report.summary").alias("summary"),
        F.col("report.surfaces.answer").alias("answer_read"),
        F.get(F.col("report.findings"), 0)["priority"].alias("first_priority"),
    )


def summary_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl, signals, size from the sitemap, tier, quote, scores and visited addresses."""
    return _summary(spark, sf).select(
        "site_key", "origin", "page_count", "sitemap_total", "site_size", "crawl_capped", "tier",
        "quote_name", "quote_total", "pct", "grade", "organic", "answer", "local",
        F.col("speed.read").alias("speed_read"), F.col("report.summary").alias("summary"),
        joined("crawled_pages").alias("crawled_pages"),
    )


def audit_payload(spark: SparkSession, sf: str) -> DataFrame:
    """The nested record of the audit sink, written and read back."""
    path = new_folder(spark, "audits")
    payload = materialize(A.audit_payload(_audit(spark, sf)), "audit-payload")
    # a first attempt of the run has half of the sites, under another tier
    sinks.write_audits(payload.filter("score.pct < 50").withColumn("tier", F.lit("unknown")), path, "r1")
    sinks.write_audits(payload, path, "r1")
    schema = (
        "site_key string, tier string, score struct<pct:int,grade:string,surfaces:struct<organic:int,answer:int,local:int>>, "
        "signals struct<schema_props:struct<sameAs:boolean,menuMarkup:boolean>,home_title:string>, "
        "quote struct<enterprise:boolean,name:string,total:int>"
    )
    return spark.read.schema(f"{schema}, run string").json(path).select(
        "site_key", "tier", F.col("score.pct").alias("pct"), F.col("score.surfaces.local").alias("local"),
        F.col("signals.schema_props.sameAs").alias("same_as"),
        F.col("signals.schema_props.menuMarkup").alias("menu_markup"),
        F.col("signals.home_title").alias("home_title"),
        F.col("quote.name").alias("quote_name"), F.col("quote.total").alias("quote_total"),
    )


# --- sitemaps and crawl -----------------------------------------------------------------


def _sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    return I.site_maps(spark, sf, I.numbered_pages(spark, sf))


def sitemap_choice(spark: SparkSession, sf: str) -> DataFrame:
    chosen = choose_sitemaps(sitemap_files(_sitemaps(spark, sf)))
    return chosen.select("origin", "path", "is_index", F.size("locs").alias("locs"))


def sitemap_children(spark: SparkSession, sf: str) -> DataFrame:
    return child_sitemaps(choose_sitemaps(sitemap_files(_sitemaps(spark, sf))))


def sitemap_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    files = materialize(sitemap_files(_sitemaps(spark, sf)), "sitemap-files")
    read = read_children(files, child_sitemaps(choose_sitemaps(files)))
    return read.select("origin", "file_no", "child_url", F.size("locs").alias("locs"), "before")


def sitemap_total(spark: SparkSession, sf: str) -> DataFrame:
    urls = sitemap_urls(_sitemaps(spark, sf))
    seeds = sitemap_seeds(urls).groupBy("origin").agg(F.count("*").alias("seeds"))
    return sitemap_totals(urls).join(seeds, "origin", "left")


def crawl_plan_12(spark: SparkSession, sf: str) -> DataFrame:
    return _crawl(spark, sf).plan.select("site_key", "page_id", "url", "crawl_rank")


def crawl_plan_15(spark: SparkSession, sf: str) -> DataFrame:
    return _deep_crawl(spark, sf).plan.select("site_key", "page_id", "url", "crawl_rank")


def crawl_links_only(spark: SparkSession, sf: str) -> DataFrame:
    """Without sitemaps every page but the root is found through links."""
    return _crawl(spark, sf, sitemap=False).plan.select("site_key", "page_id", "url", "crawl_rank")


# --- model input and replies --------------------------------------------------------------


def site_digests(spark: SparkSession, sf: str) -> DataFrame:
    return J.site_digests(I.site_pages(spark, sf), _crawl(spark, sf).plan)


def site_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """One model request per site: its facts and its page digests."""
    crawl, pages = _crawl(spark, sf), I.site_pages(spark, sf)
    audit = A.site_audit(P.summary_signals(crawl, AS_OF_YEAR, pages))
    return J.site_prompt(audit, J.site_digests(pages, crawl.plan))


def panel_input(spark: SparkSession, sf: str) -> DataFrame:
    return J.panel_input(I.site_pages(spark, sf), _crawl(spark, sf).plan)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    plan = _deep_crawl(spark, sf).plan.select("site_key", "crawl_rank", "page_id", "url")
    return J.page_results(plan, I.responses(spark, sf))


def findings_clean(spark: SparkSession, sf: str) -> DataFrame:
    pages = page_index(I.table(spark, sf, "pages")).select("page_id", "url")
    results = J.page_results(pages, I.responses(spark, sf))
    exploded = results.select("page_id", "role", F.posexplode_outer("findings").alias("pos", "f"))
    return exploded.select(
        "page_id", "role", "pos", F.col("f.priority").alias("priority"),
        F.col("f.title").alias("title"), F.col("f.rec").alias("rec"),
    )


def synthesis_input(spark: SparkSession, sf: str) -> DataFrame:
    return J.synthesis_input(_results(spark, sf))


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two sites in three have a summary audit that tells their size."""
    sizes = page_index(I.table(spark, sf, "pages")).groupBy("site_key").agg(F.count("*").alias("site_size"))
    known = F.expr(f"({I.SITE_NO.replace('host', 'site_key')}) % 3 <> 0")
    return J.report_lines(_results(spark, sf), sizes.filter(known))


def _deep(spark: SparkSession, sf: str) -> DataFrame:
    """The deep report end to end, written as its sink does and read back."""
    crawl = _deep_crawl(spark, sf)
    panels = _home_rows(crawl, I.panels(spark, sf)).select("site_key", "text")
    report = P.deep_report(crawl, I.responses(spark, sf), panels, I.site_pages(spark, sf))
    path = new_folder(spark, "deep")
    sinks.write_deep(report.limit(5), path, "r1")  # an attempt that was repeated
    sinks.write_deep(report, path, "r1")
    return spark.read.schema(report.schema).parquet(path)


def deep_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = _deep(spark, sf).select("site_key", F.posexplode("pages").alias("pos", "page"))
    return rows.select(
        "site_key", "pos", F.col("page.url").alias("url"), F.col("page.title").alias("title"),
        F.col("page.role").alias("role"), F.size("page.findings").alias("findings"),
    )


def deep_report(spark: SparkSession, sf: str) -> DataFrame:
    """Page records, synthesis line and reader panel of a site in one record."""
    return _deep(spark, sf).select(
        "site_key", F.size("pages").alias("pages"), "synthesis",
        joined(F.transform("panel", lambda p: F.concat_ws("/", p["name"], p["role"], p["comment"]))).alias("panel"),
    )


def page_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The page behind one address, asked for by another spelling of it."""
    wanted = I.table(spark, sf, "pages").agg(F.min_by("url", "page_id")).first()[0]
    spelled = re.sub(r"^https?://(www[.])?([^?#]*).*", r"HTTP://WWW.\2/", wanted).upper()
    facts = P.page_audit(I.site_pages(spark, sf), spelled, I.PAGE_BUCKETS)
    return facts.withColumn("schema_types", joined("schema_types"))


def panel_clean(spark: SparkSession, sf: str) -> DataFrame:
    panel = J.clean_panel(F.col("text"))
    rows = I.panels(spark, sf).select("page_id", F.posexplode_outer(panel).alias("pos", "p"))
    return rows.select(
        "page_id", "pos", F.col("p.name").alias("name"), F.col("p.role").alias("role"),
        F.col("p.comment").alias("comment"),
    )


def speed_readings(spark: SparkSession, sf: str) -> DataFrame:
    return J.speed_readings(I.speed(spark, sf)).select(
        "page_id", "score", "lcp", "lcp_ms", "timed_out", "read"
    )


def speed_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Readings after up to two attempts a page."""
    outcomes = J.speed_outcomes(I.speed_attempts(spark, sf))
    return J.speed_readings(outcomes).select("page_id", "status", "score", "lcp", "lcp_ms", "timed_out", "read")


# --- leads and intake -----------------------------------------------------------------------


def leads_valid(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = L.validate_leads(I.leads(spark, sf))
    return accepted.withColumn("reply_to", L.valid_email(F.col("email")))


def leads_rejected(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = L.validate_leads(I.leads(spark, sf))
    return rejected.select("lead_id", "received_at", "name", "email")


def lead_summary(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = L.validate_leads(I.leads(spark, sf))
    return L.lead_summary(accepted).select("lead_id", "score_text", "headline", "body")


def leads_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The lead sink, appended to and read back, reduced to the last row of each key."""
    accepted, _ = L.validate_leads(I.leads(spark, sf))
    path = new_folder(spark, "lead-sink")
    sinks.append_leads(accepted, path)
    accepted = spark.read.schema(accepted.schema).parquet(path)
    return sinks.latest_leads(accepted).select("received_at", "email", "lead_id", "name", "score")


def _submissions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col

    def picked(name: str) -> Column:
        return F.filter(F.split(c(name), r"\|"), lambda v: v != "")

    layout = [
        ("The business", [N.text_answer("Business name", c("business")), N.text_answer("Address", c("address")), N.text_answer("Phone", c("phone")), N.text_answer("Google Business Profile", c("profile"))]),
        ("Pages", [N.choice_answer("Pages needed", picked("pages_picked"))]),
        ("FAQs", [N.faq_answer(1, c("faq_q1"), c("faq_a1")), N.faq_answer(2, c("faq_q2"), c("faq_a2"))]),
        ("Goals", [N.text_answer("Anything else", c("notes")), N.choice_answer("Primary goals", picked("goals_picked"))]),
    ]
    forms = I.intake_forms(spark, sf).withColumn("sections", N.collect_sections(layout))
    return N.filter_honeypot(forms)


def intake_long(spark: SparkSession, sf: str) -> DataFrame:
    return N.intake_flatten(_submissions(spark, sf))


def intake_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return N.intake_markdown(_submissions(spark, sf))


def intake_posted(spark: SparkSession, sf: str) -> DataFrame:
    """Forms posted as JSON texts, whatever their sections and questions."""
    forms, _ = read_posts(I.intake_posts(spark, sf))
    return posted_answers(forms)


def intake_unread(spark: SparkSession, sf: str) -> DataFrame:
    _, unread = read_posts(I.intake_posts(spark, sf))
    return unread


# --- requests and limits -----------------------------------------------------------------------


def request_meta(spark: SparkSession, sf: str) -> DataFrame:
    return R.request_meta(I.request_log(spark, sf)).select(
        "event_id", "owner_run", "where", "org", "ip", "src", "ua"
    )


def origin_rejects(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = R.split_by_origin(I.request_log(spark, sf))
    return rejected.select("event_id", "origin", "host")


def soft_limit(spark: SparkSession, sf: str) -> DataFrame:
    decided = M.soft_limit(I.limiter_requests(spark, sf), WINDOW, SOFT)
    return decided.select("event_id", "kind", "ip", "soft_ok")


def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    decided = M.limiter(I.limiter_requests(spark, sf), WINDOW, SOFT, DAILY)
    return decided.select("event_id", "soft_ok", "daily_ok", "admitted")


def bypass(spark: SparkSession, sf: str) -> DataFrame:
    requests = I.limiter_requests(spark, sf).withColumn("bypass", F.col("ip").endswith("7"))
    return M.limiter(requests, WINDOW, SOFT, DAILY).select("event_id", "admitted")


def trailing_hits(spark: SparkSession, sf: str) -> DataFrame:
    return M.trailing_hits(I.limiter_requests(spark, sf), WINDOW).select("event_id", "hits")


def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.daily_counts(I.limiter_requests(spark, sf))


def guard_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind under its own limits, requests without an ip under one."""
    decided = M.guard_limits(I.guard_requests(spark, sf))
    return decided.select("event_id", "kind", "ip", "soft_ok", "daily_ok", "admitted")


def stream_soft_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The requests in several micro-batches, the state carried from one to the next."""
    folder = I.request_files(spark, sf)
    requests = spark.readStream.schema(
        "kind string, ip string, ts bigint, event_id bigint"
    ).option("maxFilesPerTrigger", 1).parquet(folder)
    limited = limit_stream(requests, WINDOW, SOFT, DAILY, ttl_ms=None)
    out = run_available(limited, spark, "limiter")
    return out.select("event_id", "soft_ok", "daily_ok", "admitted", "late")


GUARD_REQUEST = "event_id bigint, kind string, ip string, ts bigint"
# how late a request may come; the derived requests span months, a thousand times denser
GUARD_DELAY_MS = 600_000


def _stream(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_guard_limits(spark: SparkSession, sf: str) -> DataFrame:
    """The limits of each kind on a stream of several micro-batches, in typed state."""
    folder = I.files_in_order(["ts", "event_id"], I.guard_requests(spark, sf))
    decided = guard_stream(_stream(spark, folder, GUARD_REQUEST), live=False)
    return run_available(decided, spark, "guard").select(
        "event_id", "kind", "ip", "soft_ok", "daily_ok", "admitted"
    )


def guarded_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Origin check, bypass and limits in one chain: what became of every request."""
    return guarded(I.guard_log(spark, sf), M.guard_limits)


def stream_guarded_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The same chain on a stream."""
    folder = I.files_in_order(["ts", "event_id"], I.guard_log(spark, sf))
    log = _stream(spark, folder, f"{GUARD_REQUEST}, origin string, host string, bypass boolean")
    out = guarded(log, lambda requests: guard_stream(requests, live=False))
    return run_available(out, spark, "guarded")


def _event_time(spark: SparkSession, sf: str) -> DataFrame:
    folder = I.delayed_requests(spark, sf, GUARD_DELAY_MS)
    decided = guard_in_event_time(
        _stream(spark, folder, GUARD_REQUEST), f"{GUARD_DELAY_MS} milliseconds"
    )
    return run_available(decided, spark, "event-time")


def stream_event_time(spark: SparkSession, sf: str) -> DataFrame:
    """Requests out of order within the delay, decided in their own order; others are late."""
    return _event_time(spark, sf).select("event_id", "soft_ok", "daily_ok", "admitted", "late")


def stream_late_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The side count of the event-time guard: requests per kind and day that came too late."""
    return late_counts(_event_time(spark, sf))


def stream_leads(spark: SparkSession, sf: str) -> DataFrame:
    schema = I.table(spark, sf, "customer").schema
    customers = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    leads = spark.sql(I.LEADS, customer=customers)
    path = new_folder(spark, "leads")
    write_lead_stream(leads, path, new_folder(spark, "lead-checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("lead_id", "email", F.col("accepted").cast("boolean"))


# buckets of the merged tables
MERGE_BUCKETS = 8


def stream_leads_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Last write wins on a stream; one of its batches comes a second time at the end."""
    customers = I.table(spark, sf, "customer")
    folder = I.files_in_order(["c_custkey"], customers)
    path = new_folder(spark, "latest-leads")
    replay = I.files_in_order(["c_custkey"], customers.filter("c_custkey % 3 = 1"))
    for source in (folder, replay):
        leads = spark.sql(I.LEADS, customer=_stream(spark, source, customers.schema))
        upsert_lead_stream(
            leads, path, new_folder(spark, "latest-checkpoint"), MERGE_BUCKETS
        ).awaitTermination()
    schema = "received_at string, email string, lead_id bigint, name string, score string"
    return read_upserts(spark, path, schema).drop("bucket")


def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests per day as a watermarked aggregate in update mode, merged into a table."""
    folder = I.files_in_order(["ts", "event_id"], I.limiter_requests(spark, sf))
    path = new_folder(spark, "day-counts")
    write_daily_counts(
        _stream(spark, folder, GUARD_REQUEST), path, new_folder(spark, "day-checkpoint"),
        buckets=MERGE_BUCKETS,
    ).awaitTermination()
    return read_upserts(spark, path, "kind string, ip string, day bigint, requests bigint").drop("bucket")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        url_parts, odd_urls, link_predicates, all_page_links, page_text, page_titles, ld_blocks,
        schema_types_tree, schema_types_walk, schema_types_regex, page_meta_flags, product_evidence,
        question_headings, form_pages, newest_year, page_facts, page_prompts, site_rollup,
        site_lists, home_signals, site_entity_flags, commerce_state, tier_and_quote,
        site_phases, site_scorecard, display_bands, site_audit, summary_audit, audit_payload,
        sitemap_choice, sitemap_children, sitemap_cutoff, sitemap_total, crawl_plan_12,
        crawl_plan_15, crawl_links_only, site_digests, site_prompts, panel_input,
        findings_clean, synthesis_input, report_lines, deep_payload, deep_report, page_audit,
        panel_clean,
        speed_readings, leads_valid, leads_rejected, lead_summary, leads_latest,
        intake_long, intake_markdown, intake_posted, intake_unread, request_meta, origin_rejects, soft_limit, daily_cap,
        bypass, guard_limits, trailing_hits, daily_counts, stream_soft_limit, stream_leads,
        stream_guard_limits, guarded_requests, stream_guarded_requests, stream_event_time,
        speed_attempts, stream_late_counts, stream_leads_latest, stream_daily_counts,
    ]
}
