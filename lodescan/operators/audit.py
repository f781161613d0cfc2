"""Site audits: tier, quote, scores, and the joins with speed readings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as S
from ..sources.tables import tier_definitions


def tier_quotes(spark: SparkSession) -> DataFrame:
    """Quote of every tier: four rows. Enterprise sites get no number."""
    typical = F.filter("phases", lambda p: F.array_contains(F.col("typical"), p["phase"]))
    total = F.aggregate(typical, F.lit(0), lambda sum_so_far, p: sum_so_far + p["price"])
    return tier_definitions(spark).withColumns(
        {"quote_total": total, "first_price": F.get("phases", F.lit(0))["price"]}
    )


def with_tier(signals: DataFrame) -> DataFrame:
    return signals.withColumn("tier", S.classify(F.col("site_size"), F.col("has_store")))


def with_quote(df: DataFrame) -> DataFrame:
    """Join the quote of each row's tier; the four-row constant is broadcast."""
    return df.join(F.broadcast(tier_quotes(df.sparkSession)), "tier", "left")


def with_scores(signals: DataFrame) -> DataFrame:
    scored = signals.withColumns(
        {
            "pct": S.overall_score(),
            "organic": S.organic_score(),
            "answer": S.answer_score(),
            "local": S.local_score(),
        }
    )
    return scored.withColumn("grade", S.letter_grade(F.col("pct")))


def site_audit(signals: DataFrame) -> DataFrame:
    """Signals with tier, quote, overall score and the three surface scores."""
    audited = with_quote(with_scores(with_tier(signals)))
    return audited.withColumn("offer", S.offer_kind(F.col("enterprise"), F.col("pct")))


def scorecard(audit: DataFrame) -> DataFrame:
    return audit.select(
        "site_key", "page_count", "site_size", "tier", "commerce_state", "pct", "grade",
        "organic", "answer", "local", "quote_total",
    )


def display_bands(audit: DataFrame) -> DataFrame:
    """Colours and clamped meter values of the visual scorecard."""
    meters = {}
    for surface in ("organic", "answer", "local"):
        meters[f"{surface}_meter"] = S.meter_value(F.col(surface))
        meters[f"{surface}_color"] = S.meter_color(S.meter_value(F.col(surface)))
    return audit.withColumns({"grade_color": S.grade_color(F.col("pct")), **meters})


def attach(audit: DataFrame, speed: DataFrame | None, reports: DataFrame | None) -> DataFrame:
    """Left-join speed readings and model reports; an audit without them stays."""
    for other in (speed, reports):
        if other is not None:
            audit = audit.join(other, "site_key", "left")
    return audit


def crawled_pages(crawl: DataFrame) -> DataFrame:
    """Visited addresses per site, in crawl order; at most one crawl budget per site."""
    ordered = F.array_sort(F.collect_list(F.struct("crawl_rank", "url")))
    return crawl.groupBy("site_key").agg(
        F.transform(ordered, lambda r: r["url"]).alias("crawled_pages")
    )


SIGNAL_FIELDS = [
    "page_count", "crawl_capped", "sitemap_total", "site_size", "has_store",
    "commerce_state", "retail_hint", "platform", "is_https", "has_viewport", "has_og",
    "has_breadcrumb", "schema_types", "pages_with_schema", "pages_with_meta",
    "has_faq_schema", "faq_pages", "schema_props", "has_local_business", "has_geo",
    "complete_local_entity", "has_entity_graph", "has_organization", "question_headings",
    "question_heading_pages", "form_pages", "has_mailto", "has_tel", "home_canonical",
    "has_noindex", "newest_year", "looks_stale", "home_img_count", "home_img_with_alt",
    "home_title",
]


def audit_payload(audit: DataFrame) -> DataFrame:
    """One nested record per site, the shape the audit sink stores."""
    surfaces = F.struct("organic", "answer", "local")
    optional = [c for c in ("report", "speed", "crawled_pages") if c in audit.columns]
    return audit.select(
        "site_key",
        "origin",
        "tier",
        F.struct("pct", "grade", surfaces.alias("surfaces")).alias("score"),
        F.struct(*SIGNAL_FIELDS).alias("signals"),
        F.struct(
            "enterprise", F.col("quote_name").alias("name"), "phases", "typical",
            F.col("quote_total").alias("total"), "photo",
        ).alias("quote"),
        *optional,
    )
