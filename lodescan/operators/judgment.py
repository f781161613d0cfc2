"""Model input tables and the cleaning of model replies. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions import html as H
from ..functions.scoring import priority_color, priority_label, round_half_up
from ..functions.text import choose, or_blank, trim_ws
from ..functions.urls import path_or_root
from ..sources.page_store import html_of

FINDING = "struct<priority:string,title:string,rec:string>"
PAGE_REPLY = f"role string, findings array<{FINDING}>"
SITE_REPLY = (
    "summary string, voice string, "
    "surfaces struct<organic:string,answer:string,local:string>, "
    f"findings array<{FINDING}>"
)
PANEL_REPLY = "panel array<struct<name:string,role:string,comment:string>>"
SPEED_REPLY = (
    "lighthouseResult struct<"
    "categories:struct<performance:struct<score:double>>,"
    "audits:struct<`largest-contentful-paint`:struct<displayValue:string,numericValue:double>>>"
)


# --- model input ---------------------------------------------------------------------


def page_digests(pages: DataFrame, crawl: DataFrame, chars: int = V.DIGEST_CHARS) -> DataFrame:
    """Address, title and leading text of the first pages of each crawl."""
    marks = crawl.filter(F.col("crawl_rank") <= V.DIGEST_PAGES).select(
        "page_id", "url", "site_key", "crawl_rank", *[c for c in crawl.columns if c == "bucket"]
    )
    html = F.col("html")
    return html_of(pages, marks).select(
        "page_id", "site_key", "crawl_rank",
        F.concat_ws(
            "\n",
            F.concat(F.lit("URL: "), "url"),
            F.concat(F.lit("TITLE: "), H.page_title(html)),
            F.concat(F.lit("TEXT: "), F.left(H.strip_to_text(html), F.lit(chars))),
        ).alias("digest"),
    )


def joined_in_order(rows: DataFrame, text: str, separator: str, alias: str) -> DataFrame:
    """One string per site; callers pass at most one crawl budget of rows per site."""
    ordered = F.array_sort(F.collect_list(F.struct("crawl_rank", text)))
    return rows.groupBy("site_key").agg(
        F.array_join(F.transform(ordered, lambda r: r[text]), separator).alias(alias)
    )


def site_digests(pages: DataFrame, crawl: DataFrame) -> DataFrame:
    return joined_in_order(page_digests(pages, crawl), "digest", "\n\n---\n\n", "digests")


def fact_lines(audit: DataFrame) -> Column:
    """Measured facts of a site as text lines; ``audit`` must carry the property lists."""

    def count_of(part: str, whole: str) -> Column:
        return F.concat(F.col(part).cast("string"), F.lit("/"), F.col(whole).cast("string"))

    def listed(name: str, empty: str) -> Column:
        text = F.array_join(name, ", ")
        return F.when(text == "", F.lit(empty)).otherwise(text)

    sample = F.when(
        F.col("site_size") > F.col("page_count"),
        F.concat(F.lit(" of ~"), F.col("site_size").cast("string")),
    ).otherwise("")
    facts: list[tuple[str, Column]] = [
        ("tier", F.col("tier")),
        ("score", F.concat(F.col("pct").cast("string"), F.lit("% ("), "grade", F.lit(")"))),
        ("pages crawled", F.concat(F.col("page_count").cast("string"), sample)),
        ("platform", F.col("platform")),
        ("commerce", F.col("commerce_state")),
        ("retail", F.col("retail_hint").cast("string")),
        ("https", F.col("is_https").cast("string")),
        ("viewport", F.col("has_viewport").cast("string")),
        ("social tags", F.col("has_og").cast("string")),
        ("breadcrumbs", F.col("has_breadcrumb").cast("string")),
        ("pages with structured data", count_of("pages_with_schema", "page_count")),
        ("schema types", listed("schema_types", "NONE")),
        ("faq schema", F.col("has_faq_schema").cast("string")),
        ("faq pages", listed("faq_pages", "none")),
        ("properties found", F.col("properties_found")),
        ("properties not found", F.col("properties_missing")),
        ("local business type", F.col("has_local_business").cast("string")),
        ("geo coordinates", F.col("has_geo").cast("string")),
        ("complete local entity", F.col("complete_local_entity").cast("string")),
        ("organization", F.col("has_organization").cast("string")),
        ("question headings", F.col("question_headings").cast("string")),
        ("question heading pages", listed("question_heading_pages", "none")),
        ("pages with meta description", count_of("pages_with_meta", "page_count")),
        ("newest year", F.coalesce(F.col("newest_year").cast("string"), F.lit("none found"))),
        ("stale", F.col("looks_stale").cast("string")),
        ("home images with alt", count_of("home_img_with_alt", "home_img_count")),
        ("form pages", F.col("form_pages").cast("string")),
        ("mailto", F.col("has_mailto").cast("string")),
        ("tel", F.col("has_tel").cast("string")),
        ("canonical", F.col("home_canonical").cast("string")),
        ("noindex", F.col("has_noindex").cast("string")),
        ("home title", F.col("home_title")),
    ]
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {k}: "), v) for k, v in facts])


def site_prompt(audit: DataFrame, digests: DataFrame) -> DataFrame:
    """One model request per site: its facts and its page digests."""
    facts = audit.select("site_key", fact_lines(audit).alias("facts"))
    return facts.join(digests, "site_key", "left")


def page_prompt(facts: DataFrame) -> DataFrame:
    """One model request per page from ``page_facts``; map-only."""

    def pair(label: str, name: str) -> Column:
        return F.concat(F.lit(f"{label}="), F.col(name).cast("string"))

    types = F.array_join(F.slice("schema_types", 1, V.PROMPT_TYPES), ", ")
    line = F.concat_ws(
        " ",
        pair("schema", "has_schema"),
        F.concat(F.lit("types=["), types, F.lit("]")),
        pair("faqSchema", "has_faq_schema"),
        pair("menuSchema", "has_menu_schema"),
        pair("meta", "has_meta"),
        pair("images", "images"),
        pair("withAlt", "images_with_alt"),
        pair("questionHeadings", "question_headings"),
        pair("forms", "forms"),
        pair("formFields", "form_fields"),
        pair("mailto", "has_mailto"),
        pair("tel", "has_tel"),
    )
    return facts.select("page_id", "url", "title", line.alias("facts"), "text")


def panel_input(pages: DataFrame, crawl: DataFrame) -> DataFrame:
    """Leading text of each home page, the input of the reader panel."""
    homes = crawl.filter("crawl_rank = 1").drop("crawl_rank", "level", "origin")
    text = F.left(H.strip_to_text(F.col("html")), F.lit(V.PANEL_CHARS)).alias("text")
    return html_of(pages, homes).select(
        "site_key", "page_id", "url", text
    )


# --- model replies --------------------------------------------------------------------


def unfence(text: Column) -> Column:
    bare = F.regexp_replace(trim_ws(text), V.FENCE_OPEN, "")
    return trim_ws(F.regexp_replace(bare, V.FENCE_CLOSE, ""))


def parse_model_json(text: Column, schema: str) -> Column:
    """The reply as a struct, null unless it is one valid JSON value other than null."""
    cleaned = unfence(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), cleaned, F.lit("]")))
    single = wrapped.isNotNull() & F.try_variant_get(wrapped, "$[1]", "variant").isNull()
    present = (cleaned != "") & (cleaned != "null")
    return F.when(single & present, F.from_json(cleaned, schema))


def demote_hedged(findings: Column) -> Column:
    """A hedged finding is a guess; it never keeps the highest priority."""

    def demoted(f: Column) -> Column:
        text = F.concat(or_blank(f["title"]), F.lit(" "), or_blank(f["rec"]))
        hedged = (f["priority"] == "high") & text.rlike(V.HEDGES)
        priority = F.when(hedged, F.lit("med")).otherwise(f["priority"])
        return F.struct(priority.alias("priority"), f["title"].alias("title"), f["rec"].alias("rec"))

    return F.transform(findings, demoted)


def page_results(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Join page rows with their replies.

    A page without reply, or whose call failed (null text), keeps an empty result; a page
    whose reply cannot be parsed is dropped. ``responses`` is (page_id, text).
    """
    replied = responses.filter(F.col("text").isNotNull()).select(
        "page_id", F.lit(True).alias("replied"), parse_model_json(F.col("text"), PAGE_REPLY).alias("reply")
    )
    no_findings = F.array().cast(f"array<{FINDING}>")
    joined = pages.join(replied, "page_id", "left").filter(
        F.col("replied").isNull() | F.col("reply").isNotNull()
    )
    return joined.select(
        *pages.columns,
        or_blank(F.col("reply.role")).alias("role"),
        F.coalesce(demote_hedged(F.col("reply.findings")), no_findings).alias("findings"),
    )


def site_reports(responses: DataFrame) -> DataFrame:
    """Site-level replies with hedged findings demoted; unusable replies become null."""
    reply = parse_model_json(F.col("text"), SITE_REPLY)
    return responses.select("site_key", reply.alias("r")).select(
        "site_key",
        F.when(
            F.col("r").isNotNull(),
            F.struct("r.summary", "r.voice", "r.surfaces", demote_hedged(F.col("r.findings")).alias("findings")),
        ).alias("report"),
    )


def clean_panel(text: Column) -> Column:
    """At most six reader comments, each field cut to its length; null if there is none."""
    panel = parse_model_json(text, PANEL_REPLY)["panel"]
    rows = F.transform(
        F.slice(panel, 1, V.PANEL_ROWS),
        lambda p: F.struct(
            F.left(or_blank(p["name"]), F.lit(V.PANEL_NAME_CHARS)).alias("name"),
            F.left(or_blank(p["role"]), F.lit(V.PANEL_ROLE_CHARS)).alias("role"),
            F.left(or_blank(p["comment"]), F.lit(V.PANEL_COMMENT_CHARS)).alias("comment"),
        ),
    )
    return F.when(F.size(panel) > 0, rows)


def synthesis_input(results: DataFrame) -> DataFrame:
    """One line per page with its finding titles, joined per site in crawl order."""
    titles = F.array_join(F.transform("findings", lambda f: or_blank(f["title"])), "; ")
    lines = results.select(
        "site_key",
        "crawl_rank",
        F.concat("url", F.lit(" ("), "role", F.lit("): "), titles).alias("line"),
    )
    return joined_in_order(lines, "line", "\n", "synthesis")


def report_lines(results: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """One row per finding of the pages that have any, with the coverage of the report.

    ``summary`` is (site_key, site_size) of the summary audit; it may miss sites.
    """
    counted = results.groupBy("site_key").agg(F.count("*").alias("report_pages"))
    if summary is not None:
        counted = counted.join(summary.select("site_key", "site_size"), "site_key", "left")
    else:
        counted = counted.withColumn("site_size", F.lit(None).cast("bigint"))
    more = F.coalesce(F.col("site_size") > F.col("report_pages"), F.lit(False))
    pages_text = F.col("report_pages").cast("string")
    coverage = counted.select(
        "site_key",
        F.when(more, F.concat(pages_text, F.lit(" of ~"), F.col("site_size").cast("string")))
        .otherwise(pages_text)
        .alias("coverage"),
    )
    found = results.filter(F.size("findings") > 0).select(
        "site_key", "crawl_rank", path_or_root(F.col("url")).alias("path"), "role",
        F.posexplode("findings").alias("pos", "finding"),
    )
    lines = found.select(
        "site_key", "crawl_rank", "path", "role", "pos",
        priority_label(F.col("finding.priority")).alias("label"),
        priority_color(F.col("finding.priority")).alias("color"),
        F.col("finding.title").alias("title"),
        F.col("finding.rec").alias("rec"),
    )
    return lines.join(coverage, "site_key")


# --- page speed --------------------------------------------------------------------------


def speed_outcomes(attempts: DataFrame) -> DataFrame:
    """(page_id, status, body) of the attempts (page_id, attempt, ended, http, body) at a reading.

    ``ended`` is http, timeout or network; attempts count from 0. A first answer of 429 or of
    500 and more is followed by the second attempt, whatever that gives; a timeout, another
    answer and a network error are final. A second attempt that was never made is an error.
    """

    def numbered(number: int) -> Column:
        row = F.struct("ended", "http", "body")
        return F.min(F.when(F.col("attempt") == number, row))

    first, second = F.col("first"), F.col("second")
    again = (first["ended"] == "http") & ((first["http"] == 429) | (first["http"] >= 500))
    both = attempts.filter("attempt in (0, 1)").groupBy("page_id").agg(
        numbered(0).alias("first"), numbered(1).alias("second")
    )
    last = both.select(
        "page_id", F.when(F.coalesce(again, F.lit(False)), second).otherwise(first).alias("last")
    )
    ended = F.col("last.ended")
    answered = (ended == "http") & F.col("last.http").between(200, 299)
    status = F.when(ended == "timeout", F.lit("timeout")).when(answered, F.lit("ok"))
    return last.select(
        "page_id", F.coalesce(status, F.lit("error")).alias("status"),
        F.when(answered, F.col("last.body")).alias("body"),
    )


def speed_readings(results: DataFrame) -> DataFrame:
    """Adds score, lcp, lcp_ms, timed_out and the sentence ``read`` to (status, body)."""
    parsed = F.from_json("body", SPEED_REPLY)
    score = parsed["lighthouseResult"]["categories"]["performance"]["score"]
    lcp = parsed["lighthouseResult"]["audits"]["largest-contentful-paint"]
    ok = (F.col("status") == "ok") & score.isNotNull()
    late = F.col("status") == "timeout"
    display, millis = lcp["displayValue"], lcp["numericValue"]
    readings = results.withColumns(
        {
            "score": F.when(late, F.lit(V.TIMED_OUT_SCORE)).when(
                ok, round_half_up(score * 100).cast("int")
            ),
            "lcp": F.when(ok & (display != ""), display),
            "lcp_ms": F.when(ok & (millis != 0), millis),
            "timed_out": late,
        }
    )
    return readings.withColumn("read", speed_read())


def speed_read() -> Column:
    before, after = V.SPEED_LCP_TEXT
    lcp = F.coalesce(F.concat(F.lit(before), "lcp", F.lit(after)), F.lit(""))

    def sentence(parts: tuple[str, str]) -> Column:
        return F.concat(F.lit(parts[0]), lcp, F.lit(parts[1]))

    score = F.col("score")
    return choose(
        [
            (score.isNull(), F.lit(None).cast("string")),
            (F.col("timed_out"), V.SPEED_TIMED_OUT_TEXT),
            (score >= V.SPEED_FAST, sentence(V.SPEED_FAST_TEXT)),
            (score >= V.SPEED_MIDDLING, sentence(V.SPEED_MIDDLING_TEXT)),
        ],
        sentence(V.SPEED_SLOW_TEXT),
    )
