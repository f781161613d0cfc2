"""Inputs of the registered queries, derived from the given tables.

The stock pages carry hardly any markup, so signals are added to them by rules over
``page_id`` and the host. The SQL texts run unchanged in Spark and in the comparison engine
and are map-only. Where a rule needs the pages of a whole site (link tree, sitemaps), Spark
numbers the pages block-wise and moves addresses only; the oracle uses plain windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodescan.operators.grouping import number_within
from lodescan.session import materialize, new_folder
from lodescan.sources.page_store import stored_pages
from lodescan.sources.tables import page_index, usable_pages

HOST = "regexp_extract(url, '^https?://(www[.])?([^/:?#]+)', 2)"
# a number per site that both engines compute alike
SITE_NO = (
    "(length(host) * 13 + ascii(substr(host, 4, 1)) * 7 + ascii(substr(host, 6, 1)) * 5"
    " + ascii(substr(host, 7, 1)) * 3 + ascii(substr(host, 8, 1)))"
)
SITEMAP_PAGES_PER_FILE = 8
# buckets of the stored page tables
PAGE_BUCKETS = 32
# a larger site has an index over several files, as the sitemap protocol asks
SITEMAP_PLAIN_PAGES = 50_000

SITE_PAGES = f"""
WITH base AS (SELECT page_id, url, html, {HOST} AS host FROM {{pages}}),
n AS (SELECT *, {SITE_NO} AS s FROM base)
SELECT page_id, url, concat(
  replace(replace(html, '<title>', CASE WHEN s % 6 = 5 THEN '<title>Home</title><title>' WHEN s % 7 = 6 THEN '<TITLE lang="x"> Untitled page of this site </TITLE><title>' ELSE '<title>' END),
   '</head>', concat(
    CASE WHEN s % 2 = 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END,
    CASE WHEN s % 3 = 0 THEN '<meta property="og:title" content="x">' ELSE '' END,
    CASE WHEN s % 4 = 3 THEN '<meta name="description" content="A description of more than twenty characters">'
         WHEN page_id % 8 = 4 THEN '<meta name="description" content="too short">'
         WHEN page_id % 8 = 5 THEN '<meta content="A description of more than twenty characters" name="description">'
         WHEN page_id % 4 <> 0 THEN '<META class="m" NAME="description" data-x="1" content="A description of more than twenty characters">' ELSE '' END,
    CASE WHEN s % 4 = 1 THEN '<link rel="canonical" href="/">' ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '<meta name="robots" content="noindex,follow">' ELSE '' END,
    CASE WHEN page_id % 2 = 1 AND s % 11 <> 0 THEN ''
         WHEN s % 5 = 0 THEN '<script type="application/ld+json">{{{{"@context":"https://schema.org","@type":"Organization","sameAs":["https://a.example"],"award":"best"}}}}</script>'
         WHEN s % 5 = 1 THEN '<script type="application/ld+json">{{{{"@graph":[{{{{"@type":"LocalBusiness","telephone":"1","geo":{{{{"@type":"GeoCoordinates","latitude":1}}}}}}}},{{{{"@type":"Organization"}}}}]}}}}</script>'
         WHEN s % 5 = 2 THEN '<script type="application/ld+json">{{{{"@type":["Restaurant","Bar",""],"priceRange":"$$","servesCuisine":"x","hasMenu":{{{{"@type":"Menu","name":"say @type:No"}}}}}}}}</script>'
         WHEN s % 5 = 3 THEN '<script type="application/ld+json">{{{{"@type":"WebSite",</script><script type="application/ld+json"> {{{{"@type":"WebPage"}}}} trailing</script><script type="application/ld+json"> [{{{{"@type":"Newspaper"}}}},{{{{"@type":"MenuItem"}}}}] </script>'
         ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN '<SCRIPT type="application/ld+json">{{{{"@type" : "FAQPage","mainEntity":[{{{{"@type":"Question","name":"q"}}}}]}}}}</SCRIPT>' ELSE '' END,
    CASE WHEN page_id % 10 = 6 THEN '<script type="application/ld+json">{{{{"@type":"Product","name":"p","openingHours":"Mo"}}}}</script>' ELSE '' END,
    CASE WHEN page_id % 13 = 7 THEN '<script type="application/ld+json">{{{{"@type":["Odd]x","Plain"],"about":{{{{"@type":"First","name":"n","@type":"Last"}}}}}}}}</script>' ELSE '' END,
    CASE WHEN s % 6 = 1 THEN '<link href="/wp-content/t.css">' WHEN s % 6 = 2 THEN '<script src="https://cdn.shopify.com/a.js"></script>' WHEN s % 6 = 3 THEN '<img src="https://static.wix.com/x.png">' WHEN s % 6 = 4 THEN '<meta name="generator" content="Squarespace">' ELSE '' END,
    '</head>')),
  CASE WHEN page_id % 3 = 1 THEN '<img src="a.png" alt=""><IMG src="b.png" alt="b"><imgx alt="">' WHEN page_id % 3 = 2 THEN '<img src="a.png" data-alt><img src="b.png" alt = "b">' ELSE '' END,
  CASE WHEN page_id % 2 = 0 THEN '<h2><span>How are prints made?</span></h2><h3>Statement</h3><h5>Ignored?</h5><H4 class="q">Why <b>so</b> ? </H4>' ELSE '' END,
  CASE WHEN page_id % 5 = 2 THEN '<form><input name="a"><textarea></textarea><select></select></form>' WHEN page_id % 5 = 3 THEN '<form><input></form><formula>' ELSE '' END,
  CASE WHEN page_id % 4 = 1 THEN '<a href="mailto:a@b.example">m</a>' ELSE '' END,
  CASE WHEN page_id % 6 = 1 THEN '<a class="x" href="tel:1">t</a>' ELSE '' END,
  CASE WHEN s % 5 = 1 OR s % 11 = 0 THEN '<div class="BreadCrumb">x</div>' ELSE '' END,
  CASE WHEN s % 7 = 1 THEN '<div class="woocommerce"></div>' WHEN s % 7 = 2 THEN '<div class="WooCommerce"></div><a href="/product/a">a</a><button>Add to cart</button>' WHEN s % 7 = 3 THEN '<button>add-to-cart</button>' WHEN s % 7 = 4 AND page_id % 9 = 0 THEN '<a href="/shop/x-1">s</a><a href="/products/">s</a><a href="/product/1">s</a><a href="/product/2">s</a><a href="/product/3">s</a><a href="/product/4">s</a>' ELSE '' END,
  CASE WHEN s % 4 = 2 THEN '<p>Our gallery shop</p>' WHEN s % 4 = 0 THEN '<p>workshops bookstore prints2</p>' ELSE '' END,
  CASE WHEN page_id % 2 = 1 THEN concat('<p>Updated ', CASE WHEN s % 3 = 0 THEN '2025' ELSE '2019' END, ' price $2028.0 code 12020 v3.2024 and 2011/2012.</p>') ELSE '' END,
  '<a href="/style.css">c</a><a href="#top">t</a><a href="https://other.example.com/x">o</a><a href="next">n</a><a href="?q=1">q</a><a href="//cdn.example.org/lib">l</a>',
  CASE WHEN page_id % 31 = 5 THEN repeat('<a href="/more/">m</a>', 90) ELSE '' END
) AS html
FROM n
"""

# the whole title as the inside of a JSON string
TITLE = (
    "replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), chr(92), concat(chr(92), chr(92))),"
    " '\"', concat(chr(92), '\"')), chr(10), concat(chr(92), 'n'))"
)

# addresses as people write them, one kind after the other
ODD_URLS = """
SELECT page_id, url AS plain, CASE page_id % 8
  WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN 'no address here' WHEN 3 THEN replace(url, '.example', '.EXAMPLE')
  WHEN 4 THEN concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), ':8080/Odd//')
  WHEN 5 THEN concat('  https://', split_part(url, '/', 3), ':443/a b ')
  WHEN 6 THEN concat(split_part(url, '/', 3), '?q=1') ELSE concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), ':99999/') END AS url
FROM {pages}
"""

RESPONSES = """
WITH p AS (SELECT page_id, TITLE_TEXT AS t FROM {pages}),
f AS (SELECT page_id, concat(
  '"findings":[{{"priority":"high","title":"', t, ' heading","rec":"',
  CASE page_id % 7 WHEN 0 THEN 'Confirm the phone number' WHEN 1 THEN 'It may help to add hours' WHEN 2 THEN 'A maybe is no may.'
    WHEN 3 THEN 'Please check that it works' WHEN 4 THEN 'Reconfirmed facts only' WHEN 5 THEN 'Could be shorter' ELSE 'Add the town to the title' END,
  '"}},{{"priority":"', CASE page_id % 3 WHEN 0 THEN 'med' WHEN 1 THEN 'low' ELSE 'high' END, '","title":"Second","rec":"Likely fine"}},{{"priority":"high","rec":"No heading given"}}]'
  ) AS findings, t FROM p)
SELECT page_id, CASE page_id % 8
  WHEN 0 THEN concat('```json', chr(10), '{{"role":"Page of ', t, '",', findings, '}}', chr(10), '```')
  WHEN 1 THEN concat('  {{"role":"Plain","extra":{{"a":[1,2]}},', findings, '}}  ')
  WHEN 2 THEN concat('{{"role":"Broken",', findings)
  WHEN 3 THEN concat('```JSON {{', findings, '}}```')
  WHEN 4 THEN '{{"role":"Nothing to fix","findings":[]}}'
  WHEN 5 THEN concat('{{"role":null,', findings, '}}')
  WHEN 6 THEN concat('{{"role":"Trailing",', findings, '}} done')
  ELSE CAST(NULL AS STRING) END AS text
FROM f
""".replace("TITLE_TEXT", TITLE)

REPORTS = """
WITH p AS (SELECT page_id, TITLE_TEXT AS t FROM {pages})
SELECT page_id, CASE page_id % 4
  WHEN 0 THEN concat('```json', chr(10), '{{"summary":"Verdict on ', t, '","voice":"Dry.","surfaces":{{"organic":"o","answer":"a","local":"l"}},"findings":[{{"priority":"high","title":"Likely thin","rec":"Write more"}}]}}', chr(10), '```')
  WHEN 1 THEN concat('{{"summary":"Short ', t, '","findings":[{{"priority":"high","title":"No markup","rec":"Add it"}}]}}')
  WHEN 2 THEN '{{"summary":'
  ELSE CAST(NULL AS STRING) END AS text
FROM p
""".replace("TITLE_TEXT", TITLE)

PANELS = """
WITH p AS (SELECT page_id, TITLE_TEXT AS t FROM {pages}),
r AS (SELECT page_id, concat('{{"name":"Reader with a rather long name ', t, '","role":"', repeat('role ', 12), '","comment":"', repeat(concat(t, '. '), 40), '"}}') AS reader FROM p)
SELECT page_id, CASE page_id % 4
  WHEN 0 THEN concat('{{"panel":[', repeat(concat(reader, ','), 6), '{{"name":"Seventh","role":"r","comment":"c"}}]}}')
  WHEN 1 THEN '{{"panel":[]}}'
  WHEN 2 THEN concat('{{"panel":[', reader)
  ELSE concat('```json', chr(10), '{{"panel":[', reader, ',{{"role":"No name","comment":null}}]}}', chr(10), '```') END AS text
FROM r
""".replace("TITLE_TEXT", TITLE)

SPEED = """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN page_id % 7 < 2 THEN CAST(NULL AS STRING) ELSE concat(
    '{{"lighthouseResult":{{"categories":{{"performance":{{"score":',
    CASE page_id % 6 WHEN 0 THEN '0.905' WHEN 1 THEN '0.5' WHEN 2 THEN '0.49' WHEN 3 THEN 'null' WHEN 4 THEN '1' ELSE concat('0.', CAST(10 + page_id % 90 AS STRING)) END,
    '}}}},"audits":{{',
    CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('"largest-contentful-paint":{{"displayValue":"', CASE WHEN page_id % 5 = 1 THEN '' ELSE concat(CAST(page_id % 9 AS STRING), '.5 s') END, '","numericValue":', CASE WHEN page_id % 5 = 2 THEN '0' ELSE CAST(1000 + page_id % 5000 AS STRING) END, '.25}}') END,
    '}}}}}}') END AS body
FROM {pages}
"""

SPEED_ATTEMPTS = f"""
WITH s AS ({SPEED})
SELECT page_id, 0 AS attempt,
  CASE page_id % 9 WHEN 4 THEN 'timeout' WHEN 5 THEN 'network' ELSE 'http' END AS ended,
  CASE page_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 500 WHEN 3 THEN 404 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 200 END AS http,
  CASE WHEN page_id % 9 > 5 THEN body END AS body
FROM s
UNION ALL
SELECT page_id, 1, CASE page_id % 9 WHEN 1 THEN 'timeout' ELSE 'http' END,
  CASE page_id % 9 WHEN 1 THEN NULL WHEN 2 THEN 502 ELSE 200 END, body
FROM s WHERE page_id % 9 < 5
"""

LEADS = """
WITH c AS (SELECT *, CASE WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS k FROM {customer})
SELECT c_custkey AS lead_id,
  concat('2024-01-', lpad(CAST(1 + k % 28 AS STRING), 2, '0'), 'T', lpad(CAST(k % 24 AS STRING), 2, '0'), ':00:00.000Z') AS received_at,
  CASE c_custkey % 17 WHEN 0 THEN CAST(NULL AS STRING) WHEN 2 THEN '' WHEN 3 THEN repeat(c_name, 8) ELSE c_name END AS name,
  CASE c_custkey % 13 WHEN 5 THEN CAST(NULL AS STRING) WHEN 6 THEN '' WHEN 2 THEN 'not an address' WHEN 3 THEN '  padded@x.example  ' WHEN 4 THEN concat(repeat('a', 210), '@x.example')
    ELSE concat('c', CAST(k AS STRING), '@x', CAST(c_nationkey AS STRING), '.example') END AS email,
  CASE c_custkey % 5 WHEN 0 THEN CAST(NULL AS STRING) ELSE concat('https://c', CAST(k AS STRING), '.example/') END AS url,
  CASE c_custkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN '' ELSE CAST(NULL AS STRING) END AS tier,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment ELSE CAST(NULL AS STRING) END AS business,
  repeat(concat(c_mktsegment, ' works. '), CAST(c_custkey % 150 AS INT)) AS works,
  CASE c_custkey % 4 WHEN 0 THEN CAST(NULL AS STRING) ELSE repeat('broken ', CAST(c_custkey % 200 AS INT)) END AS broken,
  concat('$', CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING), repeat('0', CAST(c_custkey % 80 AS INT))) AS budget,
  CASE c_custkey % 6 WHEN 0 THEN '{{"grade":"B","pct":83}}' WHEN 1 THEN 'C' WHEN 2 THEN CAST(NULL AS STRING) WHEN 3 THEN '{{"pct":50}}' WHEN 4 THEN '' ELSE '{{"pct":91,"grade":"A"}}' END AS score,
  CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN CAST(NULL AS BOOLEAN) ELSE false END AS mockup
FROM c
"""

# forms as posted: bots, odd values of every field, unreadable texts
INTAKE_POSTS = """
SELECT submission_id, CASE submission_id % 23 WHEN 0 THEN '{{"business":"x"' WHEN 1 THEN 'null' WHEN 2 THEN '[1,2]'
    WHEN 3 THEN '{{}} {{}}' WHEN 4 THEN '' WHEN 5 THEN '{{}}'
    ELSE concat('{{"business":', business, ',"hp":', hp, ',"sections":', sections, '}}') END AS body
FROM (
  SELECT c_custkey AS submission_id,
    CASE c_custkey % 7 WHEN 0 THEN 'null' WHEN 1 THEN '"  "' WHEN 2 THEN '42' WHEN 3 THEN '["A","B"]'
      ELSE concat('" ', c_name, ' & Sons "') END AS business,
    CASE c_custkey % 19 WHEN 0 THEN '"http://bot.example"' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN 'null'
      WHEN 4 THEN '[]' WHEN 5 THEN '0' ELSE '""' END AS hp,
    CASE c_custkey % 11 WHEN 0 THEN '[]' WHEN 1 THEN 'null' WHEN 2 THEN '"none"' WHEN 3 THEN '[{{"name":"Bare"}},5]'
      WHEN 4 THEN '[null]' WHEN 5 THEN '[{{"name":"Odd","items":{{"q":1}}}}]'
      WHEN 6 THEN '[{{"name":"Gap","items":[{{"q":"x","v":"y"}},null]}}]'
      ELSE concat('[{{"name":"The business","items":[{{"q":"Phone","v":"', c_name, '"}},{{"q":"Key","v":',
        CAST(c_custkey AS STRING), '}}]}},{{"name":"Wishes","items":[{{"q":"Ship ', c_mktsegment,
        '?","v":["Call","Order online"]}},{{"q":"Open","v":true}},{{"v":"no question"}},7,{{"q":"Hours","v":{{"mon":[9,"17"]}}}}]}},{{"items":false}}]')
    END AS sections
  FROM {customer}
) AS made
"""

INTAKE_FORMS = """
SELECT c_custkey AS submission_id,
  CASE c_custkey % 9 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN concat('  ', c_name, ' & Sons  ') WHEN 4 THEN repeat(concat(c_name, ' '), 9) ELSE c_name END AS business,
  CASE c_custkey % 19 WHEN 0 THEN 'http://bot.example' WHEN 1 THEN CAST(NULL AS STRING) ELSE '' END AS hp,
  CASE WHEN c_custkey % 23 = 0 THEN '' ELSE concat(CAST(c_nationkey AS STRING), ' Main St') END AS address,
  CASE WHEN c_custkey % 23 = 0 OR c_custkey % 2 = 0 THEN '  ' ELSE concat('555-', CAST(c_custkey AS STRING)) END AS phone,
  CASE c_custkey % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' ELSE 'Not sure' END AS profile,
  CASE WHEN c_custkey % 23 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN 'Home' WHEN c_custkey % 3 = 1 THEN 'Home|Menu|FAQ' ELSE '' END AS pages_picked,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat(' Do you ship to ', c_mktsegment, '? ') END AS faq_q1,
  CASE WHEN c_custkey % 2 = 0 THEN ' Yes ' ELSE '' END AS faq_a1,
  CASE WHEN c_custkey % 7 = 0 THEN 'Open on Sunday?' ELSE '' END AS faq_q2,
  'Only by appointment' AS faq_a2,
  CASE c_custkey % 6 WHEN 0 THEN 'Call|Get found in search' WHEN 1 THEN 'Order online' ELSE '' END AS goals_picked,
  CASE WHEN c_custkey % 11 = 0 THEN concat('Balance ', CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING)) ELSE '' END AS notes
FROM {customer}
"""

REQUEST_LOG = """
SELECT event_id, CAST(user_id AS STRING) AS ip,
  CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(NULL AS STRING) ELSE concat('City', CAST(user_id AS STRING)) END AS city,
  CASE event_id % 3 WHEN 0 THEN 'Region' ELSE '' END AS region,
  CASE event_id % 5 WHEN 0 THEN CAST(NULL AS STRING) ELSE 'US' END AS country,
  CASE event_id % 6 WHEN 0 THEN CAST(NULL AS STRING) ELSE concat('Net ', event_type) END AS org,
  repeat(concat('https://ref.example/', props), CAST(event_id % 25 AS INT)) AS src,
  concat('Agent ', repeat(event_type, CAST(event_id % 40 AS INT))) AS ua,
  CASE event_id % 7 WHEN 0 THEN 'https://Tool.example' WHEN 1 THEN 'https://tool.example:443' WHEN 2 THEN 'http://tool.example:8080' WHEN 3 THEN 'https://evil.example' WHEN 4 THEN 'null' WHEN 5 THEN CAST(NULL AS STRING) ELSE 'https://tool.example' END AS origin,
  CASE WHEN event_id % 7 = 2 AND event_id % 2 = 0 THEN 'tool.example:8080' ELSE 'tool.example' END AS host,
  CASE event_id % 13 WHEN 0 THEN true WHEN 1 THEN CAST(NULL AS BOOLEAN) ELSE false END AS bypass
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name)})


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with markup, laid out as a page store."""
    # some of the pages repeat a key in their JSON-LD, which is no error to a browser
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def build() -> DataFrame:
        made = spark.sql(SITE_PAGES, pages=usable_pages(table(spark, sf_dir, "pages")))
        return stored_pages(made, PAGE_BUCKETS)

    return kept_once(spark, sf_dir, "site-pages", build)


def odd_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ODD_URLS, "pages")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, RESPONSES, "pages")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REPORTS, "pages")


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, PANELS, "pages")


def speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SPEED, "pages")


def speed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, SPEED_ATTEMPTS, "pages")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, LEADS, "customer")


def intake_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, INTAKE_FORMS, "customer")


def intake_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, INTAKE_POSTS, "customer")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, REQUEST_LOG, "events")


# derived tables that were stored, by application, source folder and name
STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per application as if it had been given."""
    return kept_once(spark, sf_dir, name, lambda: materialize(build(), name))


def kept_once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in STORED:
        STORED[key] = write()
    return STORED[key]


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with their number inside the site; no html."""

    def build() -> DataFrame:
        index = page_index(table(spark, sf_dir, "pages"))
        return number_within(index, ["site_key"], "page_id", "page_no")

    return stored(spark, sf_dir, "numbered", build)


def navigation(numbered: DataFrame) -> DataFrame:
    """(page_id, menu): menu fragment per page, linking page n of a site to its pages 2n and 2n+1."""
    child = numbered.select(
        "site_key",
        F.floor(F.col("page_no") / 2).alias("page_no"),
        (F.col("page_no") % 2).alias("side"),
        F.col("url").alias("child_url"),
    ).filter("page_no > 0")
    parent = numbered.select("site_key", "page_no", "page_id", "url")
    linked = parent.join(child, ["site_key", "page_no"])

    def anchor(side: int):
        return F.max(
            F.when(
                F.col("side") == side,
                F.concat(F.lit('<a href="'), "child_url", F.lit('">c</a>')),
            )
        )

    menus = linked.groupBy("page_id").agg(anchor(0).alias("first"), anchor(1).alias("second"))
    return menus.select(
        "page_id", F.concat(F.coalesce("first", F.lit("")), F.coalesce("second", F.lit(""))).alias("menu")
    )


def linked_pages(spark: SparkSession, sf_dir: str, numbered: DataFrame) -> DataFrame:
    """Site pages with their menu at the end, laid out as a page store."""

    def build() -> DataFrame:
        menus = navigation(numbered).withColumnRenamed("page_id", "menu_page")
        pages = site_pages(spark, sf_dir)
        html = F.concat("html", F.coalesce("menu", F.lit("")))
        linked = pages.join(menus, F.col("page_id") == F.col("menu_page"), "left")
        return stored_pages(linked.select("page_id", "url", html.alias("html")), PAGE_BUCKETS)

    return kept_once(spark, sf_dir, "linked-pages", build)


def site_maps(spark: SparkSession, sf_dir: str, numbered: DataFrame) -> DataFrame:
    return stored(spark, sf_dir, "sitemaps", lambda: sitemaps(numbered))


def sitemaps(numbered: DataFrame) -> DataFrame:
    """Sitemap files of every site; every page of a site with sitemaps is in one of them.

    One file is one row, so its list is put together in one; sites past
    ``SITEMAP_PLAIN_PAGES`` pages have files of eight pages under an index.
    """
    sizes = numbered.groupBy("site_key").agg(F.count("*").alias("n_pages"))
    roots = numbered.filter("page_no = 1").select(
        "site_key", "origin", F.expr(SITE_NO.replace("host", "site_key")).alias("s")
    ).join(sizes, "site_key")
    indexed = (F.col("s") % 4 < 2) | ((F.col("s") % 4 == 2) & (F.col("n_pages") > SITEMAP_PLAIN_PAGES))
    chunk = F.floor((F.col("page_no") - 1) / SITEMAP_PAGES_PER_FILE)
    kind = F.element_at(F.array(*map(F.lit, ["misc", "post", "page", "product"])), (F.col("chunk") % 4 + 1).cast("int"))
    file_name = F.concat(F.lit("/sitemap-"), kind, F.lit("-"), F.col("chunk").cast("string"), F.lit(".xml"))

    def ordered(order: str, text) -> object:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order), text.alias("text"))))
        return F.array_join(F.transform(rows, lambda r: r["text"]), "")

    loc = F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>"))
    tags = "".join(f"<url><loc>https://tags.example.org/tag/{i}/</loc></url>" for i in range(8))
    extras = f"{tags}<url><loc>https://other.example.com/p</loc></url><url><loc>/a.png</loc></url>"
    chunks = (
        numbered.withColumn("chunk", chunk)
        .groupBy("site_key", "chunk")
        .agg(ordered("page_no", loc).alias("locs"))
    )
    files = chunks.join(roots, "site_key").filter(indexed)
    children = files.select(
        "origin", file_name.alias("path"),
        F.concat(F.lit("<?xml version='1.0'?><URLSET>"), "locs", F.lit(extras + "</URLSET>")).alias("xml"),
    )
    child_loc = F.concat(F.lit("<sitemap><loc>"), "origin", file_name, F.lit("</loc></sitemap>"))
    index = (
        files.groupBy("origin", "s")
        .agg(ordered("chunk", child_loc).alias("locs"))
        .select(
            "origin",
            F.when(F.col("s") % 4 == 0, F.lit("/sitemap_index.xml")).otherwise(F.lit("/wp-sitemap.xml")).alias("path"),
            F.concat(
                F.lit("<sitemapindex><loc>"), "origin", F.lit("/feed/</loc><loc>"), "origin",
                F.lit("/sitemap-page-lost.xml</loc>"), "locs", F.lit("</sitemapindex>"),
            ).alias("xml"),
        )
    )
    plain = (
        numbered.join(roots.filter((F.col("s") % 4 == 2) & ~indexed).select("site_key"), "site_key")
        .groupBy("site_key")
        .agg(ordered("page_no", loc).alias("locs"))
        .join(roots, "site_key")
        .select("origin", F.lit("/sitemap.xml").alias("path"), F.concat(F.lit("<urlset>"), "locs", F.lit(extras + "</urlset>")).alias("xml"))
    )
    # an answer that is no sitemap must be passed over
    wrong = roots.filter("s % 4 in (1, 3)").select(
        "origin", F.lit("/sitemap_index.xml").alias("path"), F.lit("<html>not found</html>").alias("xml")
    )
    return children.unionByName(index).unionByName(plain).unionByName(wrong)


def limiter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: kind = event type, ip = user."""
    from lodescan.operators.limits import micros

    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("kind"),
        F.col("user_id").cast("string").alias("ip"),
        micros(F.col("ts")).alias("ts"),
        "event_id",
    )


def guard_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the three guarded kinds, a thousand times denser, some without an ip."""
    return limiter_requests(spark, sf_dir).select(
        F.element_at(
            F.array(*map(F.lit, ["audit", "deep", "page"])), (F.col("event_id") % 3 + 1).cast("int")
        ).alias("kind"),
        F.expr("CASE WHEN event_id % 5 = 1 THEN NULL WHEN event_id % 5 = 2 THEN '' ELSE ip END").alias("ip"),
        F.expr("ts div 1000").alias("ts"),
        "event_id",
    )


def guard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the guarded kinds with the origin, host and bypass flag of the log."""
    marks = request_log(spark, sf_dir).select("event_id", "origin", "host", "bypass")
    return guard_requests(spark, sf_dir).join(marks, "event_id")


def request_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the limiter's requests in several files, in the order of time."""
    return files_in_order(["ts", "event_id"], limiter_requests(spark, sf_dir))


# rows of a file that a stream takes as one micro-batch, at most
ROWS_PER_FILE = 4_000_000


def files_in_order(order: list[str], *frames: DataFrame) -> str:
    """Write rows as files by ranges of ``order``, which a stream takes one after the other.

    A file source reads by modification time, so the files get times in the order of their
    names; those of a frame come after those of the frame before. The first one has four files
    at least. Returns the pattern of their folders.
    """
    spark = frames[0].sparkSession
    folder = new_folder(spark, "stream-files")
    for number, rows in enumerate(frames):
        parts = max(1 if number else 4, -(-rows.count() // ROWS_PER_FILE))
        rows.repartitionByRange(parts, *order).write.parquet(f"{folder}/{number}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f.getPath() for f in store.globStatus(path(f"{folder}/*/part-*"))]
    for number, file in enumerate(sorted(files, key=lambda f: (f.getParent().getName(), f.getName()))):
        store.setTimes(file, 1_700_000_000_000 + 1_000 * number, -1)
    return f"{folder}/*"


def delayed_requests(spark: SparkSession, sf_dir: str, delay_ms: int) -> str:
    """Files of the guarded requests as they arrive, out of order.

    Requests arrive less than ``delay_ms`` after their time, but for one in 31: those, if older
    than three delays, come after all others. A heartbeat at the end moves the watermark past
    the last request.
    """
    delay = delay_ms * 1000
    requests = guard_requests(spark, sf_dir)
    last = requests.agg(F.max("ts")).first()[0]
    late = (F.col("event_id") % 31 == 7) & (F.col("ts") < last - 3 * delay)
    arriving = requests.withColumn(
        "arrival", F.col("ts") + F.pmod(F.col("event_id") * 7_919, F.lit(delay - 1_000))
    )
    beat = arriving.limit(1).select(
        F.lit("audit").alias("kind"), F.lit("").alias("ip"), F.lit(last + 2 * delay).alias("ts"),
        F.lit(None).cast("bigint").alias("event_id"), "arrival",
    )
    return files_in_order(["arrival", "event_id"], arriving.filter(~late), arriving.filter(late), beat)
