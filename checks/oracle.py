"""DuckDB SQL twins of the registered queries, over the whole tables.

Written on their own: own patterns (RE2), own windows, recursive CTEs for the crawl and
the sliding window.
"""

from __future__ import annotations

from checks import inputs as I

AS_OF_YEAR = 2026
WINDOW = 3 * 86_400_000_000
SOFT, DAILY = 2, 1


def derived(sql: str) -> str:
    return sql.format(pages="pages", customer="customer", events="events")


def with_tables(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


# --- expression templates -----------------------------------------------------------


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^https?://([^/:?#]+)', 1, 'i'))"


def site(u: str) -> str:
    return f"regexp_replace({host(u)}, '^www[.]', '')"


def origin(u: str) -> str:
    return f"lower(regexp_extract({u}, '^https?://[^/?#]+', 0, 'i'))"


def path(u: str) -> str:
    raw = f"regexp_extract({u}, '^https?://[^/?#]+(/[^?#]*)', 1, 'i')"
    return (
        f"CASE WHEN {raw} = '' THEN '/' ELSE array_to_string(list_transform("
        rf"regexp_extract_all({raw}, '[^\x00-\x7F]+|[\x00-\x7F]+'), "
        r"lambda r: CASE WHEN regexp_matches(r, '[^\x00-\x7F]') THEN url_encode(r) ELSE r END), '') END"
    )


def key(u: str) -> str:
    stripped = f"lower(regexp_replace({path(u)}, '/+$', ''))"
    return f"{site(u)} || CASE WHEN {stripped} = '' THEN '/' ELSE {stripped} END"


def asset(p: str) -> str:
    return (
        f"regexp_matches({p}, '[.](png|jpe?g|gif|webp|svg|css|js|pdf|zip|mp4|woff2?|ico)([?]|$)', 'i')"
    )


def low_value(p: str) -> str:
    return f"regexp_matches({p}, '/(tag|category|author|feed)/', 'i')"


def text_of(h: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        rf"{h}, '<script[\s\S]*?</script>', ' ', 'gi'), '<style[\s\S]*?</style>', ' ', 'gi'), "
        r"'<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
    )


def title_of(h: str) -> str:
    return rf"regexp_replace(regexp_extract({h}, '<title[^>]*>([\s\S]*?)</title>', 1, 'i'), '^\s+|\s+$', '', 'g')"


def has(h: str, pattern: str, flags: str = "i") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({h}, '{quoted}', '{flags}')"


def matches(h: str, pattern: str, group: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all({h}, '{quoted}', {group}, 'i')"


def count_of(h: str, pattern: str) -> str:
    return f"CAST(len({matches(h, pattern)}) AS INT)"


META = """<meta[^>]+name=["']description["'][^>]+content=["'][^"']{20,}"""
IMG = r"<img\b[^>]*>"
LD = r"<script[^>]*application/ld\+json[^>]*>([\s\S]*?)</script>"
ANCHOR = r"""<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)["']"""
COMMERCE = r"woocommerce|cdn[.]shopify|snipcart|bigcommerce|squarespace-commerce|ecwid"
RETAIL = (
    r"\b(boutique|clothing|apparel|shop|store|gifts?|jewelry|goods|merchandise|prints?"
    r"|gallery|outfitter|supply)\b"
)
GEO = r'"geo"\s*:|GeoCoordinates'
FAQPAGE = r'"@type"\s*:\s*"FAQPage"'
NOINDEX = r"""<meta[^>]+name=["']robots["'][^>]*noindex"""
CANONICAL = r"""<link[^>]+rel=["']canonical["']"""
PROPS = {
    "award": ('"award"\\s*:', "c"),
    "openingHours": ('openingHoursSpecification|"openingHours"\\s*:', "i"),
    "telephone": ('"telephone"\\s*:', "c"),
    "priceRange": ('"priceRange"\\s*:', "c"),
    "servesCuisine": ('"servesCuisine"\\s*:', "c"),
    "sameAs": ('"sameAs"\\s*:', "c"),
}
ALT = rf"CAST(len(list_filter({matches('html', IMG)}, lambda t: regexp_matches(t, '\balt\s*=', 'i'))) AS INT)"
PLATFORM = (
    f"CASE WHEN {has('html', 'wp-content')} THEN 'WordPress' WHEN {has('html', 'cdn[.]shopify')} THEN 'Shopify' "
    f"WHEN {has('html', 'wix[.]com|_wixcss')} THEN 'Wix' WHEN {has('html', 'squarespace')} THEN 'Squarespace' ELSE 'unknown' END"
)
EVIDENCE = (
    f"""{count_of('html', '"@type"\\s*:\\s*"product"')} + {count_of('html', 'add[-_ ]to[-_ ]cart')}"""
    f" + least({count_of('html', '/product/|/products/|/shop/[a-z0-9-]+')}, 5)"
)
QUESTIONS = (
    rf"CAST(len(list_filter({matches('html', '<h[2-4][^>]*>([\\s\\S]*?)</h[2-4]>', 1)}, "
    r"lambda h: ends_with(trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '?'))) AS INT)"
)
FORM = r"<form\b"
FIELD = r"<(input|textarea|select)\b"
YEAR_OF = "list_max(list_transform(list_filter(regexp_extract_all(t, '[0-9.$]+'), lambda r: regexp_matches(r, '^20[12][0-9]([$]|$)')), lambda r: CAST(left(r, 4) AS INT)))"
TYPES_CI = matches("html", r'"@type"\s*:\s*"([^"]+)"', 1)

# --- shared tables ---------------------------------------------------------------------

SITE_PAGES = f"site_pages AS ({derived(I.SITE_PAGES)})"
def distinct(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


# every @type of the valid blocks: scalars, and elements of arrays
TYPE_ROWS = f"""blocks AS (
  SELECT page_id, n, trim(b) AS b FROM (SELECT page_id, unnest({matches('html', LD, 1)}) AS b, unnest(range(len({matches('html', LD, 1)}))) AS n FROM site_pages)
), valid AS MATERIALIZED (SELECT page_id, n, CAST(b AS JSON) AS j FROM blocks WHERE CASE WHEN json_valid(b) THEN true ELSE false END),
nodes AS (
  SELECT page_id, t.key AS k, t.type AS ty, t.atom AS atom, t.path AS p FROM valid, json_tree(valid.j) AS t
  QUALIFY t.key IS NULL OR t.id = max(t.id) OVER (PARTITION BY page_id, n, t.parent, t.key)
),
type_rows AS (
  SELECT DISTINCT page_id, json_extract_string(atom, '$') AS ty FROM nodes
  WHERE ty = 'VARCHAR' AND ((k = '@type' AND json_extract_string(atom, '$') <> '') OR ends_with(p, '"@type"'))
)"""

SIGNALS = f"""sig AS (
  SELECT c.* EXCLUDE (url), {path('c.url')} AS path, len({matches('html', LD, 1)}) > 0 AS has_block, {has('html', META)} AS meta,
    {has('html', 'breadcrumb')} AS breadcrumb, {has('html', COMMERCE)} AS commerce, {EVIDENCE} AS evidence,
    {has('html', GEO)} AS geo, {has('html', FAQPAGE)} AS faqpage,
    {', '.join(f"{has('html', p, f)} AS prop_{n}" for n, (p, f) in PROPS.items())},
    {QUESTIONS} AS questions, {has('html', FORM)} AND {count_of('html', FIELD)} >= 2 AS form_page,
    {has('html', "href=[\"']mailto:")} AS mailto, {has('html', "href=[\"']tel:")} AS tel, {has('html', NOINDEX)} AS noindex,
    {text_of('html')} AS t, {count_of('html', IMG)} AS images, {ALT} AS images_with_alt,
    {has('html', "name=[\"']viewport[\"']")} AS viewport, {has('html', "property=[\"']og:")} AS og,
    {has('html', CANONICAL)} AS canonical, {title_of('html')} AS title, {PLATFORM} AS platform, {has('html', RETAIL)} AS retail
  FROM site_pages JOIN crawl c USING (page_id)
), site_types AS (
  SELECT site_key, list_sort(list(DISTINCT ty)) AS schema_types FROM type_rows JOIN crawl USING (page_id) GROUP BY site_key
), rolled AS (
  SELECT site_key, count(*) AS page_count, count_if(has_block) AS pages_with_schema, count_if(meta) AS pages_with_meta,
    count_if(form_page) AS form_pages, bool_or(breadcrumb) AS has_breadcrumb, bool_or(commerce) AS commerce_platform,
    bool_or(geo) AS has_geo, bool_or(mailto) AS has_mailto, bool_or(tel) AS has_tel, bool_or(noindex) AS has_noindex,
    {', '.join(f'bool_or(prop_{n}) AS prop_{n}' for n in PROPS)},
    CAST(sum(evidence) AS BIGINT) AS product_evidence, CAST(sum(questions) AS BIGINT) AS question_headings,
    max({YEAR_OF}) AS newest_year,
    coalesce(list(path ORDER BY crawl_rank) FILTER (WHERE faqpage), []) AS faq_pages,
    coalesce(list(path ORDER BY crawl_rank) FILTER (WHERE questions > 0), []) AS question_heading_pages,
    {', '.join(f"max(CASE WHEN crawl_rank = 1 THEN {e} END) AS {n}" for n, e in [
        ('origin', 'origin'), ('home_img_count', 'images'), ('home_img_with_alt', 'images_with_alt'),
        ('home_title', 'title'), ('platform', 'platform')])},
    {', '.join(f"bool_or(crawl_rank = 1 AND {e}) AS {n}" for n, e in [
        ('has_viewport', 'viewport'), ('has_og', 'og'), ('home_canonical', 'canonical'), ('retail_hint', 'retail')])}
  FROM sig GROUP BY site_key
)"""

LOCAL_NAMES = (
    "LocalBusiness|Restaurant|FoodEstablishment|Cafe|Bar|Bakery|Brewery|Winery|Distillery|Store|Shop|Hotel|Motel"
    "|Lodging|Resort|BedAndBreakfast|Spa|BeautySalon|HairSalon|NailSalon|HealthAndBeauty|MedicalBusiness|Dentist|Physician|Hospital"
    "|VeterinaryCare|ProfessionalService|LegalService|Attorney|Notary|FinancialService|InsuranceAgency"
    "|AccountingService|RealEstateAgent|AutomotiveBusiness|AutoRepair|HomeAndConstructionBusiness|GeneralContractor"
    "|Plumber|Electrician|RoofingContractor|Locksmith|MovingCompany|TravelAgency|TouristAttraction|Aquarium|Zoo"
    "|Museum|ArtGallery|AmusementPark|Campground|EventVenue|PerformingArtsTheater|Place"
)


def any_type(pattern: str) -> str:
    return f"len(list_filter(schema_types, lambda x: regexp_matches(x, '{pattern}', 'i'))) > 0"


NAMES = [*PROPS, "menuMarkup"]


def property_list(wanted: str) -> str:
    items = ", ".join(f"CASE WHEN {wanted} prop_{n} THEN '{n}' END" for n in NAMES)
    return f"coalesce(nullif(array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ', '), ''), 'none')"


AUDIT = f"""sites AS (
  SELECT r.*, coalesce(t.schema_types, []) AS schema_types, CAST(coalesce(m.sitemap_total, 0) AS BIGINT) AS sitemap_total
  FROM rolled r LEFT JOIN site_types t USING (site_key) LEFT JOIN sitemap_totals m USING (origin)
), flags AS (
  SELECT *, {any_type('FAQPage|Question')} AS has_faq_schema, {any_type(LOCAL_NAMES)} AS has_local_business,
    {any_type('Organization')} AS has_organization, {any_type('^Menu$')} AS prop_menuMarkup,
    CASE WHEN product_evidence >= 4 THEN 'store' WHEN commerce_platform THEN 'installed_empty' ELSE 'none' END AS commerce_state,
    starts_with(origin, 'https') AS is_https, coalesce(newest_year <= {AS_OF_YEAR - 2}, false) AS looks_stale,
    greatest(page_count, sitemap_total) AS site_size, page_count >= 12 AS crawl_capped FROM sites
), signals AS (
  SELECT *, has_local_business AND has_geo AS complete_local_entity, (has_local_business AND has_geo) OR has_organization AS has_entity_graph,
    commerce_state = 'store' AS has_store, {property_list('')} AS properties_found, {property_list('NOT')} AS properties_missing,
    length(home_title) >= 15 AND NOT regexp_matches(home_title, '^home$|^untitled', 'i') AS good_title,
    CASE WHEN home_img_count = 0 THEN 1.0::DOUBLE ELSE home_img_with_alt::DOUBLE / home_img_count END AS alt_share
  FROM flags
), totals AS (
  SELECT *, CASE WHEN has_organization THEN 8 ELSE 0 END + CASE WHEN complete_local_entity THEN 10 ELSE 0 END
    + CASE WHEN has_faq_schema THEN 16 ELSE 0 END + CASE WHEN question_headings >= 3 THEN 10 WHEN question_headings >= 1 THEN 5 ELSE 0 END
    + CASE WHEN pages_with_schema > 0 AND len(schema_types) >= 3 THEN 6 ELSE 0 END
    + CASE WHEN pages_with_meta >= page_count * 0.8::DOUBLE THEN 8 WHEN pages_with_meta > 0 THEN 4 ELSE 0 END
    + CASE WHEN good_title THEN 6 ELSE 0 END + CASE WHEN has_breadcrumb THEN 6 ELSE 0 END + CASE WHEN alt_share >= 0.8::DOUBLE THEN 8 ELSE 0 END
    + CASE WHEN is_https THEN 5 ELSE 0 END + CASE WHEN has_viewport THEN 5 ELSE 0 END + CASE WHEN has_og THEN 4 ELSE 0 END
    + CASE WHEN looks_stale THEN 0 ELSE 5 END + CASE commerce_state WHEN 'installed_empty' THEN -8 WHEN 'store' THEN 3 ELSE 0 END AS raw,
    least(100, greatest(0, CASE WHEN pages_with_schema > 0 THEN 18 ELSE 0 END + CASE WHEN has_organization THEN 16 ELSE 0 END
    + CASE WHEN has_faq_schema THEN 30 ELSE 0 END + CASE WHEN question_headings >= 3 THEN 18 WHEN question_headings >= 1 THEN 9 ELSE 0 END
    + CASE WHEN len(schema_types) >= 3 THEN 18 ELSE 0 END)) AS answer,
    CAST(least(100, greatest(0, floor(pages_with_meta::DOUBLE / greatest(1, page_count) * 30 + CASE WHEN good_title THEN 22 ELSE 0 END + alt_share * 18
    + CASE WHEN has_breadcrumb THEN 14 ELSE 0 END + CASE WHEN is_https THEN 8 ELSE 0 END + CASE WHEN has_viewport THEN 8 ELSE 0 END + 0.5::DOUBLE))) AS INT) AS organic,
    least(100, greatest(0, CASE WHEN complete_local_entity THEN 45 WHEN has_local_business THEN 20 ELSE 0 END + CASE WHEN has_organization THEN 18 ELSE 0 END
    + CASE WHEN has_og THEN 12 ELSE 0 END + CASE WHEN has_breadcrumb THEN 8 ELSE 0 END + CASE WHEN looks_stale THEN 0 ELSE 12 END)) AS "local"
  FROM signals
), scored AS (
  SELECT *, greatest(8, least(94, CASE WHEN has_entity_graph THEN raw ELSE least(raw, 79) END)) AS pct,
    CASE WHEN has_store THEN 'large' WHEN site_size <= 6 THEN 'small' WHEN site_size <= 19 THEN 'medium' WHEN site_size <= 49 THEN 'large' ELSE 'enterprise' END AS tier
  FROM totals
), audit AS (
  SELECT *, CASE WHEN pct >= 90 THEN 'A' WHEN pct >= 80 THEN 'B' WHEN pct >= 70 THEN 'C' WHEN pct >= 60 THEN 'D' ELSE 'F' END AS grade,
    CASE tier WHEN 'small' THEN 2000 WHEN 'medium' THEN 5000 WHEN 'large' THEN 9500 END AS quote_total,
    CASE tier WHEN 'small' THEN 1000 WHEN 'medium' THEN 1500 WHEN 'large' THEN 2500 END AS first_price
  FROM scored
)"""

QUOTE_NAME = (
    "CASE tier WHEN 'small' THEN 'Small site' WHEN 'medium' THEN 'Medium site' "
    "WHEN 'large' THEN 'Large / e-commerce site' ELSE 'Enterprise / institutional' END"
)

# --- sitemaps -------------------------------------------------------------------------------

KIND = "['misc', 'post', 'page', 'product'][CAST(chunk % 4 + 1 AS INT)]"
FILE_NAME = f"'/sitemap-' || {KIND} || '-' || CAST(chunk AS VARCHAR) || '.xml'"
TAG_LOCS = "".join(f"<url><loc>https://tags.example.org/tag/{i}/</loc></url>" for i in range(8))
EXTRA_LOCS = TAG_LOCS + "<url><loc>https://other.example.com/p</loc></url><url><loc>/a.png</loc></url>"
SITEMAPS = f"""num AS (
  SELECT page_id, url, {site('url')} AS site_key, {origin('url')} AS origin, row_number() OVER (PARTITION BY {site('url')} ORDER BY page_id) AS page_no FROM pages
), roots AS (
  SELECT *, s % 4 < 2 OR (s % 4 = 2 AND n_pages > {I.SITEMAP_PLAIN_PAGES}) AS indexed FROM (
    SELECT site_key, origin, {key('url')} AS root_key, url AS root_url, {I.SITE_NO.replace('host', 'site_key')} AS s FROM num WHERE page_no = 1)
  JOIN (SELECT site_key, count(*) AS n_pages FROM num GROUP BY site_key) USING (site_key)
), chunks AS (
  SELECT site_key, (page_no - 1) // {I.SITEMAP_PAGES_PER_FILE} AS chunk, string_agg('<url><loc> ' || url || ' </loc></url>', '' ORDER BY page_no) AS locs FROM num GROUP BY ALL
), sitemaps AS (
  SELECT r.origin, {FILE_NAME} AS path, '<?xml version=''1.0''?><URLSET>' || locs || '{EXTRA_LOCS}</URLSET>' AS xml FROM chunks JOIN roots r USING (site_key) WHERE indexed
  UNION ALL
  SELECT r.origin, CASE WHEN any_value(s) % 4 = 0 THEN '/sitemap_index.xml' ELSE '/wp-sitemap.xml' END,
    '<sitemapindex><loc>' || r.origin || '/feed/</loc><loc>' || r.origin || '/sitemap-page-lost.xml</loc>'
    || string_agg('<sitemap><loc>' || r.origin || {FILE_NAME} || '</loc></sitemap>', '' ORDER BY chunk) || '</sitemapindex>'
  FROM chunks JOIN roots r USING (site_key) WHERE indexed GROUP BY r.origin
  UNION ALL
  SELECT r.origin, '/sitemap.xml', '<urlset>' || string_agg('<url><loc> ' || url || ' </loc></url>', '' ORDER BY page_no) || '{EXTRA_LOCS}</urlset>'
  FROM num JOIN roots r USING (site_key) WHERE s % 4 = 2 AND NOT indexed GROUP BY r.origin
  UNION ALL
  SELECT origin, '/sitemap_index.xml', '<html>not found</html>' FROM roots WHERE s % 4 IN (1, 3)
), chosen AS (
  SELECT * FROM (SELECT origin, path, xml, regexp_matches(xml, '<sitemapindex', 'i') AS is_index,
    regexp_extract_all(xml, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1, 'i') AS locs,
    row_number() OVER (PARTITION BY origin ORDER BY CASE path WHEN '/sitemap_index.xml' THEN 0 WHEN '/wp-sitemap.xml' THEN 1 ELSE 2 END) AS nth
    FROM sitemaps WHERE path IN ('/sitemap_index.xml', '/wp-sitemap.xml', '/sitemap.xml') AND regexp_matches(xml, '<(urlset|sitemapindex)', 'i'))
  WHERE nth = 1
), entries AS (SELECT origin, unnest(locs) AS child_url, unnest(range(len(locs))) AS pos FROM chosen WHERE is_index),
children AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY kind_rank, pos) - 1 AS file_no FROM (
    SELECT *, CASE WHEN contains(lower(child_url), 'page') THEN 0 WHEN contains(lower(child_url), 'post') THEN 1 WHEN contains(lower(child_url), 'product') THEN 2 ELSE 5 END AS kind_rank
    FROM entries WHERE regexp_matches(child_url, '[.]xml', 'i'))) WHERE file_no < 4
), read AS (
  SELECT c.origin, c.file_no, c.child_url, regexp_extract_all(s.xml, '<loc>\\s*([^<\\s]+)\\s*</loc>', 1, 'i') AS locs
  FROM children c JOIN sitemaps s ON s.origin || s.path = c.child_url
), cut AS (
  SELECT * FROM (SELECT *, CAST(coalesce(sum(len(locs)) OVER (PARTITION BY origin ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM read) WHERE before <= 50
), sitemap_urls AS (
  SELECT origin, 0 AS file_no, unnest(locs) AS loc, unnest(range(len(locs))) AS pos FROM chosen WHERE NOT is_index
  UNION ALL SELECT origin, file_no, unnest(locs), unnest(range(len(locs))) FROM cut
), seeds AS (
  SELECT origin, file_no, pos, {key('loc')} AS k, loc FROM sitemap_urls
  WHERE regexp_matches(loc, '^https?://', 'i') AND {site('loc')} = {site('origin')} AND NOT {asset(path('loc'))}
), sitemap_totals AS (
  SELECT origin, count_if(NOT (regexp_matches(loc, '^https?://') AND {low_value(path('loc'))})) AS sitemap_total FROM sitemap_urls GROUP BY origin
)"""


def crawl(cap: int, per_page: int | None, sitemap: bool = True) -> str:
    """First-in-first-out crawl of each site, one queue entry per recursion step.

    An entry is a page key and the address it was queued by; the links of a page are resolved
    against that address.
    """
    budget = f"[1:{per_page}]" if per_page else ""
    first = "[{'k': r.root_key, 'a': r.root_url}]"
    queue = f"{first} || coalesce(q.seeds, [])" if sitemap else first
    followed = (
        f"list_transform(list_filter(list_transform(h, lambda x: {resolve('x', 'a')}), "
        f"lambda y: regexp_matches(y, '^https?://', 'i') AND {origin('y')} = origin AND NOT {asset(path('y'))}), "
        f"lambda z: {{{{'k': {key('z')}, 'a': z}}}})"
    ).replace("{{", "{").replace("}}", "}")
    return f"""kids AS (
  SELECT p.page_id, string_agg('<a href="' || c.url || '">c</a>', '' ORDER BY c.page_no) AS menu
  FROM num p JOIN num c ON p.site_key = c.site_key AND c.page_no IN (2 * p.page_no, 2 * p.page_no + 1) GROUP BY p.page_id
), linked AS (SELECT s.page_id, s.url, s.html || coalesce(k.menu, '') AS html FROM site_pages s LEFT JOIN kids k USING (page_id)),
idx AS MATERIALIZED (
  SELECT k, first.page_id AS page_id, {matches('first.html', ANCHOR, 1)}{budget} AS h
  FROM (SELECT {key('url')} AS k, min_by({{'page_id': page_id, 'html': html}}, page_id) AS first FROM linked GROUP BY 1)
),
start AS (SELECT origin, list({{'k': k, 'a': loc}} ORDER BY file_no, pos) AS seeds FROM seeds GROUP BY origin),
walk AS (
  SELECT r.site_key, r.origin, {queue} AS queue, CAST([] AS VARCHAR[]) AS seen,
    list_filter([{{'p': 0::BIGINT, 'a': ''}}], lambda x: x.p > 0) AS found FROM roots r LEFT JOIN start q USING (origin)
  UNION ALL
  SELECT site_key, origin,
    queue[2:] || CASE WHEN fresh AND page IS NOT NULL AND len(found) + 1 < {cap} THEN list_filter({followed}, lambda n: NOT list_contains(seen, n.k)) ELSE [] END,
    CASE WHEN fresh THEN list_append(seen, queue[1].k) ELSE seen END,
    CASE WHEN fresh AND page IS NOT NULL THEN list_append(found, {{'p': page, 'a': a}}) ELSE found END
  FROM (SELECT w.*, w.queue[1].a AS a, NOT list_contains(w.seen, w.queue[1].k) AS fresh, i.page_id AS page, coalesce(i.h, []) AS h
    FROM walk w LEFT JOIN idx i ON i.k = w.queue[1].k
    WHERE len(w.queue) > 0 AND len(w.found) < {cap})
), crawl AS MATERIALIZED (
  SELECT site_key, origin, f.p AS page_id, f.a AS url, crawl_rank FROM (
    SELECT site_key, origin, unnest(found) AS f, unnest(range(1, len(found) + 1)) AS crawl_rank
    FROM walk WHERE len(queue) = 0 OR len(found) >= {cap})
)"""


def resolve(h: str, base: str) -> str:
    """Link forms that occur in the derived pages."""
    folder = f"regexp_extract({path(base)}, '^.*/')"
    return (
        f"CASE WHEN regexp_matches({h}, '^https?://', 'i') THEN CASE WHEN regexp_matches({h}, '^https?://[^/?#]+$', 'i') THEN {h} || '/' ELSE {h} END "
        f"WHEN regexp_matches({h}, '^[a-z]+:', 'i') THEN {h} WHEN starts_with({h}, '//') THEN regexp_extract({base}, '^https?:') || {h} "
        f"WHEN starts_with({h}, '/') THEN {origin(base)} || {path_text(h)} WHEN starts_with({h}, '?') THEN {origin(base)} || {path(base)} || {h} "
        f"ELSE {origin(base)} || {folder} || {path_text(h)} END"
    )


def path_text(p: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({p}, '[^\x00-\x7F]+|[\x00-\x7F]+'), "
        r"lambda r: CASE WHEN regexp_matches(r, '[^\x00-\x7F]') THEN url_encode(r) ELSE r END), '')"
    )


# --- replies -----------------------------------------------------------------------------------


CRAWLED = (SITE_PAGES, SITEMAPS, crawl(12, 80))
ROLLUP_TABLES = with_tables(*CRAWLED, TYPE_ROWS, SIGNALS, recursive=True)
AUDIT_TABLES = with_tables(*CRAWLED, TYPE_ROWS, SIGNALS, AUDIT, recursive=True)
DEEP_CRAWLED = (SITE_PAGES, SITEMAPS, crawl(15, None))


def unfence(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(trim({t}, chr(32) || chr(10)), '^```json\s*', '', 'i'), '```$', ''), chr(32) || chr(10))"


HEDGE = (
    r"\b(confirm|verify|likely|consider|probably|possibly|may |might |appears|seems|could be"
    r"|check (that|whether|if)|not verified)\b"
)
REPLIES = f"""responses AS ({derived(I.RESPONSES)}),
cleaned AS (SELECT page_id, text IS NOT NULL AS replied, {unfence('text')} AS c FROM responses),
parsed AS (SELECT page_id, replied, CASE WHEN json_valid(c) THEN CAST(c AS JSON) END AS j FROM cleaned)"""


def findings_rows(j: str, extra: str, source: str) -> str:
    """Findings with hedged ones demoted."""
    return f"""SELECT *, CASE WHEN f0 = 'high' AND regexp_matches(coalesce(title, '') || ' ' || coalesce(rec, ''), '{HEDGE}', 'i') THEN 'med' ELSE f0 END AS priority FROM (
  SELECT {extra}, CAST(pos AS INT) AS pos, json_extract_string(f, '$.priority') AS f0, json_extract_string(f, '$.title') AS title, json_extract_string(f, '$.rec') AS rec
  FROM (SELECT {extra}, unnest(CAST(json_extract({j}, '$.findings[*]') AS JSON[])) AS f, unnest(range(len(json_extract({j}, '$.findings[*]')))) AS pos FROM {source}))"""


CRAWL_15 = f"""results AS (
  SELECT c.*, coalesce(json_extract_string(p.j, '$.role'), '') AS role, p.j FROM crawl c LEFT JOIN parsed p USING (page_id)
  WHERE p.page_id IS NULL OR NOT p.replied OR p.j IS NOT NULL
), found AS ({findings_rows('j', 'site_key, crawl_rank, page_id, url, role', 'results')})"""

LCP = "json_extract_string(j, '$.lighthouseResult.audits.\"largest-contentful-paint\".displayValue')"
LCP_MS = "CAST(json_extract(j, '$.lighthouseResult.audits.\"largest-contentful-paint\".numericValue') AS DOUBLE)"
SPEED = f"""speed AS ({derived(I.SPEED)}),
speed_json AS (SELECT page_id, status, CAST(body AS JSON) AS j FROM speed),
speed_raw AS (
  SELECT page_id, status = 'timeout' AS timed_out,
    CASE WHEN status = 'ok' AND json_extract(j, '$.lighthouseResult.categories.performance.score') <> 'null' THEN CAST(json_extract(j, '$.lighthouseResult.categories.performance.score') AS DOUBLE) END AS s,
    {LCP} AS l, {LCP_MS} AS ms FROM speed_json
), speed_read AS (
  SELECT page_id, timed_out, CASE WHEN timed_out THEN 20 ELSE CAST(floor(s * 100 + 0.5::DOUBLE) AS INT) END AS score,
    CASE WHEN s IS NOT NULL THEN nullif(l, '') END AS lcp, CASE WHEN s IS NOT NULL THEN nullif(ms, 0) END AS lcp_ms FROM speed_raw
)"""
LCP_CLAUSE = "coalesce(' Its largest element takes ' || lcp || ' to appear on mobile.', '')"
READ = f"""CASE WHEN score IS NULL THEN NULL
  WHEN timed_out THEN 'Slow — the page didn''t finish loading within 40 seconds on mobile, so Google''s speed test couldn''t complete. A page that can''t be measured in time is a page real visitors abandon; a modern rebuild loads near-instantly.'
  WHEN score >= 90 THEN 'Fast — the page loads quickly on mobile, so speed isn''t costing you visitors.' || {LCP_CLAUSE}
  WHEN score >= 50 THEN 'Middling — there''s real lag on mobile.' || {LCP_CLAUSE} || ' Faster pages hold more visitors and Google rewards them.'
  ELSE 'Slow — this is actively costing you visitors and search rankings.' || {LCP_CLAUSE} || ' Most people abandon a page that takes more than 3 seconds; a modern rebuild loads near-instantly.' END"""

# --- leads, intake, requests -------------------------------------------------------------------------

LEADS = f"leads AS ({derived(I.LEADS)})"
LEADS_OK = """accepted AS (
  SELECT lead_id, received_at, left(name, 120) AS name, left(email, 200) AS email, coalesce(url, '') AS url, coalesce(tier, '') AS tier,
    left(coalesce(business, ''), 200) AS business, left(coalesce(works, ''), 1000) AS works, left(coalesce(broken, ''), 1000) AS broken,
    left(coalesce(budget, ''), 60) AS budget, coalesce(score, '') AS score, coalesce(mockup, false) AS mockup
  FROM leads WHERE name <> '' AND email <> ''
)"""


def item(q: str, v: str) -> str:
    return f"CASE WHEN {v} <> '' THEN {{'q': '{q}', 'v': {v}}} END"


def trimmed(name: str) -> str:
    return f"trim(coalesce({name}, ''))"


def faq(n: int, q: str, a: str) -> str:
    return f"CASE WHEN {trimmed(q)} <> '' THEN {{'q': 'FAQ {n}', 'v': {trimmed(q)} || CASE WHEN {trimmed(a)} <> '' THEN ' — ' || {trimmed(a)} ELSE '' END}} END"


def section(name: str, *items: str) -> str:
    return f"{{'name': '{name}', 'items': list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)}}"


INTAKE = f"""forms AS ({derived(I.INTAKE_FORMS)}),
human AS (
  SELECT *, coalesce(nullif(trim(left(coalesce(nullif(business, ''), 'a client'), 120)), ''), 'a client') AS business_label,
    list_filter([
      {section('The business', item('Business name', trimmed('business')), item('Address', trimmed('address')), item('Phone', trimmed('phone')), item('Google Business Profile', trimmed('profile')))},
      {section('Pages', item('Pages needed', "replace(pages_picked, '|', ', ')"))},
      {section('FAQs', faq(1, 'faq_q1', 'faq_a1'), faq(2, 'faq_q2', 'faq_a2'))},
      {section('Goals', item('Anything else', trimmed('notes')), item('Primary goals', "replace(goals_picked, '|', ', ')"))}
    ], lambda s: len(s['items']) > 0) AS sections
  FROM forms WHERE coalesce(hp, '') = ''
)"""

def given(j: str) -> str:
    return f"""CASE coalesce(json_type({j}), 'NULL') WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN json_extract_string({j}, '$') <> ''
      WHEN 'BOOLEAN' THEN CAST({j} AS VARCHAR) = 'true' WHEN 'ARRAY' THEN true WHEN 'OBJECT' THEN true ELSE CAST({j} AS DOUBLE) <> 0 END"""


def json_text(j: str) -> str:
    return f"""CASE coalesce(json_type({j}), 'NULL') WHEN 'NULL' THEN '' WHEN 'VARCHAR' THEN json_extract_string({j}, '$')
      WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract({j}, '$[*]'), lambda x: coalesce(json_extract_string(x, '$'), '')), ',') ELSE CAST({j} AS VARCHAR) END"""


# sections and items as rows; what is no list has none
POSTS = f"""posts AS MATERIALIZED (
  SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM ({derived(I.INTAKE_POSTS)})
), human AS (
  SELECT submission_id, body, j IS NULL AS no_json, j->'$.business' AS business, CASE WHEN json_type(j->'$.sections') = 'ARRAY' THEN json_extract(j, '$.sections[*]') ELSE [] END AS sections
  FROM posts WHERE NOT coalesce({given("(j->'$.hp')")}, false)
), section_rows AS (
  SELECT submission_id, n - 1 AS section_no, sections[n] AS s FROM (SELECT submission_id, sections, unnest(range(1, len(sections) + 1)) AS n FROM human)
), listed AS (
  SELECT submission_id, section_no, s, s->'$.items' AS given_items, CASE WHEN json_type(s->'$.items') = 'ARRAY' THEN json_extract(s, '$.items[*]') ELSE [] END AS found FROM section_rows
), item_rows AS (
  SELECT submission_id, section_no, n - 1 AS pos, found[n] AS i FROM (SELECT *, unnest(range(1, len(found) + 1)) AS n FROM listed)
), unread AS (
  SELECT submission_id, body, CASE WHEN no_json THEN 'not json'
    WHEN submission_id IN (SELECT submission_id FROM listed WHERE json_type(s) = 'NULL' OR ({given('given_items')} AND json_type(given_items) <> 'ARRAY')) THEN 'bad section'
    WHEN submission_id IN (SELECT submission_id FROM item_rows WHERE json_type(i) = 'NULL') THEN 'bad item' END AS reason FROM human
)"""

LOG = f"log AS ({derived(I.REQUEST_LOG)})"


EVENT_REQUESTS = "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS ip, epoch_us(ts) AS ts FROM events"


def limiter(where: str = "true", source: str = EVENT_REQUESTS, window: str = str(WINDOW), soft: str = str(SOFT), daily: str = str(DAILY)) -> str:
    """Greedy sliding window, one request of each key per recursion step."""
    return f"""numbered AS (
  SELECT event_id, kind, ip, ts, row_number() OVER (PARTITION BY kind, ip ORDER BY ts, event_id) AS rn FROM ({source}) WHERE {where}
), decided AS (
  SELECT event_id, kind, ip, ts, rn, true AS soft_ok, [ts] AS hits FROM numbered WHERE rn = 1
  UNION ALL
  SELECT event_id, kind, ip, ts, rn, len(live) < {soft}, CASE WHEN len(live) < {soft} THEN list_append(live, ts) ELSE live END
  FROM (SELECT n.*, list_filter(d.hits, lambda x: n.ts - x < {window.replace('kind', 'n.kind')}) AS live FROM decided d JOIN numbered n ON n.kind = d.kind AND n.ip = d.ip AND n.rn = d.rn + 1)
), capped AS (
  SELECT *, soft_ok AND row_number() OVER (PARTITION BY kind, ip, ts // 86400000000, soft_ok ORDER BY ts, event_id) <= {daily} AS daily_ok FROM decided
)"""


GUARD_REQUESTS = """SELECT event_id, ['audit', 'deep', 'page'][CAST(event_id % 3 + 1 AS INT)] AS kind,
  CASE WHEN event_id % 5 IN (1, 2) THEN '0.0.0.0' ELSE CAST(user_id AS VARCHAR) END AS ip, epoch_us(ts) // 1000 AS ts FROM events"""


def guarded(where: str = "true") -> str:
    return limiter(
        where, GUARD_REQUESTS,
        window="CASE kind WHEN 'deep' THEN 1800000000 ELSE 1200000000 END",
        soft="CASE kind WHEN 'audit' THEN 8 WHEN 'deep' THEN 3 ELSE 10 END",
        daily="CASE kind WHEN 'audit' THEN 20 WHEN 'deep' THEN 6 ELSE 30 END",
    )


GUARDED = guarded()
# requests that arrive when the watermark has passed them
LATE = "(event_id % 31 = 7 AND ts < (SELECT max(epoch_us(ts) // 1000) FROM events) - 1800000000)"
FOREIGN = """NOT coalesce(bypass, false) AND NOT coalesce(regexp_replace(lower(regexp_extract(origin, '^https?://([^/]+)', 1)),
  CASE WHEN starts_with(origin, 'https') THEN ':443$' ELSE ':80$' END, '') = host, false)"""
CHAIN = (
    with_tables(
        LOG,
        f"foreign_ids AS (SELECT event_id FROM log WHERE {FOREIGN})",
        "owner_ids AS (SELECT event_id FROM log WHERE coalesce(bypass, false))",
        guarded("event_id NOT IN (SELECT event_id FROM foreign_ids) AND event_id NOT IN (SELECT event_id FROM owner_ids)"),
        f"requests AS ({GUARD_REQUESTS})",
        recursive=True,
    )
    + """SELECT event_id, kind, ip, CASE WHEN f.event_id IS NOT NULL THEN 'origin' WHEN o.event_id IS NOT NULL THEN 'admitted'
  WHEN NOT soft_ok THEN 'soft' WHEN NOT daily_ok THEN 'daily' ELSE 'admitted' END AS outcome
  FROM requests r LEFT JOIN (SELECT event_id, soft_ok, daily_ok FROM capped) c USING (event_id)
  LEFT JOIN foreign_ids f USING (event_id) LEFT JOIN owner_ids o USING (event_id)"""
)
LIMITED = with_tables(limiter(), recursive=True) + "SELECT event_id, soft_ok, daily_ok, daily_ok AS admitted FROM capped"

PANEL_ROWS = (
    f"panels AS ({derived(I.PANELS)})",
    f"panel_json AS (SELECT page_id, CASE WHEN json_valid(c) THEN CAST(c AS JSON) END AS j FROM (SELECT page_id, {unfence('text')} AS c FROM panels))",
    "panel_rows AS (SELECT page_id, unnest(range(len(json_extract(j, '$.panel[*]')))) AS pos, unnest(CAST(json_extract(j, '$.panel[*]') AS JSON[])) AS p FROM panel_json)",
    """panel_cleaned AS (SELECT q.page_id, CAST(pos AS INT) AS pos, CASE WHEN pos IS NOT NULL THEN left(coalesce(json_extract_string(p, '$.name'), ''), 30) END AS name,
  CASE WHEN pos IS NOT NULL THEN left(coalesce(json_extract_string(p, '$.role'), ''), 40) END AS role,
  CASE WHEN pos IS NOT NULL THEN left(coalesce(json_extract_string(p, '$.comment'), ''), 260) END AS comment
  FROM panel_json q LEFT JOIN (SELECT * FROM panel_rows WHERE pos < 6) r USING (page_id))""",
)
CRAWL_ROWS = "SELECT site_key, page_id, url, crawl_rank FROM crawl"
DIGESTS = f"""SELECT c.site_key, string_agg('URL: ' || c.url || chr(10) || 'TITLE: ' || {title_of('html')} || chr(10) || 'TEXT: ' || left({text_of('html')}, 1200), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY crawl_rank) AS digests
  FROM crawl c JOIN site_pages USING (page_id) WHERE crawl_rank <= 8 GROUP BY c.site_key"""
SYNTHESIS = """SELECT site_key, string_agg(url || ' (' || role || '): ' || coalesce(titles, ''), chr(10) ORDER BY crawl_rank) AS synthesis
  FROM results LEFT JOIN (SELECT page_id, string_agg(coalesce(title, ''), '; ' ORDER BY pos) AS titles FROM found GROUP BY page_id) USING (page_id) GROUP BY site_key"""

ORACLE: dict[str, str] = {
    "url_parts": f"""SELECT page_id, url AS normalized, {key('url')} AS page_key, {origin('url')} AS origin,
  {site('url')} AS site_key, {path('url')} AS path, {host('url')} AS host FROM pages""",
    # what a browser's address parser makes of each kind; the raw text where it refuses
    "odd_urls": with_tables(f"odd AS (SELECT page_id % 8 AS m, page_id, url, plain, split_part(plain, '/', 1) AS scheme, split_part(plain, '/', 3) AS h FROM ({derived(I.ODD_URLS)}))")
    + f"""SELECT page_id,
  CASE m WHEN 3 THEN plain WHEN 4 THEN url WHEN 5 THEN 'https://' || h || '/a%20b' WHEN 6 THEN 'https://' || h || '/?q=1' END AS normalized,
  CASE m WHEN 3 THEN {key('plain')} WHEN 4 THEN {site('plain')} || '/odd' WHEN 5 THEN {site('plain')} || '/a%20b' ELSE url END AS page_key,
  CASE m WHEN 3 THEN {origin('plain')} WHEN 4 THEN scheme || '//' || h || ':8080' WHEN 5 THEN 'https://' || h ELSE url END AS origin,
  CASE WHEN m IN (3, 4, 5) THEN {site('plain')} END AS site_key,
  CASE m WHEN 3 THEN {path('plain')} WHEN 4 THEN '/Odd//' WHEN 5 THEN '/a%20b' ELSE url END AS path,
  CASE m WHEN 3 THEN h WHEN 4 THEN h || ':8080' WHEN 5 THEN h ELSE url END AS host FROM odd""",
    "link_predicates": with_tables(
        SITE_PAGES,
        f"hrefs AS (SELECT page_id, url, {matches('html', ANCHOR, 1)}[1:80] AS h FROM site_pages)",
        "flat AS (SELECT page_id, url, unnest(h) AS href0, unnest(range(len(h))) AS pos FROM hrefs)",
        f"resolved AS (SELECT page_id, url, pos, {resolve('href0', 'url')} AS href FROM flat)",
    )
    + f"""SELECT page_id, pos, href, {origin('href')} = {origin('url')} AS same_origin,
  regexp_matches(href, '^https?:') AND {asset(path('href'))} AS asset, regexp_matches(href, '^https?:') AND {low_value(path('href'))} AS low_value FROM resolved""",
    "all_page_links": with_tables(
        SITE_PAGES, f"flat AS (SELECT page_id, unnest({matches('html', ANCHOR, 1)}) AS href FROM site_pages)"
    )
    + "SELECT page_id, count(*) AS links, count_if(NOT regexp_matches(href, '^(mailto|tel):')) AS web_links FROM flat GROUP BY page_id",
    "page_text": f"SELECT page_id, {text_of('html')} AS text FROM pages",
    "page_titles": with_tables(SITE_PAGES) + f"SELECT page_id, {title_of('html')} AS title FROM site_pages",
    "ld_blocks": with_tables(SITE_PAGES)
    + f"SELECT page_id, CAST(len(b) AS INT) AS blocks, array_to_string(b, ' | ') AS bodies, len(b) > 0 AS has_block, contains(lower(html), 'application/ld+json') AS has_mention FROM (SELECT *, {matches('html', LD, 1)} AS b FROM site_pages)",
    "schema_types_tree": with_tables(SITE_PAGES, TYPE_ROWS)
    + "SELECT page_id, coalesce(string_agg(ty, ' | ' ORDER BY ty), '') AS types, CAST(count(ty) AS INT) AS n FROM site_pages LEFT JOIN type_rows USING (page_id) GROUP BY page_id",
    "schema_types_walk": with_tables(SITE_PAGES, TYPE_ROWS)
    + "SELECT page_id, coalesce(string_agg(ty, ' | ' ORDER BY ty), '') AS types, CAST(count(ty) AS INT) AS n FROM site_pages LEFT JOIN type_rows USING (page_id) GROUP BY page_id",
    "schema_types_regex": with_tables(SITE_PAGES)
    + f"""SELECT page_id, array_to_string(t, ' | ') AS types, array_to_string(t[1:14], ' | ') AS prompt_types,
  len(list_filter(t, lambda x: regexp_matches(x, 'FAQPage', 'i'))) > 0 AS has_faq, len(list_filter(t, lambda x: regexp_matches(x, '^Menu(Item|Section)?$', 'i'))) > 0 AS has_menu
  FROM (SELECT page_id, {distinct(TYPES_CI)} AS t FROM site_pages)""",
    "page_meta_flags": with_tables(SITE_PAGES)
    + f"""SELECT page_id, {has('html', META)} AS meta, {count_of('html', IMG)} AS images, {ALT} AS images_with_alt,
  {has('html', "name=[\"']viewport[\"']")} AS viewport, {has('html', "property=[\"']og:")} AS og, {has('html', 'breadcrumb')} AS breadcrumb,
  {has('html', COMMERCE)} AS commerce, {has('html', RETAIL)} AS retail, {PLATFORM} AS platform, {has('html', GEO)} AS geo, {has('html', FAQPAGE)} AS faqpage,
  {', '.join(f"{has('html', p, f)} AS prop_{n}" for n, (p, f) in PROPS.items())},
  {has('html', "href=[\"']mailto:")} AS mailto, {has('html', "href=[\"']tel:")} AS tel, {has('html', CANONICAL)} AS canonical, {has('html', NOINDEX)} AS noindex FROM site_pages""",
    "product_evidence": with_tables(SITE_PAGES) + f"SELECT page_id, {EVIDENCE} AS evidence FROM site_pages",
    "question_headings": with_tables(SITE_PAGES) + f"SELECT page_id, {QUESTIONS} AS questions FROM site_pages",
    "form_pages": with_tables(SITE_PAGES)
    + f"SELECT page_id, {count_of('html', FORM)} AS forms, {count_of('html', FIELD)} AS fields, {has('html', FORM)} AND {count_of('html', FIELD)} >= 2 AS form_page FROM site_pages",
    "newest_year": with_tables(SITE_PAGES)
    + f"SELECT page_id, {YEAR_OF} AS newest_year FROM (SELECT page_id, {text_of('html')} AS t FROM site_pages)",
    "page_facts": with_tables(SITE_PAGES)
    + (FACTS := f"""SELECT page_id, url, {title_of('html')} AS title, left({text_of('html')}, 7000) AS text, contains(lower(html), 'application/ld+json') AS has_schema,
  array_to_string({distinct(TYPES_CI)}, ' | ') AS schema_types, {has('html', META)} AS has_meta, {count_of('html', IMG)} AS images, {ALT} AS images_with_alt,
  {QUESTIONS} AS question_headings, {count_of('html', FORM)} AS forms, {count_of('html', FIELD)} AS form_fields,
  {has('html', "href=[\"']mailto:")} AS has_mailto, {has('html', "href=[\"']tel:")} AS has_tel,
  len(list_filter({TYPES_CI}, lambda x: regexp_matches(x, 'FAQPage', 'i'))) > 0 AS has_faq_schema,
  len(list_filter({TYPES_CI}, lambda x: regexp_matches(x, '^Menu(Item|Section)?$', 'i'))) > 0 AS has_menu_schema FROM site_pages"""),
    "page_prompts": with_tables(SITE_PAGES)
    + f"""SELECT page_id, url, title, 'schema=' || has_schema || ' types=[' || replace(schema_types, ' | ', ', ') || '] faqSchema=' || has_faq_schema || ' menuSchema=' || has_menu_schema
  || ' meta=' || has_meta || ' images=' || images || ' withAlt=' || images_with_alt || ' questionHeadings=' || question_headings || ' forms=' || forms || ' formFields=' || form_fields
  || ' mailto=' || has_mailto || ' tel=' || has_tel AS facts, text FROM ({FACTS})""",
    "site_rollup": ROLLUP_TABLES
    + f"""SELECT site_key, page_count, pages_with_schema, pages_with_meta, form_pages, has_breadcrumb, commerce_platform, has_geo, has_mailto, has_tel, has_noindex,
  {', '.join(f'prop_{n}' for n in PROPS)}, product_evidence, question_headings, newest_year FROM rolled""",
    "site_lists": AUDIT_TABLES
    + "SELECT site_key, array_to_string(schema_types, ' | ') AS schema_types, array_to_string(faq_pages, ' | ') AS faq_pages, array_to_string(question_heading_pages, ' | ') AS question_heading_pages FROM sites",
    "home_signals": ROLLUP_TABLES
    + "SELECT site_key, origin, home_img_count, home_img_with_alt, has_viewport, has_og, home_canonical, home_title, platform, retail_hint FROM rolled",
    "site_entity_flags": AUDIT_TABLES
    + """SELECT site_key, has_faq_schema, has_local_business, has_organization, complete_local_entity, has_entity_graph, is_https, looks_stale, crawl_capped,
  properties_found, properties_missing FROM signals""",
    "commerce_state": AUDIT_TABLES + "SELECT site_key, product_evidence, commerce_state, has_store FROM signals",
    "tier_and_quote": with_tables(
        SITE_PAGES,
        f"sizes AS (SELECT {site('url')} AS site_key, count(*) AS site_size, sum({EVIDENCE}) >= 4 AS has_store FROM site_pages GROUP BY 1)",
        "tiers AS (SELECT *, CASE WHEN has_store THEN 'large' WHEN site_size <= 6 THEN 'small' WHEN site_size <= 19 THEN 'medium' WHEN site_size <= 49 THEN 'large' ELSE 'enterprise' END AS tier FROM sizes)",
    )
    + f"""SELECT site_key, site_size, has_store, tier, {QUOTE_NAME} AS quote_name, tier = 'enterprise' AS enterprise,
  CASE tier WHEN 'small' THEN 2000 WHEN 'medium' THEN 5000 WHEN 'large' THEN 9500 END AS quote_total,
  CASE tier WHEN 'small' THEN 1000 WHEN 'medium' THEN 1500 WHEN 'large' THEN 2500 END AS first_price,
  CASE tier WHEN 'small' THEN 'Phase 1 | Phase 2' WHEN 'enterprise' THEN NULL ELSE 'Phase 1 | Phase 2 | Phase 3' END AS typical,
  CASE tier WHEN 'small' THEN 2 WHEN 'enterprise' THEN NULL ELSE 3 END AS phase_count,
  CASE tier WHEN 'small' THEN 'Includes a hero photo shoot — 5 images, a $1,500 value, built into Phase 1.' WHEN 'enterprise' THEN NULL
    ELSE 'Includes a hero photo shoot — 5–10 images, a $1,500 value, built into Phase 1.' END AS photo FROM tiers""",
    "site_phases": AUDIT_TABLES
    + """SELECT site_key, tier, phase, price FROM audit JOIN (VALUES ('small', 'Phase 1', 1000), ('small', 'Phase 2', 1000), ('medium', 'Phase 1', 1500), ('medium', 'Phase 2', 2000),
  ('medium', 'Phase 3', 1500), ('large', 'Phase 1', 2500), ('large', 'Phase 2', 4500), ('large', 'Phase 3', 2500)) AS p(tier, phase, price) USING (tier)""",
    "site_scorecard": AUDIT_TABLES
    + 'SELECT site_key, page_count, site_size, tier, commerce_state, pct, grade, organic, answer, "local", quote_total FROM audit',
    "display_bands": AUDIT_TABLES
    + "SELECT site_key, pct, grade, CASE WHEN pct < 60 THEN '#e2735a' WHEN pct < 70 THEN '#e0935a' WHEN pct < 80 THEN '#e0c05a' WHEN pct < 90 THEN '#8fb89a' ELSE '#7fd0a8' END AS grade_color, "
    + ", ".join(
        f"\"{s}\" AS {s}_meter, CASE WHEN \"{s}\" < 40 THEN '#c0492a' WHEN \"{s}\" < 70 THEN '#c9952f' ELSE '#2f4a3e' END AS {s}_color"
        for s in ("organic", "answer", "local")
    )
    + ", CASE WHEN tier = 'enterprise' THEN 'call' WHEN pct >= 90 THEN 'refresh' ELSE 'phase_1' END AS offer, first_price FROM audit",
    "site_audit": (HOME_TABLES := with_tables(
        *CRAWLED, TYPE_ROWS, SIGNALS, AUDIT, SPEED,
        f"reports AS ({derived(I.REPORTS)})",
        f"report_json AS (SELECT page_id, CASE WHEN json_valid(c) THEN CAST(c AS JSON) END AS j FROM (SELECT page_id, {unfence('text')} AS c FROM reports))",
        "homes AS (SELECT site_key, page_id FROM crawl WHERE crawl_rank = 1)",
        f"first AS ({findings_rows('j', 'page_id', 'report_json')})",
        recursive=True,
    ))
    + """SELECT a.site_key, tier, pct, s.score AS speed_score, s.lcp AS lcp, json_extract_string(r.j, '$.summary') AS summary,
  json_extract_string(r.j, '$.surfaces.answer') AS answer_read, f.priority AS first_priority
  FROM audit a JOIN homes h USING (site_key) LEFT JOIN speed_read s ON s.page_id = h.page_id AND s.score IS NOT NULL LEFT JOIN report_json r ON r.page_id = h.page_id
  LEFT JOIN first f ON f.page_id = h.page_id AND f.pos = 0""",
    "summary_audit": HOME_TABLES
    + f"""SELECT a.site_key, a.origin, page_count, sitemap_total, site_size, crawl_capped, tier, {QUOTE_NAME} AS quote_name, quote_total, pct, grade, organic, answer, "local",
  {READ} AS speed_read, json_extract_string(r.j, '$.summary') AS summary, v.crawled_pages
  FROM audit a JOIN homes h USING (site_key) LEFT JOIN speed_read s ON s.page_id = h.page_id AND s.score IS NOT NULL LEFT JOIN report_json r ON r.page_id = h.page_id
  JOIN (SELECT site_key, string_agg(url, ' | ' ORDER BY crawl_rank) AS crawled_pages FROM crawl GROUP BY site_key) v USING (site_key)""",
    "audit_payload": AUDIT_TABLES
    + f'SELECT site_key, tier, pct, "local", prop_sameAs AS same_as, prop_menuMarkup AS menu_markup, home_title, {QUOTE_NAME} AS quote_name, quote_total FROM audit',
    "sitemap_choice": with_tables(SITEMAPS) + "SELECT origin, path, is_index, CAST(len(locs) AS INT) AS locs FROM chosen",
    "sitemap_children": with_tables(SITEMAPS)
    + "SELECT origin, CAST(file_no AS INT) AS file_no, CAST(kind_rank AS INT) AS kind_rank, child_url FROM children",
    "sitemap_cutoff": with_tables(SITEMAPS)
    + "SELECT origin, CAST(file_no AS INT) AS file_no, child_url, CAST(len(locs) AS INT) AS locs, before FROM cut",
    "sitemap_total": with_tables(SITEMAPS)
    + f"""SELECT u.origin, count_if(NOT (regexp_matches(loc, '^https?://') AND {low_value(path('loc'))})) AS sitemap_total, any_value(n) AS seeds
  FROM sitemap_urls u LEFT JOIN (SELECT origin, count(*) AS n FROM seeds GROUP BY origin) s USING (origin) GROUP BY u.origin""",
    "crawl_plan_12": with_tables(*CRAWLED, recursive=True) + CRAWL_ROWS,
    "crawl_plan_15": with_tables(*DEEP_CRAWLED, recursive=True) + CRAWL_ROWS,
    "crawl_links_only": with_tables(SITE_PAGES, SITEMAPS, crawl(12, 80, False), recursive=True) + CRAWL_ROWS,
    "site_digests": with_tables(*CRAWLED, recursive=True) + DIGESTS,
    "site_prompts": AUDIT_TABLES
    + "SELECT site_key, digests, concat_ws(chr(10), "
    + ", ".join(
        f"'- {label}: ' || {value}"
        for label, value in [
            ("tier", "tier"), ("score", "pct || '% (' || grade || ')'"),
            ("pages crawled", "page_count || CASE WHEN site_size > page_count THEN ' of ~' || site_size ELSE '' END"),
            ("platform", "platform"), ("commerce", "commerce_state"), ("retail", "retail_hint"), ("https", "is_https"),
            ("viewport", "has_viewport"), ("social tags", "has_og"), ("breadcrumbs", "has_breadcrumb"),
            ("pages with structured data", "pages_with_schema || '/' || page_count"),
            ("schema types", "coalesce(nullif(array_to_string(schema_types, ', '), ''), 'NONE')"),
            ("faq schema", "has_faq_schema"),
            ("faq pages", "coalesce(nullif(array_to_string(faq_pages, ', '), ''), 'none')"),
            ("properties found", "properties_found"), ("properties not found", "properties_missing"),
            ("local business type", "has_local_business"), ("geo coordinates", "has_geo"),
            ("complete local entity", "complete_local_entity"), ("organization", "has_organization"),
            ("question headings", "question_headings"),
            ("question heading pages", "coalesce(nullif(array_to_string(question_heading_pages, ', '), ''), 'none')"),
            ("pages with meta description", "pages_with_meta || '/' || page_count"),
            ("newest year", "coalesce(CAST(newest_year AS VARCHAR), 'none found')"), ("stale", "looks_stale"),
            ("home images with alt", "home_img_with_alt || '/' || home_img_count"), ("form pages", "form_pages"),
            ("mailto", "has_mailto"), ("tel", "has_tel"), ("canonical", "home_canonical"), ("noindex", "has_noindex"),
            ("home title", "home_title"),
        ]
    )
    + f") AS facts FROM audit JOIN ({DIGESTS}) USING (site_key)",
    "panel_input": with_tables(*CRAWLED, recursive=True)
    + f"SELECT c.site_key, page_id, c.url, left({text_of('html')}, 2600) AS text FROM crawl c JOIN site_pages USING (page_id) WHERE crawl_rank = 1",
    "findings_clean": with_tables(
        REPLIES,
        "usable AS (SELECT page_id, coalesce(json_extract_string(j, '$.role'), '') AS role, j FROM parsed WHERE NOT replied OR j IS NOT NULL)",
        f"found AS ({findings_rows('j', 'page_id, role', 'usable')})",
    )
    + "SELECT u.page_id, u.role, f.pos, f.priority, f.title, f.rec FROM usable u LEFT JOIN found f USING (page_id)",
    "synthesis_input": with_tables(*DEEP_CRAWLED, REPLIES, CRAWL_15, recursive=True)
    + SYNTHESIS,
    "report_lines": with_tables(
        *DEEP_CRAWLED, REPLIES, CRAWL_15,
        f"sizes AS (SELECT {site('url')} AS site_key, count(*) AS site_size FROM pages GROUP BY 1)",
        f"known_sites AS (SELECT site_key FROM roots WHERE ({I.SITE_NO.replace('host', 'site_key')}) % 3 <> 0)",
        """coverage AS (SELECT r.site_key, CASE WHEN any_value(h.site_key) IS NOT NULL AND any_value(s.site_size) > count(*) THEN count(*) || ' of ~' || any_value(s.site_size) ELSE CAST(count(*) AS VARCHAR) END AS coverage
  FROM results r LEFT JOIN sizes s USING (site_key) LEFT JOIN known_sites h USING (site_key) GROUP BY r.site_key)""",
        recursive=True,
    )
    + f"""SELECT site_key, crawl_rank, {path('url')} AS path, role, pos, CASE priority WHEN 'high' THEN 'Critical' WHEN 'med' THEN 'Important' ELSE 'Polish' END AS label, CASE priority WHEN 'high' THEN '#c0492a' WHEN 'med' THEN '#c9952f' ELSE '#4a6b5b' END AS color, title, rec, coverage
  FROM found JOIN coverage USING (site_key)""",
    "deep_payload": with_tables(*DEEP_CRAWLED, REPLIES, CRAWL_15, recursive=True)
    + f"""SELECT r.site_key, CAST(row_number() OVER (PARTITION BY r.site_key ORDER BY r.crawl_rank) - 1 AS INT) AS pos, r.url, {title_of('s.html')} AS title, r.role,
  CAST(coalesce(n, 0) AS INT) AS findings FROM results r JOIN site_pages s USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM found GROUP BY page_id) f USING (page_id)""",
    "deep_report": with_tables(
        *DEEP_CRAWLED, REPLIES, CRAWL_15, *PANEL_ROWS,
        f"synthesis AS ({SYNTHESIS})",
        "home_panels AS (SELECT c.site_key, string_agg(concat_ws('/', name, role, comment), ' | ' ORDER BY pos) AS panel FROM crawl c JOIN panel_cleaned USING (page_id) WHERE crawl_rank = 1 AND pos IS NOT NULL GROUP BY c.site_key)",
        recursive=True,
    )
    + """SELECT site_key, n.pages, synthesis, panel FROM (SELECT site_key, CAST(count(*) AS INT) AS pages FROM results GROUP BY site_key) n
  LEFT JOIN synthesis USING (site_key) LEFT JOIN home_panels USING (site_key)""",
    "page_audit": with_tables(SITE_PAGES)
    + f"""SELECT * FROM ({FACTS}) WHERE page_id = (SELECT min(page_id) FROM site_pages
  WHERE {key('url')} = (SELECT {key('url')} FROM pages ORDER BY page_id LIMIT 1))""",
    "panel_clean": with_tables(*PANEL_ROWS) + "SELECT * FROM panel_cleaned",
    "speed_readings": with_tables(SPEED) + f"SELECT page_id, score, lcp, lcp_ms, timed_out, {READ} AS read FROM speed_read",
    "speed_attempts": with_tables(
        f"attempts AS ({derived(I.SPEED_ATTEMPTS)})",
        """speed AS (SELECT a.page_id, CASE WHEN a.ended = 'timeout' THEN 'timeout' WHEN a.ended = 'http' AND a.http BETWEEN 200 AND 299 THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN a.http BETWEEN 200 AND 299 THEN a.body END AS body
  FROM attempts a JOIN attempts f ON f.page_id = a.page_id AND f.attempt = 0
  WHERE a.attempt = CASE WHEN f.ended = 'http' AND (f.http = 429 OR f.http >= 500) THEN 1 ELSE 0 END)""",
        SPEED[SPEED.index("speed_json AS"):],
    )
    + f"SELECT page_id, status, score, lcp, lcp_ms, timed_out, {READ} AS read FROM speed_read JOIN (SELECT page_id, status FROM speed) USING (page_id)",
    "leads_valid": with_tables(LEADS, LEADS_OK)
    + r"SELECT *, CASE WHEN regexp_matches(trim(email), '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN left(trim(email), 200) END AS reply_to FROM accepted",
    "leads_rejected": with_tables(LEADS)
    + "SELECT lead_id, received_at, name, email FROM leads WHERE NOT coalesce(name <> '' AND email <> '', false)",
    "lead_summary": with_tables(
        LEADS, LEADS_OK,
        """named AS (SELECT *, CASE WHEN starts_with(score, '{') AND coalesce(json_extract_string(CASE WHEN starts_with(score, '{') THEN score END, '$.grade'), '') <> ''
    THEN json_extract_string(score, '$.grade') || ' (' || json_extract_string(score, '$.pct') || '%)' ELSE score END AS score_text FROM accepted)""",
    )
    + """SELECT lead_id, score_text, CASE WHEN business = '' THEN name ELSE business END || ' (' || tier || ')' AS headline,
  'Name: ' || name || chr(10) || 'Email: ' || email || chr(10) || 'Business: ' || business || chr(10) || 'Site: ' || url || chr(10) || 'Tier: ' || tier || chr(10) || 'Score: ' || score_text || chr(10)
  || 'Budget: ' || budget || chr(10) || 'Mockup: ' || CASE WHEN mockup THEN 'YES' ELSE 'no' END || chr(10) || 'Working: ' || coalesce(nullif(works, ''), '(blank)') || chr(10) || 'Not working: ' || coalesce(nullif(broken, ''), '(blank)') AS body FROM named""",
    "leads_latest": with_tables(LEADS, LEADS_OK)
    + "SELECT received_at, email, lead_id, name, score FROM accepted QUALIFY row_number() OVER (PARTITION BY received_at, email ORDER BY lead_id DESC) = 1",
    "stream_leads_latest": with_tables(LEADS, LEADS_OK)
    + "SELECT received_at, email, lead_id, name, score FROM accepted QUALIFY row_number() OVER (PARTITION BY received_at, email ORDER BY lead_id DESC) = 1",
    "stream_daily_counts": "SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS ip, epoch_us(ts) // 86400000000 AS day, count(*) AS requests FROM events GROUP BY ALL",
    "intake_long": with_tables(
        INTAKE,
        "s AS (SELECT submission_id, unnest(sections) AS s, unnest(range(len(sections))) AS section_no FROM human)",
        "i AS (SELECT submission_id, section_no, s.name AS section, unnest(s['items']) AS item, unnest(range(len(s['items']))) AS pos FROM s)",
    )
    + """SELECT h.submission_id, h.business_label, CAST(section_no AS INT) AS section_no, section, CAST(pos AS INT) AS pos, item.q AS q, item.v AS v
  FROM human h LEFT JOIN i USING (submission_id)""",
    "intake_markdown": with_tables(INTAKE)
    + """SELECT submission_id, lower(regexp_replace(coalesce(nullif(trim(business), ''), 'intake'), '[^a-z0-9]+', '-', 'gi')) AS slug,
  '# Project Intake — ' || coalesce(nullif(trim(business), ''), 'your business') || chr(10) || array_to_string([''] || list_transform(sections, lambda s: '## ' || s.name || chr(10)
  || array_to_string(list_transform(s['items'], lambda i: '- **' || i.q || ':** ' || i.v), chr(10)) || chr(10)), chr(10)) AS document FROM human""",
    "intake_posted": with_tables(POSTS)
    + f"""SELECT h.submission_id, coalesce(nullif(CASE WHEN {given('business')} THEN trim(left({json_text('business')}, 120)) END, ''), 'a client') AS business_label,
  CAST(l.section_no AS INT) AS section_no, CASE WHEN l.section_no IS NOT NULL THEN {json_text("(l.s->'$.name')")} END AS section, CAST(r.pos AS INT) AS pos,
  CASE WHEN r.pos IS NOT NULL THEN {json_text("(r.i->'$.q')")} END AS q, CASE WHEN r.pos IS NOT NULL THEN {json_text("(r.i->'$.v')")} END AS v
  FROM human h JOIN unread u ON u.submission_id = h.submission_id AND u.reason IS NULL
  LEFT JOIN listed l ON l.submission_id = h.submission_id LEFT JOIN item_rows r ON r.submission_id = l.submission_id AND r.section_no = l.section_no""",
    "intake_unread": with_tables(POSTS) + "SELECT * FROM unread WHERE reason IS NOT NULL",
    "request_meta": with_tables(LOG)
    + """SELECT event_id, coalesce(bypass, false) AS owner_run, array_to_string(list_filter([city, region, country], lambda x: x <> ''), ', ') AS "where", coalesce(org, '') AS org, ip,
  left(src, 300) AS src, left(ua, 160) AS ua FROM log""",
    "origin_rejects": with_tables(LOG)
    + """SELECT event_id, origin, host FROM log WHERE NOT coalesce(bypass, false)
  AND NOT coalesce(regexp_replace(lower(regexp_extract(origin, '^https?://([^/]+)', 1)), CASE WHEN starts_with(origin, 'https') THEN ':443$' ELSE ':80$' END, '') = host, false)""",
    "soft_limit": with_tables(limiter(), recursive=True) + "SELECT event_id, kind, ip, soft_ok FROM decided",
    "daily_cap": LIMITED,
    "bypass": with_tables(limiter("NOT ends_with(ip, '7')"), recursive=True)
    + "SELECT event_id, daily_ok AS admitted FROM capped UNION ALL SELECT event_id, true FROM events WHERE ends_with(CAST(user_id AS VARCHAR), '7')",
    "guard_limits": with_tables(GUARDED, recursive=True)
    + "SELECT event_id, kind, ip, soft_ok, daily_ok, daily_ok AS admitted FROM capped",
    "stream_guard_limits": with_tables(GUARDED, recursive=True)
    + "SELECT event_id, kind, ip, soft_ok, daily_ok, daily_ok AS admitted FROM capped",
    "guarded_requests": CHAIN,
    "stream_guarded_requests": CHAIN,
    "stream_event_time": with_tables(guarded(f"NOT {LATE}"), recursive=True)
    + f"""SELECT event_id, soft_ok, daily_ok, daily_ok AS admitted, false AS late FROM capped
  UNION ALL SELECT event_id, NULL, NULL, NULL, true FROM ({GUARD_REQUESTS}) WHERE {LATE}""",
    "stream_late_counts": f"SELECT kind, ts // 86400000000 AS day, count(*) AS late_requests FROM ({GUARD_REQUESTS}) WHERE {LATE} GROUP BY ALL",
    "trailing_hits": f"""SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hits FROM events""",
    "daily_counts": "SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS ip, epoch_us(ts) // 86400000000 AS day, count(*) AS requests FROM events GROUP BY ALL",
    # one file after the other in the order of time: no request is late
    "stream_soft_limit": LIMITED.replace("SELECT event_id, soft_ok", "SELECT event_id, false AS late, soft_ok"),
    "stream_leads": with_tables(LEADS, LEADS_OK)
    + "SELECT lead_id, email, true AS accepted FROM accepted UNION ALL SELECT lead_id, email, false FROM leads WHERE NOT coalesce(name <> '' AND email <> '', false)",
}
