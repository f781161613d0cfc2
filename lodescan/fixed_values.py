"""Word lists, patterns, weights and limits the results depend on.

Everything here is data, not logic. Patterns are Java regular expressions for
``rlike`` / ``regexp_*``; ``B`` is an ASCII word boundary, spelled with look-arounds
because Java's own ``\\b`` is Unicode-aware. Where only existence matters, ``B_BEFORE``
consumes the character in front instead, which is much cheaper to try at every position.
"""

# --- regex building blocks ------------------------------------------------------
WORD = "[A-Za-z0-9_]"
B_START = f"(?<!{WORD})"
B_END = f"(?!{WORD})"
B_BEFORE = "(?:^|[^A-Za-z0-9_])"
# every character the web platform treats as white space
WS_CHARS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_CHARS}]"
# one range that covers all white space outside ASCII, to tell quickly that there is none
WS_BEYOND_ASCII = r"[\x{A0}\x{1680}-\x{FEFF}]"
# ASCII white space that is not a single blank already
WS_ASCII_RUN = r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]"

# --- crawl budgets ---------------------------------------------------------------
SUMMARY_PAGE_CAP = 12
DEEP_PAGE_CAP = 15
SUMMARY_LINKS_PER_PAGE = 80
SITEMAP_PATHS = ["/sitemap_index.xml", "/wp-sitemap.xml", "/sitemap.xml"]
CHILD_SITEMAPS = 4
CHILD_SITEMAP_RANK = [("page", 0), ("post", 1), ("product", 2)]
CHILD_SITEMAP_OTHER_RANK = 5
CHILD_SITEMAP_STOP_AFTER = 50

# --- text budgets (characters) ----------------------------------------------------
DIGEST_PAGES = 8
DIGEST_CHARS = 1200
DEEP_PAGE_CHARS = 7000
PANEL_CHARS = 2600
PROMPT_TYPES = 14
PANEL_ROWS = 6
PANEL_NAME_CHARS, PANEL_ROLE_CHARS, PANEL_COMMENT_CHARS = 30, 40, 260

# --- URL patterns -----------------------------------------------------------------
ASSET_PATH = r"(?i)\.(png|jpe?g|gif|webp|svg|css|js|pdf|zip|mp4|woff2?|ico)(\?|\z)"
LOW_VALUE_PATH = r"(?i)/(tag|category|author|feed)/"

# --- HTML patterns ----------------------------------------------------------------
SCRIPT_ELEMENT = r"(?is)<script.*?</script>"
STYLE_ELEMENT = r"(?is)<style.*?</style>"
ANY_TAG = r"<[^>]+>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LD_JSON_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
LD_JSON_MENTION = "application/ld+json"
TYPE_LITERAL_CI = r'(?i)"@type"\s*:\s*"([^"]+)"'
META_DESCRIPTION = (
    r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["'][^"']{20,}"""
)
IMG_TAG = rf"(?i)<img{B_END}[^>]*>"
ALT_ATTRIBUTE = rf"(?i){B_BEFORE}alt\s*="
VIEWPORT = r"""(?i)name=["']viewport["']"""
OPEN_GRAPH = r"""(?i)property=["']og:"""
BREADCRUMB = "breadcrumb"
COMMERCE_PLATFORMS = [
    "woocommerce", "cdn.shopify", "snipcart", "bigcommerce", "squarespace-commerce", "ecwid",
]
PRODUCT_TYPE = r'(?i)"@type"\s*:\s*"product"'
ADD_TO_CART = r"(?i)add[-_ ]to[-_ ]cart"
PRODUCT_LINK = r"(?i)/product/|/products/|/shop/[a-z0-9-]+"
PRODUCT_LINK_CAP = 5
STORE_EVIDENCE = 4
RETAIL_WORDS = (
    rf"(?i){B_BEFORE}(boutique|clothing|apparel|shop|store|gifts?|jewelry|goods"
    rf"|merchandise|prints?|gallery|outfitter|supply){B_END}"
)
PLATFORMS = [
    ("WordPress", ["wp-content"]),
    ("Shopify", ["cdn.shopify"]),
    ("Wix", ["wix.com", "_wixcss"]),
    ("Squarespace", ["squarespace"]),
]
PLATFORM_UNKNOWN = "unknown"
GEO = r'(?i)"geo"\s*:|GeoCoordinates'
FAQ_PAGE_MARKUP = r'(?i)"@type"\s*:\s*"FAQPage"'
SCHEMA_PROPERTIES = [
    ("award", r'"award"\s*:'),
    ("openingHours", r'(?i)openingHoursSpecification|"openingHours"\s*:'),
    ("telephone", r'"telephone"\s*:'),
    ("priceRange", r'"priceRange"\s*:'),
    ("servesCuisine", r'"servesCuisine"\s*:'),
    ("sameAs", r'"sameAs"\s*:'),
]
MENU_MARKUP = "menuMarkup"
HEADING_2_TO_4 = r"(?is)<h[2-4][^>]*>(.*?)</h[2-4]>"
FORM_TAG = rf"(?i)<form{B_END}"
FIELD_TAG = rf"(?i)<(input|textarea|select){B_END}"
FORM_PAGE_FIELDS = 2
MAILTO = r"""(?i)href=["']mailto:"""
TEL = r"""(?i)href=["']tel:"""
CANONICAL = r"""(?i)<link[^>]+rel=["']canonical["']"""
NOINDEX = r"""(?i)<meta[^>]+name=["']robots["'][^>]*noindex"""
CALENDAR_YEAR = r"(?<![\d.$])(20[12]\d)(?![\d.])"
ANCHOR_HREF = rf"""(?i)<a{B_END}[^>]*{B_START}href\s*=\s*["']([^"'#]+)["']"""
SITEMAP_ROOT = r"(?i)<(urlset|sitemapindex)"
SITEMAP_INDEX = r"(?i)<sitemapindex"
SITEMAP_LOC = rf"(?i)<loc>{WS}*([^<{WS_CHARS}]+){WS}*</loc>"
SITEMAP_FILE = r"(?i)\.xml"

# --- schema type vocabularies -------------------------------------------------------
FAQ_TYPES = r"(?i)FAQPage|Question"
FAQ_PAGE_TYPE = r"(?i)FAQPage"
MENU_TYPE = r"(?i)^Menu\z"
MENU_TYPES = r"(?i)^Menu(Item|Section)?\z"
ORGANIZATION_TYPE = r"(?i)Organization"
# matched anywhere inside a type name, so "Newspaper" counts through "Spa"
LOCAL_BUSINESS_NAMES = [
    "LocalBusiness", "Restaurant", "FoodEstablishment", "Cafe", "CafeOrCoffeeShop",
    "Bar", "Bakery", "Brewery", "Winery", "Distillery", "Store", "Shop", "Hotel",
    "Motel", "Lodging", "Resort", "BedAndBreakfast", "Spa", "DaySpa", "BeautySalon",
    "HairSalon", "NailSalon", "HealthAndBeauty", "MedicalBusiness", "Dentist",
    "Physician", "Hospital", "VeterinaryCare", "ProfessionalService", "LegalService",
    "Attorney", "Notary", "FinancialService", "InsuranceAgency", "AccountingService",
    "RealEstateAgent", "AutomotiveBusiness", "AutoRepair",
    "HomeAndConstructionBusiness", "GeneralContractor", "Plumber", "Electrician",
    "RoofingContractor", "Locksmith", "MovingCompany", "TravelAgency",
    "TouristAttraction", "Aquarium", "Zoo", "Museum", "ArtGallery", "AmusementPark",
    "Campground", "EventVenue", "PerformingArtsTheater", "Place",
]
LOCAL_BUSINESS_TYPES = "(?i)" + "|".join(LOCAL_BUSINESS_NAMES)

# --- size tiers ---------------------------------------------------------------------
# inclusive upper page bounds, in order; larger sites are enterprise
TIER_PAGE_BOUNDS = [("small", 6), ("medium", 19), ("large", 49)]
TIER_ENTERPRISE = "enterprise"
TIER_STORE = "large"
TIERS = [
    # tier, display name, enterprise, typical phases, photo note
    ("small", "Small site", False, ["Phase 1", "Phase 2"],
     "Includes a hero photo shoot — 5 images, a $1,500 value, built into Phase 1."),
    ("medium", "Medium site", False, ["Phase 1", "Phase 2", "Phase 3"],
     "Includes a hero photo shoot — 5–10 images, a $1,500 value, built into Phase 1."),
    ("large", "Large / e-commerce site", False, ["Phase 1", "Phase 2", "Phase 3"],
     "Includes a hero photo shoot — 5–10 images, a $1,500 value, built into Phase 1."),
    ("enterprise", "Enterprise / institutional", True, None, None),
]
PHASES = [
    # tier, phase, price, scope, who does it
    ("small", "Phase 1", 1000,
     "A full redesign + every critical fix — a fast, modern site with structured data, "
     "titles, meta and alt text done right",
     "Agent does the heavy lifting · you approve"),
    ("small", "Phase 2", 1000,
     "Deeper AI-search work: FAQ schema, copy rewritten for citability, finishing touches",
     "Scoped after we re-audit Phase 1"),
    ("medium", "Phase 1", 1500,
     "A full redesign + critical fixes on every page — fast and modern, with schema, "
     "metadata and alt text done right",
     "Agent does the heavy lifting · you approve"),
    ("medium", "Phase 2", 2000,
     "AI-search content: FAQ schema, page restructuring, copy reworked for citability",
     "Written by the editor"),
    ("medium", "Phase 3", 1500,
     "UX, navigation, plugins, performance, ongoing marketing plan", "Agent-assisted"),
    ("large", "Phase 1", 2500,
     "A full redesign + critical & catalog fixes — org/product schema, per-product "
     "metadata, alt text, breadcrumbs",
     "Agent does the high-volume data entry · you approve"),
    ("large", "Phase 2", 4500,
     "AI-search content: FAQ schema, category & landing rewrites, citable copy throughout",
     "Written by the editor"),
    ("large", "Phase 3", 2500,
     "Full UX/nav rebuild, plugin stack, performance, conversion + marketing strategy",
     "Agent-assisted"),
]

# --- scores ---------------------------------------------------------------------------
OVERALL_WEIGHTS = {
    "organization": 8, "complete_local_entity": 10, "faq_schema": 16,
    "three_question_headings": 10, "one_question_heading": 5, "schema_depth": 6,
    "meta_on_most_pages": 8, "meta_on_some_pages": 4, "home_title": 6,
    "breadcrumb": 6, "alt_text": 8, "https": 5, "viewport": 5, "open_graph": 4,
    "not_stale": 5, "installed_empty": -8, "store": 3,
}
NO_ENTITY_CEILING = 79
OVERALL_FLOOR, OVERALL_CEILING = 8, 94
ANSWER_WEIGHTS = {
    "schema_pages": 18, "organization": 16, "faq_schema": 30,
    "three_question_headings": 18, "one_question_heading": 9, "three_types": 18,
}
ORGANIC_WEIGHTS = {
    "meta_share": 30, "home_title": 22, "alt_share": 18, "breadcrumb": 14,
    "https": 8, "viewport": 8,
}
LOCAL_WEIGHTS = {
    "complete_local_entity": 45, "local_type_only": 20, "organization": 18,
    "open_graph": 12, "breadcrumb": 8, "not_stale": 12,
}
MANY_QUESTIONS = 3
MANY_TYPES = 3
MOST_PAGES_SHARE = 0.8
ALT_SHARE = 0.8
TITLE_MIN_CHARS = 15
GENERIC_TITLE = r"(?i)^home\z|^untitled"
STALE_AFTER_YEARS = 2
GRADES = [("A", 90), ("B", 80), ("C", 70), ("D", 60)]
GRADE_LOWEST = "F"
GRADE_COLORS = [(60, "#e2735a"), (70, "#e0935a"), (80, "#e0c05a"), (90, "#8fb89a")]
GRADE_COLOR_TOP, GRADE_COLOR_MISSING = "#7fd0a8", "#e8a07a"
METER_COLORS = [(40, "#c0492a"), (70, "#c9952f")]
METER_COLOR_TOP = "#2f4a3e"
REFRESH_OFFER_PCT = 90

# --- model replies ----------------------------------------------------------------------
FENCE_OPEN = rf"(?i)^```json{WS}*"
FENCE_CLOSE = r"(?i)```\z"
# hedging words end a word, except the two that carry a space and need a word after it
HEDGE_WORDS = [
    "confirm", "verify", "likely", "consider", "probably", "possibly", "may ", "might ",
    "appears", "seems", "could be", "check (that|whether|if)", "not verified",
]
HEDGES = (
    rf"(?i){B_BEFORE}("
    + "|".join(w + (f"(?={WORD})" if w.endswith(" ") else B_END) for w in HEDGE_WORDS)
    + ")"
)
PRIORITY_LABELS = [("high", "Critical"), ("med", "Important")]
PRIORITY_LABEL_OTHER = "Polish"
PRIORITY_COLORS = [("high", "#c0492a"), ("med", "#c9952f")]
PRIORITY_COLOR_OTHER = "#4a6b5b"

# --- page speed -----------------------------------------------------------------------------
TIMED_OUT_SCORE = 20
SPEED_FAST, SPEED_MIDDLING = 90, 50
SPEED_TIMED_OUT_TEXT = (
    "Slow — the page didn't finish loading within 40 seconds on mobile, so Google's speed "
    "test couldn't complete. A page that can't be measured in time is a page real visitors "
    "abandon; a modern rebuild loads near-instantly."
)
SPEED_LCP_TEXT = (" Its largest element takes ", " to appear on mobile.")
SPEED_FAST_TEXT = (
    "Fast — the page loads quickly on mobile, so speed isn't costing you visitors.", "")
SPEED_MIDDLING_TEXT = (
    "Middling — there's real lag on mobile.",
    " Faster pages hold more visitors and Google rewards them.")
SPEED_SLOW_TEXT = (
    "Slow — this is actively costing you visitors and search rankings.",
    " Most people abandon a page that takes more than 3 seconds; a modern rebuild loads "
    "near-instantly.")

# --- request guard ------------------------------------------------------------------------------
# kind -> (soft limit, window in seconds, daily cap)
GUARD_LIMITS = {
    "audit": (8, 20 * 60, 20),
    "deep": (3, 30 * 60, 6),
    "page": (10, 20 * 60, 30),
}
DAILY_STATE_TTL_SECONDS = 90_000
UNKNOWN_IP = "0.0.0.0"
SRC_CHARS, UA_CHARS = 300, 160

# --- leads and intake -------------------------------------------------------------------------------
EMAIL = rf"^[^{WS_CHARS}@]+@[^{WS_CHARS}@]+\.[^{WS_CHARS}@]+\z"
EMAIL_CHARS = 200
LEAD_CHARS = {
    "name": 120, "email": 200, "business": 200, "works": 1000, "broken": 1000,
    "budget": 60,
}
BLANK = "(blank)"
INTAKE_DEFAULT_BUSINESS = "a client"
INTAKE_BUSINESS_CHARS = 120
INTAKE_HEADING_DEFAULT = "your business"
INTAKE_SLUG_DEFAULT = "intake"
