"""Exact machine-readability signals of one page, as column expressions over its html."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import (
    all_matches, choose, collapse_ws, count_near, found_near, let, mentions, strict_json,
    trim_ws,
)


def strip_to_text(html: Column) -> Column:
    text = F.regexp_replace(html, V.SCRIPT_ELEMENT, " ")
    text = F.regexp_replace(text, V.STYLE_ELEMENT, " ")
    return let(F.regexp_replace(text, V.ANY_TAG, " "), collapse_ws)


def page_title(html: Column) -> Column:
    return F.coalesce(trim_ws(F.regexp_extract(html, V.TITLE, 1)), F.lit(""))


def ld_json_blocks(html: Column) -> Column:
    none = F.array().cast("array<string>")
    blocks = all_matches(html, V.LD_JSON_BLOCK, 1)
    return F.when(mentions(html, V.LD_JSON_MENTION), blocks).otherwise(none)


def page_has_schema_block(html: Column) -> Column:
    return F.size(ld_json_blocks(html)) > 0


# a string, or an array whose strings may hold any bracket
TYPE_LITERAL = r'"@type"\s*:\s*("(?:[^"\\]|\\.)*+"|\[(?:[^\]"]|"(?:[^"\\]|\\.)*+")*+\])'


def schema_types_in_blocks(blocks: Column) -> Column:
    """Every ``@type`` at any depth of the blocks that parse, without repeats.

    An empty name is no type, unless it stands in an array of names. Of a key repeated in one
    object the last counts; writing the parsed block again drops the others.
    """

    def without_repeats(block: Column) -> Column:
        again = F.to_json(F.try_parse_json(block))
        return F.when(block.rlike(r'(?s)"@type".*"@type"'), again).otherwise(block)

    valid = F.transform(F.filter(blocks, lambda b: strict_json(b).isNotNull()), without_repeats)
    literals = F.filter(
        F.flatten(F.transform(valid, lambda b: all_matches(b, TYPE_LITERAL, 1))),
        lambda t: t != '""',
    )
    # an array literal is decoded as it is, a string literal as an array of one
    names = F.flatten(
        F.transform(
            literals,
            lambda t: F.coalesce(
                F.from_json(
                    F.when(t.startswith("["), t).otherwise(
                        F.concat(F.lit("["), t, F.lit("]"))
                    ),
                    "array<string>",
                ),
                F.array().cast("array<string>"),
            ),
        )
    )
    return F.array_distinct(F.array_compact(names))


def schema_types_tree(html: Column) -> Column:
    return schema_types_in_blocks(ld_json_blocks(html))


def schema_types_regex(html: Column) -> Column:
    """Distinct scalar ``"@type":"X"`` anywhere in the page, in order of appearance."""
    none = F.array().cast("array<string>")
    names = all_matches(html, V.TYPE_LITERAL_CI, 1)
    return F.when(mentions(html, '"@type"'), F.array_distinct(names)).otherwise(none)


def has_schema_mention(html: Column) -> Column:
    return mentions(html, V.LD_JSON_MENTION)


def any_type(types: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(types, lambda t: t.rlike(pattern)), F.lit(False))


def has_faq_type(types: Column) -> Column:
    return any_type(types, V.FAQ_PAGE_TYPE)


def has_menu_type(types: Column) -> Column:
    return any_type(types, V.MENU_TYPES)


def has_meta_description(html: Column) -> Column:
    return found_near(html, V.META_DESCRIPTION, "<meta")


def img_count(html: Column) -> Column:
    return count_near(html, V.IMG_TAG, "<img")


def img_with_alt(html: Column) -> Column:
    tags = F.filter(all_matches(html, V.IMG_TAG, 0), lambda t: t.rlike(V.ALT_ATTRIBUTE))
    return F.when(mentions(html, "<img"), F.size(tags)).otherwise(F.lit(0))


def has_viewport(html: Column) -> Column:
    return found_near(html, V.VIEWPORT, "viewport")


def has_og(html: Column) -> Column:
    return found_near(html, V.OPEN_GRAPH, "og:")


def has_breadcrumb(html: Column) -> Column:
    return mentions(html, V.BREADCRUMB)


def has_commerce_platform(html: Column) -> Column:
    return mentions(html, *V.COMMERCE_PLATFORMS)


def product_evidence(html: Column) -> Column:
    links = F.least(
        count_near(html, V.PRODUCT_LINK, "/product", "/shop/"), F.lit(V.PRODUCT_LINK_CAP)
    )
    types = count_near(html, V.PRODUCT_TYPE, '"product"')
    return types + count_near(html, V.ADD_TO_CART, "cart") + links


def retail_hint(html: Column) -> Column:
    return F.coalesce(html.rlike(V.RETAIL_WORDS), F.lit(False))


def platform(html: Column) -> Column:
    return choose([(mentions(html, *words), name) for name, words in V.PLATFORMS], V.PLATFORM_UNKNOWN)


def has_geo(html: Column) -> Column:
    return found_near(html, V.GEO, '"geo"', "geocoordinates")


def has_faqpage_markup(html: Column) -> Column:
    return found_near(html, V.FAQ_PAGE_MARKUP, "faqpage")


def has_property(html: Column, name: str) -> Column:
    """Whether the page's markup holds a property from the fixed list, by its pattern."""
    return found_near(html, dict(V.SCHEMA_PROPERTIES)[name], name.lower())


def question_heading_count(html: Column) -> Column:
    def text(heading: Column) -> Column:
        return collapse_ws(F.regexp_replace(heading, V.ANY_TAG, " "))

    headings = all_matches(html, V.HEADING_2_TO_4, 1)
    questions = F.size(F.filter(headings, lambda h: text(h).endswith("?")))
    return F.when(mentions(html, "<h2", "<h3", "<h4"), questions).otherwise(F.lit(0))


def form_count(html: Column) -> Column:
    return count_near(html, V.FORM_TAG, "<form")


def field_count(html: Column) -> Column:
    return count_near(html, V.FIELD_TAG, "<input", "<textarea", "<select")


def is_form_page(html: Column) -> Column:
    return found_near(html, V.FORM_TAG, "<form") & (field_count(html) >= V.FORM_PAGE_FIELDS)


def has_mailto(html: Column) -> Column:
    return found_near(html, V.MAILTO, "mailto:")


def has_tel(html: Column) -> Column:
    return found_near(html, V.TEL, "tel:")


def has_canonical(html: Column) -> Column:
    return found_near(html, V.CANONICAL, "canonical")


def has_noindex(html: Column) -> Column:
    return found_near(html, V.NOINDEX, "noindex")


def newest_year(text: Column) -> Column:
    """Latest year 2010-2029 in visible text that is no price, decimal or longer number."""
    years = all_matches(text, V.CALENDAR_YEAR, 1)
    return F.array_max(F.transform(years, lambda y: y.cast("int")))


def link_hrefs(html: Column) -> Column:
    return all_matches(html, V.ANCHOR_HREF, 1)


def sitemap_locs(xml: Column) -> Column:
    return all_matches(xml, V.SITEMAP_LOC, 1)
