"""Tier, scores, grades and display bands as column expressions over site signals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import choose, found


def classify(pages: Column, has_store: Column) -> Column:
    bounds = [(pages <= upper, tier) for tier, upper in V.TIER_PAGE_BOUNDS]
    return choose([(has_store, V.TIER_STORE), *bounds], V.TIER_ENTERPRISE)


def _points(condition: Column, weight: int) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0))


def _two_steps(value: Column, many: int, high: int, low: int) -> Column:
    return choose([(value >= many, high), (value >= 1, low)], 0)


def _total(parts: list[Column]) -> Column:
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def _good_title() -> Column:
    title = F.col("home_title")
    return (F.length(title) >= V.TITLE_MIN_CHARS) & ~found(title, V.GENERIC_TITLE)


def _clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def overall_score() -> Column:
    w = V.OVERALL_WEIGHTS
    c = F.col
    alt_ok = (c("home_img_count") == 0) | (
        c("home_img_with_alt") / F.greatest(c("home_img_count"), F.lit(1)) >= V.ALT_SHARE
    )
    meta = choose(
        [
            (c("pages_with_meta") >= c("page_count") * F.lit(V.MOST_PAGES_SHARE),
             w["meta_on_most_pages"]),
            (c("pages_with_meta") > 0, w["meta_on_some_pages"]),
        ],
        0,
    )
    deep_schema = (c("pages_with_schema") > 0) & (F.size("schema_types") >= V.MANY_TYPES)
    total = _total(
        [
            _points(c("has_organization"), w["organization"]),
            _points(c("complete_local_entity"), w["complete_local_entity"]),
            _points(c("has_faq_schema"), w["faq_schema"]),
            _two_steps(c("question_headings"), V.MANY_QUESTIONS,
                       w["three_question_headings"], w["one_question_heading"]),
            _points(deep_schema, w["schema_depth"]),
            meta,
            _points(_good_title(), w["home_title"]),
            _points(c("has_breadcrumb"), w["breadcrumb"]),
            _points(alt_ok, w["alt_text"]),
            _points(c("is_https"), w["https"]),
            _points(c("has_viewport"), w["viewport"]),
            _points(c("has_og"), w["open_graph"]),
            _points(~c("looks_stale"), w["not_stale"]),
            _points(c("commerce_state") == "installed_empty", w["installed_empty"]),
            _points(c("commerce_state") == "store", w["store"]),
        ]
    )
    gated = F.when(c("has_entity_graph"), total).otherwise(
        F.least(total, F.lit(V.NO_ENTITY_CEILING))
    )
    return _clamp(gated, V.OVERALL_FLOOR, V.OVERALL_CEILING)


def letter_grade(pct: Column) -> Column:
    return choose([(pct >= lower, grade) for grade, lower in V.GRADES], V.GRADE_LOWEST)


def answer_score() -> Column:
    w = V.ANSWER_WEIGHTS
    c = F.col
    return _clamp(
        _total(
            [
                _points(c("pages_with_schema") > 0, w["schema_pages"]),
                _points(c("has_organization"), w["organization"]),
                _points(c("has_faq_schema"), w["faq_schema"]),
                _two_steps(c("question_headings"), V.MANY_QUESTIONS,
                           w["three_question_headings"], w["one_question_heading"]),
                _points(F.size("schema_types") >= V.MANY_TYPES, w["three_types"]),
            ]
        ),
        0,
        100,
    )


def organic_score() -> Column:
    """The shares make this a double; the summands keep their order for equal rounding."""
    w = V.ORGANIC_WEIGHTS
    c = F.col
    meta_share = c("pages_with_meta") / F.greatest(c("page_count"), F.lit(1))
    alt_share = F.when(c("home_img_count") == 0, F.lit(1.0)).otherwise(
        c("home_img_with_alt") / F.greatest(c("home_img_count"), F.lit(1))
    )
    total = _total(
        [
            meta_share * w["meta_share"],
            _points(_good_title(), w["home_title"]),
            alt_share * w["alt_share"],
            _points(c("has_breadcrumb"), w["breadcrumb"]),
            _points(c("is_https"), w["https"]),
            _points(c("has_viewport"), w["viewport"]),
        ]
    )
    return _clamp(round_half_up(total).cast("int"), 0, 100)


def local_score() -> Column:
    w = V.LOCAL_WEIGHTS
    c = F.col
    entity = choose(
        [
            (c("complete_local_entity"), w["complete_local_entity"]),
            (c("has_local_business"), w["local_type_only"]),
        ],
        0,
    )
    return _clamp(
        _total(
            [
                entity,
                _points(c("has_organization"), w["organization"]),
                _points(c("has_og"), w["open_graph"]),
                _points(c("has_breadcrumb"), w["breadcrumb"]),
                _points(~c("looks_stale"), w["not_stale"]),
            ]
        ),
        0,
        100,
    )


def grade_color(pct: Column) -> Column:
    bands = [(pct < upper, color) for upper, color in V.GRADE_COLORS]
    return choose([(pct.isNull(), V.GRADE_COLOR_MISSING), *bands], V.GRADE_COLOR_TOP)


def meter_value(value: Column) -> Column:
    rounded = round_half_up(F.coalesce(value, F.lit(0))).cast("int")
    return _clamp(rounded, 0, 100)


def meter_color(value: Column) -> Column:
    return choose([(value < u, color) for u, color in V.METER_COLORS], V.METER_COLOR_TOP)


def offer_kind(enterprise: Column, pct: Column) -> Column:
    refresh = F.coalesce(pct >= V.REFRESH_OFFER_PCT, F.lit(False))
    return choose([(enterprise, "call"), (refresh, "refresh")], "phase_1")


def priority_label(priority: Column) -> Column:
    return choose([(priority == p, label) for p, label in V.PRIORITY_LABELS], V.PRIORITY_LABEL_OTHER)


def priority_color(priority: Column) -> Column:
    return choose([(priority == p, color) for p, color in V.PRIORITY_COLORS], V.PRIORITY_COLOR_OTHER)
