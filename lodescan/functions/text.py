"""Text helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import WS, WS_ASCII_RUN, WS_BEYOND_ASCII


def trim_ws(text: Column) -> Column:
    """Trim every kind of white space, not only the blank that ``trim`` removes."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def collapse_ws(text: Column) -> Column:
    """One blank for each run of white space, none at the ends.

    Most text has ASCII white space only and takes a pattern that skips single blanks.
    """
    collapsed = F.when(
        text.rlike(WS_BEYOND_ASCII), F.regexp_replace(text, f"{WS}+", " ")
    ).otherwise(F.regexp_replace(text, WS_ASCII_RUN, " "))
    return F.trim(collapsed)


def mentions(text: Column, *literals: str) -> Column:
    """Whether any of the lower-case ASCII literals occurs, in any case; never null.

    A byte search on the lower-cased text, several times faster than a pattern.
    """
    lowered = F.lower(text)
    hit = lowered.contains(literals[0])
    for literal in literals[1:]:
        hit = hit | lowered.contains(literal)
    return F.coalesce(hit, F.lit(False))


def found_near(text: Column, pattern: str, *literals: str) -> Column:
    """``found``, trying the pattern only where one of its literals occurs."""
    return mentions(text, *literals) & found(text, pattern)


def count_near(text: Column, pattern: str, *literals: str) -> Column:
    """``count_matches``, trying the pattern only where one of its literals occurs."""
    return F.when(mentions(text, *literals), count_matches(text, pattern)).otherwise(F.lit(0))


def found(text: Column, pattern: str) -> Column:
    """``rlike`` that is false, never null."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        F.array().cast("array<string>"),
    )


def strict_json(text: Column) -> Column:
    """The text as a variant if it is exactly one JSON value, else null.

    The parser stops after the first value. What may follow one value inside an array is an
    error inside an object, and the other way round, so both have to parse.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_object.isNotNull(), F.try_variant_get(in_array, "$[0]", "variant"))


def or_blank(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def choose(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """First matching case wins; keeps long ``when`` chains out of the callers."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    Keeps nested expressions from growing with every use of a sub-expression.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
