"""Intake forms as they are posted: one JSON text each, of unknown sections and questions.

The text is parsed to a variant and walked with ``variant_explode``, so a form may change its
sections and questions without a change here. What the reader of a form cannot make sense of
goes to a side table with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import choose, or_blank, strict_json, trim_ws

NOT_JSON, BAD_SECTION, BAD_ITEM = "not json", "bad section", "bad item"


def _kind(value: Column) -> Column:
    """STRING, BOOLEAN, VOID, ARRAY, OBJECT or a type of number; empty where there is none."""
    return or_blank(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def _is_list(value: Column) -> Column:
    return _kind(value) == "ARRAY"


def _is_given(value: Column) -> Column:
    """Neither missing nor null, false, zero or the empty text."""
    kind = _kind(value)
    return choose(
        [
            (kind.isin("", "VOID"), False),
            (kind == "STRING", F.try_variant_get(value, "$", "string") != ""),
            (kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")),
            (kind.isin("ARRAY", "OBJECT"), True),
        ],
        F.coalesce(F.try_variant_get(value, "$", "double") != 0, F.lit(True)),
    )


def _text(value: Column) -> Column:
    """A value as text: null is empty, a list is joined by commas, an object is its JSON."""
    elements = F.try_variant_get(value, "$", "array<string>")
    listed = F.array_join(F.transform(elements, or_blank), ",")
    return or_blank(F.when(_is_list(value), listed).otherwise(
        F.try_variant_get(value, "$", "string")
    ))


def _list(value: Column) -> Column:
    """Elements of a list, none of anything else."""
    elements = F.try_variant_get(value, "$", "array<variant>")
    return F.when(_is_list(value), elements).otherwise(F.array().cast("array<variant>"))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def read_posts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submission_id, body) to forms and to those that cannot be read.

    Forms are (submission_id, business_label, sections), sections a variant that is a list or
    null. Submissions that filled the hidden field are in neither. A form without a business or
    without sections is a form. Unreadable is: no JSON text (a null body too), a section or an
    item that is null, and items of a section that are given but no list. Those come as
    (submission_id, body, reason), whole. Ids may be null or repeat.
    """
    root = F.col("root")
    parsed = posts.select("submission_id", "body", strict_json(F.col("body")).alias("root"))
    read = parsed.select(
        "submission_id", "body", root.isNull().alias("no_json"),
        _is_given(_field(root, "hp")).alias("bot"),
        _field(root, "business").alias("business"), _field(root, "sections").alias("sections"),
    )

    def bad_section(section: Column) -> Column:
        items = _field(section, "items")
        return (_kind(section) == "VOID") | (_is_given(items) & ~_is_list(items))

    def bad_item(section: Column) -> Column:
        return F.exists(_list(_field(section, "items")), lambda i: _kind(i) == "VOID")

    sections = F.col("sections")
    human = read.filter(F.col("no_json") | ~F.col("bot")).withColumn(
        "reason",
        F.when(F.col("no_json"), F.lit(NOT_JSON))
        .when(F.exists(_list(sections), bad_section), F.lit(BAD_SECTION))
        .when(F.exists(_list(sections), bad_item), F.lit(BAD_ITEM)),
    )
    label = trim_ws(F.left(_text(F.col("business")), F.lit(V.INTAKE_BUSINESS_CHARS)))
    named = _is_given(F.col("business")) & (label != "")
    forms = human.filter(F.col("reason").isNull()).select(
        "submission_id",
        F.when(named, label).otherwise(F.lit(V.INTAKE_DEFAULT_BUSINESS)).alias("business_label"),
        F.when(_is_list(sections), sections).alias("sections"),
    )
    unread = human.filter(F.col("reason").isNotNull()).select("submission_id", "body", "reason")
    return forms, unread


def posted_answers(forms: DataFrame) -> DataFrame:
    """One row per item, in the order posted.

    A form without sections and a section without items keep one row of nulls. Of an item that
    is no object, question and answer are empty.
    """
    explode = forms.sparkSession.tvf.variant_explode_outer
    section, item = F.col("section_value"), F.col("item_value")
    sections = forms.lateralJoin(explode(F.col("sections").outer()).select(
        F.col("pos").alias("section_no"), F.col("value").alias("section_value")
    )).select(
        "submission_id", "business_label", "section_no",
        F.when(F.col("section_no").isNotNull(), _text(_field(section, "name"))).alias("section"),
        F.when(_is_list(_field(section, "items")), _field(section, "items")).alias("items"),
    )
    return sections.lateralJoin(explode(F.col("items").outer()).select(
        "pos", F.col("value").alias("item_value")
    )).select(
        "submission_id", "business_label", "section_no", "section", "pos",
        F.when(F.col("pos").isNotNull(), _text(_field(item, "q"))).alias("q"),
        F.when(F.col("pos").isNotNull(), _text(_field(item, "v"))).alias("v"),
    )
