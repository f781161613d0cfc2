"""Project intake forms: collected sections, long rows and a document per submission.

A submission is one row with nested answers, so every step works inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import or_blank, trim_ws

ITEM = "struct<q:string,v:string>"
SECTION = f"struct<name:string,items:array<{ITEM}>>"


def text_answer(question: str, value: Column) -> Column:
    """Free text or the value of a checked radio button; blank answers become null."""
    text = trim_ws(or_blank(value))
    return F.when(text != "", _item(F.lit(question), text))


def choice_answer(question: str, picked: Column) -> Column:
    """Multiple choice: an array of the ticked values."""
    return F.when(F.size(picked) > 0, _item(F.lit(question), F.array_join(picked, ", ")))


def faq_answer(number: int, question: Column, answer: Column) -> Column:
    """A question with an optional answer; without a question there is no item."""
    q, a = trim_ws(or_blank(question)), trim_ws(or_blank(answer))
    reply = F.when(a != "", F.concat(F.lit(" — "), a)).otherwise(F.lit(""))
    return F.when(q != "", _item(F.lit(f"FAQ {number}"), F.concat(q, reply)))


def _item(q: Column, v: Column) -> Column:
    return F.struct(q.alias("q"), v.alias("v"))


def collect_sections(layout: list[tuple[str, list[Column]]]) -> Column:
    """Answered items per form section; sections without any answer are left out.

    ``layout`` lists the sections in form order with their answer columns.
    """
    sections = [
        F.struct(F.lit(name).alias("name"), F.array_compact(F.array(*answers)).alias("items"))
        for name, answers in layout
    ]
    return F.filter(F.array(*sections), lambda s: F.size(s["items"]) > 0)


def filter_honeypot(submissions: DataFrame) -> DataFrame:
    """Drop submissions that filled the hidden field; give the rest a business name."""
    human = submissions.filter(or_blank(F.col("hp")) == "")
    given = or_blank(F.col("business"))
    given = F.when(given == "", F.lit(V.INTAKE_DEFAULT_BUSINESS)).otherwise(given)
    cut = trim_ws(F.left(given, F.lit(V.INTAKE_BUSINESS_CHARS)))
    label = F.when(cut == "", F.lit(V.INTAKE_DEFAULT_BUSINESS)).otherwise(cut)
    return human.withColumn("business_label", label)


def intake_flatten(submissions: DataFrame) -> DataFrame:
    """One row per answer; a submission without answers keeps one row of nulls."""
    sections = submissions.select(
        "submission_id", "business_label", F.posexplode_outer("sections").alias("section_no", "s")
    )
    return sections.select(
        "submission_id", "business_label", "section_no", F.col("s.name").alias("section"),
        F.posexplode_outer("s.items").alias("pos", "item"),
    ).select(
        "submission_id", "business_label", "section_no", "section", "pos",
        F.col("item.q").alias("q"), F.col("item.v").alias("v"),
    )


def intake_markdown(submissions: DataFrame) -> DataFrame:
    """The submission as a document and the name to store it under."""
    business = trim_ws(or_blank(F.col("business")))
    heading = F.when(business == "", F.lit(V.INTAKE_HEADING_DEFAULT)).otherwise(business)
    slug_source = F.when(business == "", F.lit(V.INTAKE_SLUG_DEFAULT)).otherwise(business)

    def section_text(s: Column) -> Column:
        items = F.transform(
            s["items"], lambda i: F.concat(F.lit("- **"), i["q"], F.lit(":** "), i["v"])
        )
        return F.concat(F.lit("## "), s["name"], F.lit("\n"), F.array_join(items, "\n"), F.lit("\n"))

    parts = F.concat(
        F.array(F.concat(F.lit("# Project Intake — "), heading, F.lit("\n"))),
        F.transform("sections", section_text),
    )
    return submissions.select(
        "submission_id",
        F.lower(F.regexp_replace(slug_source, "(?i)[^a-z0-9]+", "-")).alias("slug"),
        F.array_join(parts, "\n").alias("document"),
    )
