"""Lead validation, coercion and summaries; all map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import choose, or_blank, trim_ws


def valid_email(text: Column) -> Column:
    """Trimmed address if it looks like one, else null."""
    trimmed = trim_ws(text)
    return F.when(trimmed.rlike(V.EMAIL), F.left(trimmed, F.lit(V.EMAIL_CHARS)))


def is_complete() -> Column:
    return F.coalesce((F.col("name") != "") & (F.col("email") != ""), F.lit(False))


def shortened(leads: DataFrame, chosen: Column | None = None) -> DataFrame:
    """Leads as they are stored: long fields cut, blanks for nulls; of ``chosen`` rows only."""
    values = {
        **{name: F.left(or_blank(F.col(name)), F.lit(n)) for name, n in V.LEAD_CHARS.items()},
        "url": or_blank(F.col("url")),
        "tier": or_blank(F.col("tier")),
        "score": or_blank(F.col("score")),
        "mockup": F.coalesce(F.col("mockup"), F.lit(False)),
    }
    if chosen is None:
        return leads.withColumns(values)
    return leads.withColumns({
        name: F.when(chosen, value).otherwise(F.col(name)) for name, value in values.items()
    })


def validate_leads(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): name and email are required, long fields are cut."""
    return shortened(leads.filter(is_complete())), leads.filter(~is_complete())


def lead_summary(leads: DataFrame) -> DataFrame:
    """Readable fields and body text of accepted leads.

    A score is plain text, or a JSON object with grade and pct.
    """

    def or_mark(name: str) -> Column:
        return F.when(F.col(name) == "", F.lit(V.BLANK)).otherwise(F.col(name))

    grade = F.get_json_object("score", "$.grade")
    pct = F.get_json_object("score", "$.pct")
    graded = F.col("score").startswith("{") & (or_blank(grade) != "")
    named = leads.withColumns(
        {
            "score_text": choose(
                [(graded, F.concat(grade, F.lit(" ("), or_blank(pct), F.lit("%)")))], F.col("score")
            ),
            "works_text": or_mark("works"),
            "broken_text": or_mark("broken"),
            "mockup_text": F.when(F.col("mockup"), F.lit("YES")).otherwise(F.lit("no")),
            "headline": F.concat(
                F.when(F.col("business") == "", F.col("name")).otherwise(F.col("business")),
                F.lit(" ("), "tier", F.lit(")"),
            ),
        }
    )
    lines = [
        ("Name", "name"), ("Email", "email"), ("Business", "business"), ("Site", "url"),
        ("Tier", "tier"), ("Score", "score_text"), ("Budget", "budget"),
        ("Mockup", "mockup_text"), ("Working", "works_text"), ("Not working", "broken_text"),
    ]
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in lines])
    return named.withColumn("body", body)
