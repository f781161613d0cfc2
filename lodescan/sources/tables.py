"""Page and tier sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.urls import Url


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages that were fetched, are html and are not empty.

    ``status`` and ``content_type`` are honoured when the table carries them.
    """
    usable = pages.filter(F.col("html") != "")
    if "status" in pages.columns:
        usable = usable.filter(F.col("status").between(200, 299))
    if "content_type" in pages.columns:
        usable = usable.filter(F.col("content_type").contains("text/html"))
    return usable


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return usable_pages(spark.read.parquet(path))


def page_index(pages: DataFrame) -> DataFrame:
    """Narrow address columns of every page; the html is not read. A store's bucket comes along."""
    url = Url(F.col("url"))
    bucket = [c for c in pages.columns if c == "bucket"]
    return pages.select(
        "page_id",
        "url",
        url.site.alias("site_key"),
        url.origin.alias("origin"),
        url.key.alias("page_key"),
        *bucket,
    )


TIER_SCHEMA = (
    "array<struct<tier:string,quote_name:string,enterprise:boolean,typical:array<string>,"
    "photo:string,"
    "phases:array<struct<phase:string,price:int,what:string,who:string>>>>"
)


def tier_definitions(spark: SparkSession) -> DataFrame:
    """One row per size tier with its phases: a constant of four rows."""
    rows = [
        {
            "tier": tier, "quote_name": name, "enterprise": enterprise, "typical": typical,
            "photo": photo,
            "phases": [
                {"phase": phase, "price": price, "what": what, "who": who}
                for owner, phase, price, what, who in V.PHASES
                if owner == tier
            ]
            or None,
        }
        for tier, name, enterprise, typical, photo in V.TIERS
    ]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), TIER_SCHEMA)))


def tier_phases(spark: SparkSession) -> DataFrame:
    """One row per tier and phase: a constant of eight rows."""
    return tier_definitions(spark).select("tier", F.inline("phases"))
