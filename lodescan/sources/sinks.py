"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .upserts import latest

LEAD_KEYS = ["received_at", "email"]


def write_audits(payload: DataFrame, path: str, run: str) -> None:
    """Nested audit records of one run as JSON, one folder per tier.

    A repeated run replaces all its rows, also those of sites whose tier has changed since.
    """
    payload.write.mode("overwrite").partitionBy("tier").json(f"{path}/run={run}")


def deep_payload(pages: DataFrame) -> DataFrame:
    """Page records per site in crawl order; a site has at most one crawl budget of them."""
    record = F.struct("crawl_rank", "url", "title", "role", "findings")
    ordered = F.array_sort(
        F.collect_list(record),
        lambda a, b: a["crawl_rank"] - b["crawl_rank"],
    )
    return pages.groupBy("site_key").agg(
        F.transform(
            ordered,
            lambda p: F.struct(
                p["url"].alias("url"), p["title"].alias("title"),
                p["role"].alias("role"), p["findings"].alias("findings"),
            ),
        ).alias("pages")
    )


def write_deep(payload: DataFrame, path: str, run: str) -> None:
    """Deep reports of one run, replaced when it is repeated."""
    payload.write.mode("overwrite").parquet(f"{path}/run={run}")


def append_leads(leads: DataFrame, path: str) -> None:
    leads.write.mode("append").parquet(path)


def latest_leads(leads: DataFrame) -> DataFrame:
    """Last write wins for each (received_at, email), by ``lead_id`` as arrival order."""
    return latest(leads, LEAD_KEYS, "lead_id")
