"""Request attribution and the same-origin check; map-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import or_blank
from ..functions.urls import Url


def place(city: Column, region: Column, country: Column) -> Column:
    """Non-blank parts joined by commas."""
    return F.concat_ws(", ", *[F.nullif(part, F.lit("")) for part in (city, region, country)])


def request_meta(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "owner_run": F.coalesce(F.col("bypass"), F.lit(False)),
            "where": place(F.col("city"), F.col("region"), F.col("country")),
            "org": or_blank(F.col("org")),
            "ip": or_blank(F.col("ip")),
            "src": F.left(or_blank(F.col("src")), F.lit(V.SRC_CHARS)),
            "ua": F.left(or_blank(F.col("ua")), F.lit(V.UA_CHARS)),
        }
    )


def origin_matches(origin: Column, host: Column) -> Column:
    """Whether the Origin header names the serving host, port included."""
    return F.coalesce(Url(origin).authority == F.lower(host), F.lit(False))


def passes_origin() -> Column:
    """Whether a request comes from its own host or has the bypass flag."""
    return F.coalesce(F.col("bypass"), F.lit(False)) | origin_matches(
        F.col("origin"), F.col("host")
    )


def split_by_origin(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); requests with the bypass flag are never rejected."""
    passes = passes_origin()
    return log.filter(passes), log.filter(~passes)
