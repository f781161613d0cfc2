"""Sitemap files as a table of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.html import sitemap_locs
from ..functions.text import choose, found
from ..functions.urls import Url, is_asset, is_low_value_path
from ..session import materialize


def sitemap_files(sitemaps: DataFrame) -> DataFrame:
    """One narrow row per stored file of (origin, path, xml): its addresses, not its text."""
    xml = F.col("xml")
    priority = choose(
        [(F.col("path") == p, i) for i, p in enumerate(V.SITEMAP_PATHS)],
        F.lit(None).cast("int"),
    )
    return sitemaps.filter(xml != "").select(
        "origin",
        "path",
        Url(F.concat("origin", "path")).href.alias("file_url"),
        F.when(found(xml, V.SITEMAP_ROOT), priority).alias("priority"),
        found(xml, V.SITEMAP_INDEX).alias("is_index"),
        sitemap_locs(xml).alias("locs"),
    )


def choose_sitemaps(files: DataFrame) -> DataFrame:
    """First usable file of each origin, in the order the well-known paths are tried.

    The path is chosen without its addresses, which join it afterwards.
    """
    first = (
        files.filter(F.col("priority").isNotNull())
        .groupBy("origin")
        .agg(F.min_by("path", "priority").alias("path"))
    )
    return files.select("origin", "path", "is_index", "locs").join(first, ["origin", "path"])


def child_sitemaps(chosen: DataFrame) -> DataFrame:
    """The child files an index is read for: best four by kind, then by position."""

    def ranked(loc, pos):
        name = F.lower(loc)
        kinds = [(name.contains(word), rank) for word, rank in V.CHILD_SITEMAP_RANK]
        rank = choose(kinds, V.CHILD_SITEMAP_OTHER_RANK)
        return F.when(loc.rlike(V.SITEMAP_FILE), F.struct(rank.alias("rank"), pos.alias("pos"), loc.alias("loc")))

    ordered = F.array_sort(F.array_compact(F.transform("locs", ranked)))
    return (
        chosen.filter("is_index")
        .select("origin", F.posexplode(F.slice(ordered, 1, V.CHILD_SITEMAPS)).alias("file_no", "child"))
        .select("origin", "file_no", F.col("child.rank").alias("kind_rank"), F.col("child.loc").alias("child_url"))
    )


def read_children(files: DataFrame, children: DataFrame) -> DataFrame:
    """Child files in reading order, up to the one that crosses the address limit."""
    wanted = children.withColumn("file_url", Url(F.col("child_url")).href)
    by_url = files.select("file_url", "locs")
    earlier = Window.partitionBy("origin").orderBy("file_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        wanted.join(by_url, "file_url")
        .withColumn("before", F.coalesce(F.sum(F.size("locs")).over(earlier), F.lit(0)))
        .filter(F.col("before") <= V.CHILD_SITEMAP_STOP_AFTER)
    )


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(origin, file_no, pos, loc): every address the sitemap of an origin contributes."""
    files = materialize(sitemap_files(sitemaps), "sitemap-files")  # the text is read once
    chosen = choose_sitemaps(files)
    direct = chosen.filter(~F.col("is_index")).select(
        "origin", F.lit(0).alias("file_no"), F.posexplode("locs").alias("pos", "loc")
    )
    children = read_children(files, child_sitemaps(chosen))
    nested = children.select("origin", "file_no", F.posexplode("locs").alias("pos", "loc"))
    return direct.unionByName(nested)


def sitemap_totals(urls: DataFrame) -> DataFrame:
    """Content addresses per origin; tag, category, author and feed paths do not count."""
    path = Url(F.col("loc")).path
    return urls.groupBy("origin").agg(
        F.count_if(~is_low_value_path(path)).cast("bigint").alias("sitemap_total")
    )


def sitemap_seeds(urls: DataFrame) -> DataFrame:
    """Addresses a crawl may start from: on the origin's own site and no asset."""
    loc = Url(F.col("loc"))
    return urls.filter(
        (loc.site == Url(F.col("origin")).site) & ~is_asset(loc.path)
    ).select("origin", "file_no", "pos", loc.key.alias("page_key"), loc.href.alias("url"))
