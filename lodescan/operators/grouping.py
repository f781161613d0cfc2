"""Group-wise building blocks that hold up when one group owns most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

# rows of one group that a single task may number at a time
NUMBERING_BLOCK = 100_000


def compute_once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Select ``keep`` and the computed columns, each evaluated once per row.

    A plain projection is copied into every later filter and projection that uses it, and
    long expressions multiply. A one-row generator stops that and stays compiled code.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of every key, by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, "_first.*")


def top_per_group(
    df: DataFrame, groups: list[str], order: list[Column], limit: int, rank: str
) -> DataFrame:
    """Rank inside each group and keep ``limit`` rows.

    The limit is visible to the planner, which drops surplus rows before the shuffle, so a
    hot group sends at most ``limit`` rows per input partition.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def number_within(
    df: DataFrame, groups: list[str], unique_id: str, number: str, block: int = NUMBERING_BLOCK
) -> DataFrame:
    """Exact 1-based numbers inside each group, in the order of a unique integer column.

    The id range is cut into blocks, so that a group of any size is numbered by many
    tasks: rows per block are counted first, and each block starts where the counts of the
    earlier blocks end. Null is a group like any other.
    """
    blocked = df.withColumn("_block", F.expr(f"`{unique_id}` div {block}"))
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        blocked.groupBy(*groups, "_block")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    )
    keys = [*groups, "_block"]
    renamed = starts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_start")
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    inside = Window.partitionBy(*keys).orderBy(unique_id)
    return (
        blocked.join(renamed, reduce(and_, same))
        .withColumn(number, F.col("_start") + F.row_number().over(inside))
        .drop("_block", "_start", *[f"_of_{k}" for k in keys])
    )
