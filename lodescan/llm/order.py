"""Global order: stored in sorted parts, numbered without a group in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

# a place is the number of its part and, in the low bits, that of the row in the part
ROW_BITS = 33


def in_order(df: DataFrame, order: list[str], label: str, place: str = "place") -> DataFrame:
    """Store ``df`` sorted by ``order``, nulls first, with the ``place`` of every row.

    Parts are ranges of all of ``order``, so a hot leading key is shared by many of them.
    Columns of ``order`` should be cheap: the ranges are drawn from a first pass over them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn(place, F.monotonically_increasing_id()), label)


def numbered(placed: DataFrame, groups: list[str], label: str, place: str = "place") -> DataFrame:
    """Replace ``place`` by ``pos``, from 0 within each group, and add ``n``, the group's rows.

    Rows of a group are neighbours in every part. Rows per group and part are counted and
    added up over the parts; a window holds as many rows as there are parts at most.
    """
    part = F.shiftright(place, ROW_BITS)
    counts = placed.groupBy(*groups, part.alias("part")).agg(
        F.count("*").alias("rows"), F.min(place).alias("first")
    )
    group = Window.partitionBy(*groups)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        counts.select(
            *[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("of_part"), "first",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
            F.sum("rows").over(group).alias("n"),
        ),
        label,
    )
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups] + [part == F.col("of_part")]
    return placed.join(starts, reduce(and_, same)).select(
        *[c for c in placed.columns if c != place],
        (F.col("start") + F.col(place) - F.col("first")).alias("pos"), "n",
    )
