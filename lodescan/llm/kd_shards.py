"""K-d tree partitioning of documents into shards of near equal bytes.

Every node holds a number of shards. It is split along the dimension that is widest, by its
span against the whole table's, at the weighted quantile that gives each side the bytes of its
shards, until a node holds one. Quantiles are found by counting: a pass sums the bytes of up
to ``BINS`` value ranges per node, the range that holds the quantile is cut again, and once it
is a single value its rows are cut by their row number, so hot values split as well. Only sums
are shuffled; a level looks at all its nodes at once. Dimensions are numbers as they are, and
other values by a hash, which brings equal values together.

Rows: a null text has no bytes, null dimensions sort first, ids may be null or repeat (every
row gets a place of its own). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from ..operators.grouping import number_within
from ..session import materialize

SHARDS = 24
DIMENSIONS = ("lang", "source", "n_chars")
ROW_OVERHEAD = 8
BINS = 4096
# of a shard's bytes: a quantile need not be found closer
TOLERANCE = 1 / 2000
# rows number within the partition that wrote them, as monotonically_increasing_id does
ROW_BLOCK = 1 << 33


@dataclass
class Node:
    first: int  # shard
    shards: int
    axis: str = ""
    value: int = 0  # rows below it go left, and rows of it below ``row``
    row: int = 0
    sides: list["Node"] = field(default_factory=list)

    def choose(self) -> Column:
        """The first shard of the leaf a row falls into, as far as the tree is grown."""
        if not self.sides:
            return F.lit(self.first)
        at = F.col(self.axis)
        below = (at < self.value) | ((at == self.value) & (F.col("row") < self.row))
        return F.when(below, self.sides[0].choose()).otherwise(self.sides[1].choose())


@dataclass
class Search:
    """Where the quantile of a node lies: values from low to high, then rows of one value."""

    node: Node
    axis: str
    wanted: float  # bytes left of the cut
    low: int
    high: int
    before: int = 0
    value: int | None = None

    def key(self) -> Column:
        return F.col(self.axis if self.value is None else "row")

    def inside(self) -> Column:
        own = self.key().between(self.low, self.high)
        return own if self.value is None else own & (F.col(self.axis) == self.value)

    def cut(self, value: int, bytes_there: int) -> None:
        """Left of ``value``, or right of it where that is closer."""
        after = self.wanted - self.before > bytes_there / 2
        at = value + 1 if after else value
        if self.value is None:
            self.node.value, self.node.row = at, 0
        else:
            self.node.value, self.node.row = self.value, at
        self.node.axis = self.axis


def _coordinate(docs: DataFrame, name: str) -> Column:
    if isinstance(docs.schema[name].dataType, IntegralType):
        own = F.col(name).cast("long")
    else:
        own = F.pmod(F.xxhash64(name), F.lit(1 << 31))
    return F.when(F.col(name).isNull(), F.lit(-1)).otherwise(own).cast("long")


def _by_node(searches: list[Search], make) -> Column:
    picked = F.lit(None)
    for search in searches:
        picked = F.when(F.col("node") == search.node.first, make(search)).otherwise(picked)
    return picked


def _narrow(rows: DataFrame, searches: list[Search], tolerance: float) -> list[Search]:
    """One pass over the rows: the range of each search shrinks to one of its bins."""
    located = rows.filter(_by_node(searches, Search.inside)).select(
        "node", "size", "row", _by_node(searches, Search.key).alias("key"),
        _by_node(searches, lambda s: F.floor(
            (s.key() - s.low) / F.lit(max(1.0, (s.high - s.low + 1) / BINS))
        )).alias("bin"),
    )
    bins = located.groupBy("node", "bin").agg(
        F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"),
        F.min("row").alias("first_row"), F.max("row").alias("last_row"),
    )
    earlier = Window.partitionBy("node").orderBy("bin").rowsBetween(
        Window.unboundedPreceding, -1
    )
    wanted = _by_node(searches, lambda s: F.lit(s.wanted - s.before))
    holding = (
        bins.withColumn("before", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)))
        .filter((F.col("before") <= wanted) & (wanted <= F.col("before") + F.col("bytes")))
        .groupBy("node").agg(F.min(F.struct(
            "bin", "low", "high", "bytes", "before", "first_row", "last_row"
        )).alias("b"))
        .select("node", "b.*").collect()  # one row per node
    )
    open_searches = []
    by_node = {s.node.first: s for s in searches}
    for found in holding:
        search = by_node[found["node"]]
        search.before += found["before"]
        search.low, search.high = found["low"], found["high"]
        single = search.low == search.high
        if found["bytes"] <= tolerance:
            if search.wanted - search.before > found["bytes"] / 2:
                search.before += found["bytes"]
                search.low = search.high + 1
            search.cut(search.low, 1 << 62)
        elif single and search.value is None:
            search.value = search.low
            search.low, search.high = found["first_row"], found["last_row"]
            open_searches.append(search)
        elif single:
            search.cut(search.low, found["bytes"])
        else:
            open_searches.append(search)
    return open_searches


def _split_level(rows: DataFrame, root: Node, nodes: list[Node], axes: list[str],
                 spans: dict[str, int], tolerance: float) -> list[Node]:
    placed = rows.withColumn("node", root.choose())
    waiting = F.col("node").isin([n.first for n in nodes])
    stats = {
        r["node"]: r for r in placed.filter(waiting).groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[F.min(a).alias(f"{a}_low") for a in axes],
            *[F.max(a).alias(f"{a}_high") for a in axes],
        ).collect()  # one row per node
    }
    searches = []
    for node in nodes:
        left = node.shards // 2
        node.sides = [Node(node.first, left), Node(node.first + left, node.shards - left)]
        node.axis = axes[0]
        found = stats.get(node.first)
        if found is None:
            continue
        axis = max(axes, key=lambda a: (found[f"{a}_high"] - found[f"{a}_low"]) / spans[a])
        searches.append(Search(
            node, axis, found["bytes"] * left / node.shards,
            found[f"{axis}_low"], found[f"{axis}_high"],
        ))
    while searches:
        searches = _narrow(placed, searches, tolerance)
    return [side for node in nodes for side in node.sides if side.shards > 1]


def kd_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    axes = [f"axis_{n}" for n in range(len(dimensions))]
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(content) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
            *[_coordinate(docs, d).alias(a) for d, a in zip(dimensions, axes, strict=True)],
        ),
        "shard-rows",
    )
    whole = rows.agg(
        F.sum("size").alias("bytes"),
        *[(F.max(a) - F.min(a)).alias(a) for a in axes],
    ).first()
    root = Node(0, shards)
    if whole["bytes"]:
        spans = {a: max(1, whole[a]) for a in axes}
        level = [root] if shards > 1 else []
        while level:
            level = _split_level(
                rows, root, level, axes, spans, TOLERANCE * whole["bytes"] / shards
            )
    placed = rows.select(
        "doc_id", "size", "text_crc32", "row", root.choose().cast("int").alias("shard")
    )
    return number_within(placed, ["shard"], "row", "number", ROW_BLOCK).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one folder per shard; ids must be unique for this."""
    places = placed.select(F.col("doc_id").alias("_place_id"), "shard", "slot")
    docs.join(places, F.col(id_col) == F.col("_place_id")).drop("_place_id") \
        .write.partitionBy("shard").parquet(path)
