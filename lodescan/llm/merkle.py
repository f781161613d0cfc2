"""Merkle manifest of a dataset, with a witness of every document.

Documents are the leaves of one tree per source, in the order of their ids; every three
neighbours have one parent, the last run of a level fewer. The roots of the sources, in their
order, are the leaves of a last tree of the same kind.

Witnesses grow while leaves are appended. A task takes an aligned block of 3^8 leaves and
appends one after the other. Every open subtree carries the partial witnesses of its leaves:
they start with the siblings to its left, and each sibling that is completed later extends
them. What is left of a block is its root, and the roots of the blocks of a tree are appended
in the same way, in blocks of their own, until one node is left; the witness of a leaf is that
inside its block and then that of its block. So no task ever holds more than one block, and a
source that owns most of the rows has most of the blocks.

Rows: a null field is a field of its own (``-``). Documents without an id come first, those of
equal ids in the order of their leaves, so repeated rows are leaves side by side; documents
without a source are a source that comes first. Texts are hashed whole. An empty table has no
rows and no root. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .order import in_order, numbered

ARITY = 3
# levels of a block, and the leaves it has
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def combined(digests: bytes) -> bytes:
    """The node over some digests, which are hashed as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def depth(leaves: int, arity: int = ARITY) -> int:
    """Levels between the leaves and the one node that remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // arity), levels + 1
    return levels


class Appender:
    """A tree that leaves are appended to; ``paths`` holds the witness of each so far."""

    def __init__(self, arity: int = ARITY) -> None:
        self.arity = arity
        self.paths: list[bytearray] = []
        # by level, the complete subtrees of the open run: digest, first leaf, end
        self.open: list[list[tuple[bytes, int, int]]] = [[]]

    def append(self, leaf: bytes) -> None:
        at = len(self.paths)
        self.paths.append(bytearray())
        self._completed(0, leaf, at, at + 1)

    def _completed(self, level: int, digest: bytes, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        if run:
            for other in range(run[0][1], first):
                self.paths[other] += digest
            left = b"".join(subtree[0] for subtree in run)
            for own in range(first, end):
                self.paths[own] += left
        run.append((digest, first, end))
        if len(run) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._completed(
            level + 1, combined(b"".join(subtree[0] for subtree in run)), run[0][1], run[-1][2]
        )

    def root(self, levels: int) -> bytes:
        """Close what is open below ``levels``; the one node there."""
        for level in range(levels):
            if self.open[level]:
                self._close(level)
        return self.open[levels][0][0]


def fold(node: bytes, path: bytes, places: list[tuple[int, int]], arity: int = ARITY) -> bytes:
    """The root that a leaf and its witness give; ``places`` are (pos, n) of each tree."""
    at = 0
    for pos, n in places:
        while n > 1:
            place = pos % arity
            size = DIGEST * (min(arity, n - pos + place) - 1)
            siblings, at = path[at:at + size], at + size
            own = DIGEST * place
            node = combined(siblings[:own] + node + siblings[own:])
            pos, n = pos // arity, -(-n // arity)
    return node


def _field(name: str) -> Column:
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    """Digest of the fields of a document."""
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def leaves(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source",
    **others: Column,
) -> DataFrame:
    """(doc_id, tree, node): the leaf of every document; ``others`` are leaves to try later.

    The first field is the id, the last one the text.
    """
    return docs.select(
        F.col(fields[0]).alias("doc_id"), F.col(group).cast("string").alias("tree"),
        leaf_of(*[_field(f) for f in fields]).alias("node"),
        *[leaf.alias(name) for name, leaf in others.items()],
    )


def without_line_feeds(fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf after line feeds were deleted from the text of half of the documents."""
    text = F.coalesce(
        F.concat(
            F.octet_length(_one_line(fields[-1])).cast("string"), F.lit(":"), _one_line(fields[-1])
        ),
        F.lit("-"),
    )
    chosen = F.pmod(F.crc32(F.col(fields[0]).cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(chosen, leaf_of(*[_field(f) for f in fields[:-1]], text)).otherwise(
        leaf_of(*[_field(f) for f in fields])
    )


def _one_line(text: str) -> Column:
    return F.replace(F.col(text), F.lit("\n"), F.lit(""))


def _grow(arity: int, levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        tree = Appender(arity)
        for node in table["node"].to_pylist():
            tree.append(node)
        root = tree.root(levels if n > arity ** levels else depth(n, arity))
        return table.append_column(
            "path", pa.array(map(bytes, tree.paths), pa.binary())
        ).append_column("top", pa.array([root] * len(table), pa.binary()))

    return run


def climb(nodes: DataFrame, most: int, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """Append the nodes of every tree block by block, then the roots of the blocks, and so on.

    ``nodes`` has tree, pos, n, node; ``most`` is the largest n. Each table of the result adds
    path, the witness inside the block, and top, the root of the block.
    """
    block, stages = arity ** levels, []
    while True:
        dealt = nodes.withColumn("block", F.expr(f"pos div {block}"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
        stages.append(materialize(
            dealt.groupBy("tree", "block").applyInArrow(
                _grow(arity, levels), f"{schema}, path binary, top binary"
            ),
            "witnesses",
        ))
        if most <= block:
            return stages
        nodes = stages[-1].filter(f"pos = block * {block}").select(
            "tree", F.col("block").alias("pos"), F.expr(f"(n + {block - 1}) div {block}").alias("n"),
            F.col("top").alias("node"),
        )
        most = -(-most // block)


def _joined(stages: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Rows of the first stage with their whole path; ``tops`` has tree, path and more."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    upper = tops.select(
        F.col("tree").alias("of_tree"), F.lit(0).cast("long").alias("of_block"),
        F.col("path").alias("rest"), *more,
    )
    for stage in reversed(stages):
        here = stage.join(
            upper, F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("block") == F.col("of_block"))
        ).withColumn("path", F.concat("path", "rest")).drop("of_tree", "of_block", "rest")
        upper = here.select(
            F.col("tree").alias("of_tree"), F.col("pos").alias("of_block"),
            F.col("path").alias("rest"), *more,
        )
    return here


def _trees(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    most = nodes.agg(F.max("n")).first()[0] or 0
    return climb(nodes, most, arity, levels)


def witnesses(leaf_rows: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The leaves with pos and n in their tree, tree_pos and trees, path, subroot and root."""
    placed = in_order(leaf_rows, ["tree", "doc_id", "node"], "leaves")
    stages = _trees(numbered(placed, ["tree"], "leaf-starts"), arity, levels)
    subroots = stages[-1].filter("pos = 0").select(
        F.col("tree").alias("name"), F.col("top").alias("node")
    )
    # one last tree without a name, over the roots of all others
    placed = in_order(subroots, ["name"], "subroots")
    last = _trees(
        numbered(placed, [], "subroot-starts").withColumn("tree", F.lit(None).cast("string")),
        arity, levels,
    )
    root = last[-1].filter("pos = 0").select("tree", F.lit(b"").alias("path"), F.col("top").alias("root"))
    tops = _joined(last, root).select(
        F.col("name").alias("tree"), "path", F.col("pos").alias("tree_pos"),
        F.col("n").alias("trees"), F.col("node").alias("subroot"), "root",
    )
    return _joined(stages, tops)


def folded(rows: DataFrame, leaf: str, arity: int = ARITY) -> DataFrame:
    """Add folded_root, what the witnesses of ``rows`` make of their column ``leaf``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in (leaf, "path", "pos", "n", "tree_pos", "trees")]
            roots = [
                fold(node, path, [(pos, n), (tree_pos, trees)], arity)
                for node, path, pos, n, tree_pos, trees in zip(*columns, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "folded_root"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, folded_root binary")


def merkle_manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source",
    tampered: Column | None = None, levels: int = LEVELS,
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` gives the leaf of what is held against the manifest, by default that of
    ``docs`` after ``without_line_feeds``; ``verified`` says whether it folds to the root.
    """
    other = without_line_feeds(fields) if tampered is None else tampered
    made = witnesses(leaves(docs, fields, group, other=other), levels=levels).select(
        "doc_id", "node", "other", "path", "pos", "n", "tree_pos", "trees", "subroot", "root"
    )

    def text(name: str) -> Column:
        return F.lower(F.hex(name))

    return folded(made, "other").select(
        "doc_id", text("node").alias("leaf"), text("subroot").alias("subroot"),
        text("root").alias("root"), F.sha2(text("path").cast("binary"), 256).alias("proof_sha256"),
        text("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
