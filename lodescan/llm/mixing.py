"""Hierarchical budgeting of a token mix over a domain, language and source tree.

Weights are propagated from the root: the children of a node share its budget by weight, none
gets more than its subtree can give (its tokens times the allowed epochs), and what a child
can't take goes to its siblings. As a node's capacity is that of its whole subtree, a shortage
reaches the siblings of an ancestor only when the node's own children are exhausted. A leaf
takes as many full epochs as its budget holds and then the prefix, in the seeded order of the
next epoch, whose tokens fit the rest.

The prefix of a leaf, however large, is found by counting: tokens per leaf and 256 ranges of
the order key, again in the range where the budget ends, then that range's rows. Only built-in functions;
weights are whole numbers, so that every step is exact.

Rows: a null text has no tokens, a null or unlisted domain, language or source is a child like
any other (null is the empty name) of weight 1. Rows of a leaf that tie in the order key,
which are rows with the same id, are taken together or not at all. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .text import word_list

TREE = ["domain", "lang", "source"]
SEED = 20
MAX_EPOCHS = 2
# digits of the order key that tell its ranges: 256, then 256 in the one that matters
RANGE_DIGITS = (2, 4)
# the mix holds this part of the corpus' tokens
BUDGET = (1, 2)
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}


def domain_of(source: Column) -> Column:
    """The four domains of a corpus that names none: by the first digit of a digest."""
    digit = F.conv(F.substring(F.md5(source.cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("d"), F.shiftright(digit, 2).cast("string"))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    chosen = F.lit(1)
    for value, weight in weights.items():
        chosen = F.when(name == value, weight).otherwise(chosen)
    return chosen.cast("long")


def share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``share`` to children with weight, capacity and their parent's budget.

    Taken in the order of capacity by weight, a child is filled up if its part of what is
    left covers its capacity; the others divide the rest by weight, rounded down.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(child)]
    siblings = [F.col(p) for p in parent] or [F.lit(0)]
    ranked = Window.partitionBy(*siblings).orderBy(*order)
    earlier = ranked.rowsBetween(Window.unboundedPreceding, -1)
    onwards = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy(*siblings)
    full = F.col("capacity") * F.col("_weights") <= F.col("weight") * F.col("_left")
    return (
        children.withColumn(
            "_left", F.col("budget") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0))
        )
        .withColumn("_weights", F.sum("weight").over(onwards))
        .withColumn("_full", full)
        .withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0))
                    .over(everyone))
        .withColumn("_sharers", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight")))
                    .over(everyone))
        .withColumn("share", F.when(F.col("_full"), F.col("capacity")).otherwise(
            F.expr("weight * (budget - _taken) div _sharers")
        ))
        .drop("_left", "_weights", "_full", "_taken", "_sharers")
    )


def leaf_budgets(leaves: DataFrame, weights: list[dict[str, int]], budget: tuple[int, int],
                 max_epochs: int) -> DataFrame:
    """leaves: the tree columns and ``available`` tokens. Adds the leaf's ``budget``."""
    capacity = (F.sum("available") * max_epochs).alias("capacity")
    parent: list[str] = []
    granted = None
    for depth, name in enumerate(TREE):
        nodes = leaves.groupBy(*parent, name).agg(
            capacity, F.sum("available").alias("tokens")
        ).withColumn("weight", _weight(F.col(name), weights[depth]))
        if granted is None:  # the few nodes below the root
            everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("tokens", everything).withColumn(
                "budget", F.expr(f"tokens * {budget[0]} div {budget[1]}")
            )
        else:
            nodes = nodes.join(granted, parent)
        shared = share(nodes, parent, name)
        parent = [*parent, name]
        granted = shared.select(*parent, F.col("share").alias("budget"))
    return leaves.join(granted, TREE)


def _order_key(seed: int) -> Column:
    return F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")
    ).cast("binary"))


def _range(digits: int = RANGE_DIGITS[-1]) -> Column:
    return F.substring("key", 1, digits)


def leaf_plan(rows: DataFrame, weights: list[dict[str, int]], budget: tuple[int, int],
              max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: its budget, full epochs, and where the prefix of the next one ends.

    ``rows`` has doc_id, the tree columns and n_tokens. The prefix holds the ranges below
    ``last_range`` and in it the keys up to ``last_key``; no range means the whole leaf.
    """
    leaves = rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("available"))
    budgets = materialize(
        leaf_budgets(leaves, weights, budget, max_epochs)
        .withColumn("epochs", F.expr("if(available = 0, 0, budget div greatest(available, 1))"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available")),
        "leaf-budgets",
    )
    keyed = rows.join(budgets.select(*TREE, "epochs", "rest"), TREE) \
        .withColumn("key", _order_key(seed))
    earlier = Window.partitionBy(*TREE).orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ends = budgets.select(*TREE, F.lit("").alias("last_range"), F.lit(0).cast("long").alias("before"))
    for digits in RANGE_DIGITS:
        counted = (
            keyed.join(ends, TREE).filter(F.col("key").startswith(F.col("last_range")))
            .groupBy(*TREE, _range(digits).alias("range"), "rest", "before")
            .agg(F.sum("n_tokens").alias("tokens"))
        )
        opening = F.col("before") + F.coalesce(F.sum("tokens").over(earlier), F.lit(0))
        ends = materialize(
            counted.withColumn("before", opening)
            .filter((F.col("before") <= F.col("rest"))
                    & (F.col("rest") < F.col("before") + F.col("tokens")))
            .select(*TREE, F.col("range").alias("last_range"), "before"),
            "prefix-ends",
        )
    inside = Window.partitionBy(*TREE).orderBy("key").rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cuts = (
        keyed.join(ends, TREE).filter(_range() == F.col("last_range"))
        .withColumn("reached", F.col("before") + F.sum("n_tokens").over(inside))
        .groupBy(*TREE, "last_range")
        .agg(F.max(F.when(F.col("reached") <= F.col("rest"), F.col("key"))).alias("last_key"))
    )
    return materialize(budgets.join(cuts, TREE, "left"), "leaf-plan")


def named(docs: DataFrame, domain: Column, lang: Column, source: Column) -> dict[str, Column]:
    return {
        "domain": F.coalesce(domain, F.lit("")), "lang": F.coalesce(lang, F.lit("")),
        "source": F.coalesce(source, F.lit("")),
    }


def _copies() -> Column:
    in_prefix = (
        F.col("last_range").isNull()
        | (_range() < F.col("last_range"))
        | ((_range() == F.col("last_range")) & (F.col("key") <= F.col("last_key")))
    )
    return (F.col("epochs") + F.coalesce(in_prefix, F.lit(False)).cast("int")).cast("int")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: list[dict[str, int]] | None = None,
    budget: tuple[int, int] = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, the tree columns, n_tokens, leaf_budget, copies."""
    rows, plan = plan_of(docs, id_col, text_col, weights, budget, max_epochs, seed, domain)
    return (
        rows.join(plan, TREE).withColumn("key", _order_key(seed)).select(
            "doc_id", *TREE, "n_tokens", F.col("budget").alias("leaf_budget"),
            _copies().alias("copies"),
        )
    )


def plan_of(docs, id_col="doc_id", text_col="text", weights=None, budget=BUDGET,
            max_epochs=MAX_EPOCHS, seed=SEED, domain=None) -> tuple[DataFrame, DataFrame]:
    own = named(docs, domain_of(F.col("source")) if domain is None else domain,
                F.col("lang"), F.col("source"))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            *[column.alias(name) for name, column in own.items()],
            F.size(word_list(text_col)).cast("long").alias("n_tokens"),
        ),
        "mix-rows",
    )
    chosen = weights or [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS]
    return rows, leaf_plan(rows, chosen, budget, max_epochs, seed)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", domain: Column | None = None,
               seed: int = SEED, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, each as often as it is taken.

    The plan has a row per leaf; a document finds its leaf's where it lies when the planner
    sees that the plan is small, and no text is shuffled then.
    """
    _, plan = plan_of(docs, id_col=id_col, domain=domain, seed=seed, **options)
    own = named(docs, domain_of(F.col("source")) if domain is None else domain,
                F.col("lang"), F.col("source"))
    keyed = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("doc_id"),
        *[column.alias(name) for name, column in own.items()],
    ).join(plan, TREE).withColumn("key", _order_key(seed))
    taken = keyed.select("_row", _copies().alias("_copies")).filter("_copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))) \
        .select("_row.*")
