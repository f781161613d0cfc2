import hashlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from lodescan.llm import mixing as M

WEIGHTS = [{"d0": 5, "d1": 1}, {"en": 3, "de": 2}, {"src0": 4}]


def fill(budget, children):
    """children: name -> (weight, capacity). Saturate one after another, share the rest."""
    taken, waiting = {}, dict(children)
    while waiting:
        weights = sum(w for w, _ in waiting.values())
        full = [n for n, (w, c) in waiting.items() if c * weights <= w * budget]
        if not full:
            return taken | {n: w * budget // weights for n, (w, _) in waiting.items()}
        name = min(full, key=lambda n: (Fraction(waiting[n][1], waiting[n][0]), n))
        taken[name] = waiting.pop(name)[1]
        budget -= taken[name]
    return taken


def expected(rows, budget, epochs, seed):
    """rows: (doc_id, domain, lang, source, tokens). Copies of each row, by the definition."""
    leaves = defaultdict(list)
    for n, row in enumerate(rows):
        leaves[row[1:4]].append((n, row))
    available = {k: sum(r[4] for _, r in v) for k, v in leaves.items()}

    def grant(prefix, amount):
        depth = len(prefix)
        if depth == 3:
            return {prefix: amount}
        below = defaultdict(int)
        for leaf, tokens in available.items():
            if leaf[:depth] == prefix:
                below[leaf[depth]] += tokens * epochs
        shares = fill(amount, {n: (WEIGHTS[depth].get(n, 1), c) for n, c in below.items()})
        return {k: v for n, s in shares.items() for k, v in grant((*prefix, n), s).items()}

    granted = grant((), sum(available.values()) * budget[0] // budget[1])
    copies = [0] * len(rows)
    for leaf, members in leaves.items():
        full = granted[leaf] // available[leaf] if available[leaf] else 0
        rest = granted[leaf] - full * available[leaf]

        def key(row):
            parts = [str(seed), str(full)] + ([] if row[0] is None else [str(row[0])])
            return hashlib.md5(":".join(parts).encode()).hexdigest()

        for n, row in members:
            reached = sum(r[4] for _, r in members if key(r) <= key(row))
            copies[n] = full + (reached <= rest)
    return granted, copies


def tree(docs):
    return docs.select(
        "doc_id", "text", F.coalesce(M.domain_of(F.col("source")), F.lit("")).alias("d"),
        F.coalesce("lang", F.lit("")).alias("l"), F.coalesce("source", F.lit("")).alias("s"),
    ).collect()


def tokens(text):
    return len([w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w])


@pytest.mark.parametrize("budget, epochs", [((1, 2), 2), ((9, 10), 1), ((3, 2), 3), ((5, 1), 2)])
def test_mix(small, docs, budget, epochs):
    for table in (small, docs):
        rows = [(r["doc_id"], r["d"], r["l"], r["s"], tokens(r["text"])) for r in tree(table)]
        granted, copies = expected(rows, budget, epochs, M.SEED)
        found = M.mix(table, weights=WEIGHTS, budget=budget, max_epochs=epochs).collect()
        assert sorted(
            (str(r["doc_id"]), r["domain"], r["lang"], r["source"], r["n_tokens"],
             r["leaf_budget"], r["copies"]) for r in found
        ) == sorted(
            (str(r[0]), *r[1:], granted[r[1:4]], c) for r, c in zip(rows, copies)
        )


def test_shortage_goes_to_siblings_first(spark):
    """d0/en/b is short: its sibling takes over; d1 gets no more than its weight."""
    rows = [("d0", "en", "a", 1000), ("d0", "en", "b", 10), ("d1", "en", "c", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, available long")
    found = {r["source"]: r["budget"] for r in M.leaf_budgets(
        leaves, [{}, {}, {}], (600, 2010), 1).collect()}
    assert found == {"a": 290, "b": 10, "c": 300}
    found = {r["source"]: r["budget"] for r in M.leaf_budgets(
        leaves.filter("source <> 'a'"), [{}, {}, {}], (600, 1010), 1).collect()}
    assert found == {"b": 10, "c": 590}


def test_rows_are_taken_as_often_as_planned(small, docs):
    for table in (small, docs):
        planned = M.mix(table)
        taken = M.mixed_rows(table)
        assert taken.columns == table.columns
        wanted = planned.groupBy("doc_id").agg(F.sum("copies").alias("n")).filter("n > 0").collect()
        ours = taken.groupBy("doc_id").count().collect()
        assert {(r["doc_id"], r["n"]) for r in wanted} == {(r["doc_id"], r["count"]) for r in ours}


def test_no_rows_and_bad_weights(no_docs, docs):
    assert M.mix(no_docs).collect() == []
    assert M.mixed_rows(no_docs).collect() == []
    with pytest.raises(ValueError):
        M.mix(docs, weights=[{"d0": 0}, {}, {}])
