import itertools
import random

import pytest
import xxhash

from lodescan.llm import simhash as S
from lodescan.llm.components import components


def slow_fingerprint(text):
    words = [w for w in "".join(
        chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""
    ).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ")
     .replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(
        1 << bit for bit in range(64)
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def classes(prints):
    """Least id of each node's component, by comparing all pairs."""
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(a)] = find(b)
    return {p: find(p) for p in prints}


def expected(rows):
    prints = {i: slow_fingerprint(t) for i, (_, t) in enumerate(rows)}
    root = classes(set(prints.values()))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (least.get(root[prints[i]]), doc_id) if x is not None]
        least[root[prints[i]]] = min(known) if known else None
    return sorted(
        ((doc_id, f"{prints[i]:016x}", least[root[prints[i]]])
         for i, (doc_id, _) in enumerate(rows)), key=str,
    )


def got(result):
    return sorted(
        ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in result.collect()), key=str
    )


def test_odd_documents(docs):
    assert got(S.simhash_components(docs)) == expected(
        [(r["doc_id"], r["text"]) for r in docs.collect()]
    )


def test_no_rows(no_docs):
    assert S.simhash_components(no_docs).collect() == []


def test_generated_documents(small):
    assert got(S.simhash_components(small)) == expected(
        [(r["doc_id"], r["text"]) for r in small.collect()]
    )


# all buckets in pairs, a few crowded ones, every bucket crowded
@pytest.mark.parametrize("limit", [10_000, 3, 0])
def test_links_of_crowded_segments(spark, limit):
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(60)}
    for _ in range(400):
        base = draw.choice(sorted(prints))
        for _ in range(draw.randint(1, 4)):
            base ^= 1 << draw.randrange(64)
        prints.add(base)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "fp long")
    roots = {r["node"]: r["root"] for r in components(S.links(table, limit)).collect()}
    mask = (1 << 64) - 1
    ours = {}
    for (fp,) in signed:
        ours.setdefault(roots.get(fp, fp), set()).add(fp & mask)
    theirs = {}
    for fp, root in classes(prints).items():
        theirs.setdefault(root, set()).add(fp)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {**{i: 1 for i in range(2, 61)}, 101: 100}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_component_stays(docs):
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    named = {r["component_id"] for r in S.simhash_components(docs).collect()} - {None}
    assert {r["doc_id"] for r in kept.collect()} - {None} == named
