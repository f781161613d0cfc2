import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lodescan.llm import merkle as M


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    parts = [doc_id, source, lang, n_chars, text]
    return H("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(nodes):
    """(root, siblings of every node, level by level), by the definition."""
    paths = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(at, min(at + 3, len(nodes)))) for at in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for i in owners[k]:
                    paths[i].append(([nodes[o] for o in run if o != k], run.index(k)))
        nodes, owners = (["".join(nodes[k] for k in run) for run in runs],
                         [[i for k in run for i in owners[k]] for run in runs])
        nodes = [H(n) for n in nodes]
    return nodes[0], paths


def folded(node, path):
    for siblings, at in path:
        node = H("".join(siblings[:at] + [node] + siblings[at:]))
    return node


def slow(rows):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        original = leaf(doc_id, source, lang, n_chars, text)
        other = original
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            other = leaf(doc_id, source, lang, n_chars, text.replace("\n", ""))
        by_source[source].append((doc_id, original, other))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by_source[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[source] = tree([r[1] for r in by_source[source]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for source, top in zip(order, tops):
        for (doc_id, original, other), path in zip(by_source[source], trees[source][1]):
            whole = path + top
            found = folded(other, whole)
            proof = H("".join(s for siblings, _ in whole for s in siblings))
            out.append((doc_id, original, trees[source][0], root, proof, found, found == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_the_definition(spark, levels):
    """One source holds most rows; blocks of 3, 9 and more leaves give the same trees."""
    draw = random.Random(levels)
    rows = []
    for doc_id in draw.sample(range(1_000), 120):
        source = draw.choice(["hot", "hot", "hot", "ä", "z", None, "", f"own{doc_id % 9}"])
        rows.append((doc_id, draw.choice(["a\nb", "é\n", "plain", "", None]), "en", source, 3))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(M.merkle_manifest(df, levels=levels)) == slow(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_trees_of_every_shape(spark, n):
    rows = [(i, f"t\n{i}", None, "s", None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(M.merkle_manifest(df, levels=2)) == slow(rows)


def test_witnesses_grow_with_their_siblings():
    tree = M.Appender()
    digests = [bytes([n]) * 32 for n in range(4)]
    tree.append(digests[0])
    assert [bytes(p) for p in tree.paths] == [b""]
    tree.append(digests[1])
    assert [bytes(p) for p in tree.paths] == [digests[1], digests[0]]
    tree.append(digests[2])
    tree.append(digests[3])
    first = M.combined(b"".join(digests[:3]))
    # the fourth leaf opens a run; nothing stands beside its parent yet but the first subtree
    assert bytes(tree.paths[0]) == digests[1] + digests[2]
    root = tree.root(2)
    assert root == M.combined(first + M.combined(digests[3]))
    assert bytes(tree.paths[3]) == first
    assert [M.fold(d, bytes(p), [(i, 4)]) for i, (d, p) in enumerate(zip(digests, tree.paths))] == [root] * 4


def test_odd_documents(docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    assert got(M.merkle_manifest(docs)) == slow(rows)
    assert M.merkle_manifest(no_docs).collect() == []


def test_generated_documents(small):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in small.collect()]
    assert got(M.merkle_manifest(small, levels=2)) == slow(rows)
