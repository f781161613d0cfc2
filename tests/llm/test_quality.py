import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodescan.llm import quality_cnn as Q


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    return Q.Model(
        rng.normal(size=(Q.WIDTH, 256, Q.FILTERS)).astype(np.float32),
        rng.normal(size=(Q.FILTERS, Q.HIDDEN)).astype(np.float32),
        rng.normal(size=Q.HIDDEN).astype(np.float32),
        rng.normal(size=2 * Q.HIDDEN).astype(np.float32), 0.3,
    )


def slow_score(model, text):
    """One filter place, one chunk and one hidden unit at a time."""
    size = -(-(len(text) + Q.WIDTH - 1) // Q.BLOCK) * Q.BLOCK
    data = text + bytes(size - len(text) + Q.WIDTH)
    blocks = [
        np.max([sum(model.tables[k][data[p + k]] for k in range(Q.WIDTH))
                for p in range(b, b + Q.BLOCK)], axis=0)
        for b in range(0, size, Q.BLOCK)
    ]
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks
    hidden = [np.maximum(c @ model.inner + model.inner_bias, 0) for c in chunks]
    both = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)])
    return 1 / (1 + np.exp(-np.clip(both @ model.outer + model.outer_bias, -30, 30)))


def test_scores_equal_the_definition(model):
    texts = [b"", b"a", b"x" * Q.BLOCK, bytes(range(256)) * 5, "é日本 text ".encode() * 90]
    texts += [b"z" * n for n in (Q.BLOCK - Q.WIDTH + 1, Q.BLOCK - Q.WIDTH + 2, Q.BLOCK * 2)]
    found = Q.score_texts(model, texts)
    assert np.allclose(found, [slow_score(model, t) for t in texts], atol=1e-4)
    assert np.allclose(found, [Q.score_texts(model, [t])[0] for t in texts], atol=1e-5)


def test_no_texts(model):
    assert len(Q.score_texts(model, [])) == 0


def test_slopes_equal_differences():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (40, 700, 900)]
    wanted = np.array([1, 0, 1], np.float32)
    model = Q.train(texts, [1, 0, 1], epochs=1)

    def loss():
        p = np.clip(Q.score_texts(model, texts), 1e-7, 1 - 1e-7)
        weight = np.where(wanted > 0, 1, Q.REJECTED_WEIGHT)
        return -(weight * np.where(wanted > 0, np.log(p), np.log(1 - p))).mean()

    slopes = Q._slopes(model, texts, wanted)
    for place, (value, slope) in enumerate(zip(
        (model.tables, model.inner, model.inner_bias, model.outer), slopes
    )):
        flat = np.argsort(-np.abs(slope).ravel())[:3]
        for at in flat:
            index = np.unravel_index(at, value.shape)
            before = value[index]
            value[index] = before + 1e-2
            up = loss()
            value[index] = before - 1e-2
            down = loss()
            value[index] = before
            assert abs((up - down) / 2e-2 - slope[index]) < 0.05 * abs(slope[index]) + 1e-3, place


def test_single_class_and_no_labels():
    assert Q.score_texts(Q.train([], []), [b"any"])[0] > 0.99
    assert Q.score_texts(Q.train([b"x"], [0]), [b"any"])[0] < 0.01


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = [r["predicted"] == r["quality"] for r in rows]
    assert sum(right) / len(right) >= 0.93
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) for r in rows)


def test_held_out_rows_are_not_trained_on(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    texts, wanted = Q.training_sample(docs, labels)
    assert sorted(int(t) for t in texts) == [
        i for i in range(60) if zlib.crc32(str(i).encode()) % 5
    ]
    assert set(wanted) == {1}
    assert len(Q.training_sample(docs, labels, rows=7)[0]) == 7
    assert sum(map(len, Q.training_sample(docs, labels, size=9)[0])) <= 9


def test_odd_documents(spark, docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, 1, 0), (8, 0, 0), (10, 0, 0), (None, 1, 0), (6, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
    assert Q.classify(no_docs, labels).collect() == []
    assert {r["predicted"] for r in Q.classify(docs, labels.limit(0)).collect()} == {1}
    kept = Q.classified_rows(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()
