import pytest

from lodescan.llm import quality_cnn as Q


def tables(spark, texts):
    rows = [(i, text, i % 2) for i, text in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    return docs, labels


def test_a_long_text_is_passed_over(spark):
    """Wherever it lies in the order, the others are still taken."""
    short = [f"text {i}" for i in range(40)]
    whole = sorted(Q.training_sample(*tables(spark, short))[0])
    for at in range(0, 40, 8):
        texts = [*short[:at], "x" * (Q.SAMPLE_BYTES + 1), *short[at + 1:]]
        found, labels = Q.training_sample(*tables(spark, texts))
        assert sorted(found) == sorted(t for t in whole if t != short[at].encode())
        assert set(labels) == {0, 1}


def test_a_text_that_does_not_fit_makes_room_for_the_next(spark):
    docs, labels = tables(spark, ["y" * 50 if i % 3 else "z" for i in range(60)])
    found, _ = Q.training_sample(docs, labels, size=120)
    assert sum(map(len, found)) <= 120 and sum(t == b"z" for t in found) > 10


def test_no_usable_sample_is_an_error(spark):
    docs, labels = tables(spark, ["x" * (Q.LONGEST + 1)] * 20)
    with pytest.raises(ValueError):
        Q.training_sample(docs, labels)


def test_a_sample_that_lost_a_label_is_an_error(spark):
    docs, labels = tables(spark, ["x" * (Q.LONGEST + 1) if i % 2 else "short" for i in range(20)])
    with pytest.raises(ValueError):
        Q.training_sample(docs, labels)
