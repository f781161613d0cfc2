import pytest

LONG = " ".join(f"word{i % 977} tail{i}." for i in range(9_000))

# nulls, empty and very long texts, ties, repeated rows, odd white space
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog today.", "en", "src0", 50),
    (2, "The  quick\tbrown fox jumps over the lazy dog today.", "en", "src0", 51),
    (3, None, "en", None, None),
    (4, "", None, "src1", 0),
    (5, "   \n\t ", "de", "src1", 6),
    (6, LONG, "en", "src0", len(LONG)),
    (7, LONG + " end", "en", "src0", len(LONG) + 4),
    (8, "Ein kurzer Satz.", "de", "src2", 16),
    (8, "Ein kurzer Satz.", "de", "src2", 16),
    (9, "Ein kurzer Satz!", "de", "src2", 16),
    (None, "Ein kurzer Satz.", "de", "src2", 16),
    (None, "no id at all", "fr", "src3", 12),
    (10, "a a a a a a a a a a a a a a a a a a a a a a a a", "fr", "src3", 47),
    (11, "é日本 <|endoftext|> it's  we'll\n\nend", "fr", "src3", 33),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every odd case, and columns whose names the operators use."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("hash", "entry", "row", "bucket", "content", "key", "size", "fp", "score",
                 "budget", "domain", "rid", "kept", "words", "label", "copies"):
        base = base.withColumn(name, F.lit("clash"))
    return base


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """The generated documents of the smallest size."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
