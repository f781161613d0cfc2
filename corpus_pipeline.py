"""A training corpus from ``documents``: classify, deduplicate, mix, pack.

Each stage takes the documents its predecessor kept, written as Parquet and read again. Extra
columns come along to the last stage but one, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodescan.llm.exact_dedup import exact_dedup, kept_rows
from lodescan.llm.mixing import mixed_rows
from lodescan.llm.packing import pack
from lodescan.llm.quality_cnn import classified_rows
from lodescan.llm.simhash import one_of_each
from lodescan.session import materialize

# the part of the tokens that the mix may hold; a document is taken once at most
MIX_BUDGET = (9, 10)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    A null or empty text is scored like any other; rows of equal texts share one verdict, and
    rows without an id are scored too. No labels: everything stays. No rows give no rows.
    """
    return classified_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest id.

    A null text counts as empty, so null and empty texts are copies of each other. No rows
    give no rows.
    """
    return kept_rows(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the SimHash links: three words, two bits.

    Texts without a word have fingerprint zero and are one component; rows without an id
    stay, as they cannot be told apart. No rows give no rows.
    """
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the weighted mix, each once at most.

    Null languages and sources are leaves of their own; a text without a word costs nothing.
    No rows give no rows.
    """
    return mixed_rows(docs, budget=MIX_BUDGET, max_epochs=1)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, one row each.

    A null or empty text holds the closing id alone; a text longer than a window has several
    pieces. No rows give no rows.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed),
    ("packing", packed),
]

# trained filters, SimHash and the tokeniser have no SQL form; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
