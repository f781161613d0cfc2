"""Spark session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # JSON-LD in the wild repeats keys; without this such a block counts as invalid
    "spark.sql.variant.allowDuplicateKeys": "true",
    # no stack trace per column call: the signal plans hold hundreds of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "lodescan", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A cluster must name one. Only a session whose tasks run in the driver's own process, as
    in tests, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lodescan-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of everything this application stores on the way."""
    return f"{shared_dir(spark)}/lodescan/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clean_run(spark: SparkSession) -> None:
    """Delete the tables this application stored, once its results are written.

    Results that were returned but not written yet still read them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor, and gives the planner the
    exact size, so a later join is broadcast only when the written table is small.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
