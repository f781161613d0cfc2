"""Run registered queries against their SQL twins: python -m checks.compare [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""

    def cell(value: object) -> str:
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, float) and value == int(value):
            return str(int(value))
        return str(value)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def compare(spark, connection, sf_dir: str, name: str) -> str:
    """Empty text if both sides agree, else what differs."""
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    start = time.time()
    theirs = connection.execute(ORACLE[name]).df()
    print(f"     {name}: sql {time.time() - start:.1f}s", flush=True)
    ours = QUERIES[name](spark, sf_dir).toPandas()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = canonical(ours), canonical(theirs)
    if a == b:
        return "" if a else "no rows"
    left, right = set(a) - set(b), set(b) - set(a)
    return f"rows {len(a)} / {len(b)}, only ours {len(left)} {sorted(left)[:2]}, only theirs {len(right)} {sorted(right)[:2]}"


def main() -> None:
    from checks.oracle import ORACLE
    from lodescan.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        "compare",
        **{"spark.master": "local[8]", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in sys.argv[1:] or list(ORACLE):
        start = time.time()
        try:
            difference = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            difference = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(difference)
        print(f"{'ok  ' if not difference else 'BAD '} {name} {time.time() - start:.1f}s {difference[:1800]}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
