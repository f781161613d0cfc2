"""Sliding-window limit and daily cap as one stateful stream operator.

Requests are decided on arrival, late ones too, as a live limiter must. Inside a micro-batch
the requests of a key are put in (ts, event_id) order first; only these two numbers per
request are held for that, and the source bounds a micro-batch (``maxFilesPerTrigger`` or
offsets). State per key is the last ``soft`` admitted timestamps, the newest timestamp seen
and a counter per day, of which the days that can still matter are kept. A request older than
the newest one of its key is marked ``late``; ``late_counts`` adds those up.

The state of an idle key goes after ``live_ttl``. A replay of stored requests passes
``ttl_ms=None``: with a timeout pending, an available-now run keeps starting empty batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as V
from ..operators.limits import KEYS, keyed
from ..session import new_folder

OUTPUT = (
    "kind string, ip string, ts bigint, event_id bigint, soft_ok boolean, daily_ok boolean, "
    "admitted boolean, late boolean"
)
STATE = "hits array<bigint>, newest bigint, days array<bigint>, used array<bigint>"
DAY = 86_400_000_000
# days a counter is kept after the newest one: its lifetime, rounded up
KEPT_DAYS = -(-V.DAILY_STATE_TTL_SECONDS // 86_400)
ROWS_OUT = 10_000


def _in_order(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b["ts"].to_numpy(), b["event_id"].to_numpy()) for b in batches]
    ts, events = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((events, ts))
    return ts[order], events[order]


def _decide(window: int, soft: int, daily: int | None, ttl_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits, newest, days, counts = state.get if state.exists else ([], None, [], [])
        hits, used = list(hits), dict(zip(days, counts, strict=True))
        times, events = _in_order(batches)
        soft_ok, daily_ok, late = [], [], []
        for ts in times.tolist():
            hits = [t for t in hits if ts - t < window]
            passes = len(hits) < soft
            counted = False
            if passes:
                hits.append(ts)
                day = ts // DAY
                counted = daily is None or used.get(day, 0) < daily
                used[day] = used.get(day, 0) + int(counted)
            late.append(newest is not None and ts < newest)
            newest = ts if newest is None else max(ts, newest)
            soft_ok.append(passes)
            daily_ok.append(counted)
        used = {d: n for d, n in used.items() if d >= newest // DAY - KEPT_DAYS}
        state.update((hits, newest, list(used), list(used.values())))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        for at in range(0, len(times), ROWS_OUT):
            part = slice(at, at + ROWS_OUT)
            yield pd.DataFrame({
                "kind": key[0], "ip": key[1], "ts": times[part], "event_id": events[part],
                "soft_ok": soft_ok[part], "daily_ok": daily_ok[part],
                "admitted": [a and b for a, b in zip(soft_ok[part], daily_ok[part], strict=True)],
                "late": late[part],
            })

    return run


def live_ttl(window: int) -> int:
    """Idle time, in milliseconds, after which a live key's state can no longer matter."""
    return max(2 * window // 1000, V.DAILY_STATE_TTL_SECONDS * 1000)


def limit_stream(
    requests: DataFrame, window: int, soft: int, daily: int | None,
    ttl_ms: int | None | str = "live",
) -> DataFrame:
    """Decide a stream of (kind, ip, ts, event_id); ``ts`` and ``window`` in microseconds.

    The state of a key idle for ``ttl_ms`` of processing time is dropped, by default after
    ``live_ttl``; with None, as for a replay, it stays.
    """
    idle = live_ttl(window) if ttl_ms == "live" else ttl_ms
    timeout = GroupStateTimeout.NoTimeout
    if idle is not None:
        timeout = GroupStateTimeout.ProcessingTimeTimeout
    return keyed(requests.select(*KEYS, "ts", "event_id")).groupBy(*KEYS).applyInPandasWithState(
        _decide(window, soft, daily, idle),
        OUTPUT,
        STATE,
        "append",
        timeout,
    )


def late_counts(decided: DataFrame) -> DataFrame:
    """Late requests per kind and day, the side count of a decided stream."""
    return decided.filter("late").groupBy(
        "kind", F.expr(f"(ts - pmod(ts, {DAY})) div {DAY}").alias("day")
    ).agg(F.count("*").alias("late_requests"))


def run_available(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Process what the source holds now and return the written result."""
    out, checkpoint = new_folder(spark, label), new_folder(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
