"""Request limits: a sliding window whose rejects do not count, then a daily cap.

The sliding window has feedback, so the requests of one key are decided one after the
other. What keeps that parallel and bounded:

* Requests further apart than the window cannot affect each other, so each key's timeline
  falls into independent chains, found on pre-aggregated counts per time slice.
* Chains no longer than the limit are admitted without any sequential work.
* Other chains are decided in sorted partitions with a state of ``soft`` timestamps; the work
  is per admitted request, rejected ones are passed over by binary search.
* A chain too long for one task is cut into chunks. Chunk after chunk is decided, for all
  long chains at once, and only the last ``soft`` admitted timestamps travel on. Each request
  depends on the ones before it, so these rounds are needed; they number as the longest chain
  has chunks, and the result does not depend on where a chain is cut.
* A single slice that is itself too long is first reduced, before its shuffle, to the few
  requests that can be admitted: the first ``soft`` after each moment a slot frees up.

Every kind may have its own limits. A request without an ip counts for ``UNKNOWN_IP``, and one
without a kind for the empty kind.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import GUARD_LIMITS, UNKNOWN_IP
from ..session import materialize
from .grouping import top_per_group

KEYS = ["kind", "ip"]
SLICES_PER_WINDOW = 16
CHUNK_ROWS = 1_000_000
# kind -> its value; a plain number holds for every kind
PerKind = int | dict[str, int]


def by_kind(values: PerKind) -> Column:
    """The value of a row's kind; kinds that a table of them lacks are a mistake."""
    if not isinstance(values, dict):
        return F.lit(values).cast("long")
    chosen = F.raise_error(F.concat(F.lit("no limits for kind "), F.col("kind"))).cast("long")
    for kind, value in values.items():
        chosen = F.when(F.col("kind") == kind, F.lit(value).cast("long")).otherwise(chosen)
    return chosen


def keyed(requests: DataFrame) -> DataFrame:
    """Requests whose kind and ip are filled in."""
    return requests.withColumns({
        "kind": F.coalesce("kind", F.lit("")),
        "ip": F.when(F.col("ip") != "", F.col("ip")).otherwise(F.lit(UNKNOWN_IP)),
    })


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp that holds UTC.

    For an instant (``TIMESTAMP``) use ``unix_micros``.
    """
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def _decide_run(ts: np.ndarray, window: int, soft: int, hits: deque) -> np.ndarray:
    """Which of these sorted requests of one chain are admitted; ``hits`` goes on to the next."""
    admitted = np.zeros(len(ts), bool)
    at = 0
    while at < len(ts):
        if len(hits) >= soft:
            # the oldest of the last ``soft`` admitted must have left the window
            at = max(at, int(np.searchsorted(ts, hits[0] + window))) if soft else len(ts)
            if at == len(ts):
                break
            hits.popleft()
        admitted[at] = True
        hits.append(int(ts[at]))
        at += 1
    return admitted


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (kind, ip, chain, carried, ts, event_id); carried rows are admitted ones."""
    current, hits = None, deque()
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(batch["kind"], batch["ip"], batch["chain"], batch["carried"], strict=True))
        starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        ts = batch["ts"].to_numpy()
        verdicts = np.zeros(len(batch), bool)
        for begin, end in zip(starts, [*starts[1:], len(keys)], strict=True):
            if keys[begin][:3] != current:
                current, hits = keys[begin][:3], deque()
            if keys[begin][3]:
                hits.extend(ts[begin:end].tolist())
                verdicts[begin:end] = True
                continue
            window, soft = int(batch["window"].iloc[begin]), int(batch["soft"].iloc[begin])
            while len(hits) > soft:
                hits.popleft()
            verdicts[begin:end] = _decide_run(ts[begin:end], window, soft, hits)
        yield batch.assign(soft_ok=verdicts)


COLUMNS = [*KEYS, "chain", "ts", "event_id", "window", "soft"]


def _run_chains(rows: DataFrame) -> DataFrame:
    """Decide rows of ``COLUMNS`` and carried; state rows come first."""
    order = [*KEYS, "chain", F.desc("carried"), "ts", "event_id"]
    rows = rows.select(*COLUMNS, "carried")
    schema = rows.schema.simpleString()[len("struct<"):-1] + ",soft_ok:boolean"
    ready = rows.repartition(*KEYS, "chain").sortWithinPartitions(*order)
    return ready.mapInPandas(_decide, schema)


def _slices(requests: DataFrame, chunk_rows: int) -> DataFrame:
    """Per key and time slice: its chain, its chunk in the chain and the chain's size."""
    counts = requests.groupBy(*KEYS, "slice", "width", "window").agg(F.count("*").alias("rows"))
    timeline = Window.partitionBy(*KEYS).orderBy("slice")
    chain = Window.partitionBy(*KEYS, "chain").orderBy("slice")
    gap = (F.col("slice") - F.lag("slice").over(timeline) - 1) * F.col("width")
    before = F.coalesce(
        F.sum("rows").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    marked = (
        counts.withColumn("opens", F.coalesce(gap >= F.col("window"), F.lit(True)).cast("bigint"))
        .withColumn("chain", F.sum("opens").over(timeline))
        .withColumn("before", before)
        .withColumn("bin", F.expr(f"before div {chunk_rows}"))
        .withColumn("oversize", F.col("rows") > chunk_rows)
    )
    cut = (
        F.col("oversize")
        | F.lag("oversize").over(chain)
        | (F.col("bin") != F.lag("bin").over(chain))
    )
    whole = Window.partitionBy(*KEYS, "chain")
    return (
        marked.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("bigint"))
        .withColumn("chunk", F.sum("cut").over(chain))
        .withColumn("chain_rows", F.sum("rows").over(whole))
        .withColumn("long", (F.max("chunk").over(whole) > 0) | F.max("oversize").over(whole))
        .select(*KEYS, "slice", "chain", "chunk", "chain_rows", "long", "oversize")
    )


def _possible(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of an oversize slice that can be admitted at all, given the carried hits.

    The slice is shorter than the window, so between two moments at which a carried hit
    expires no more than ``soft`` requests, the earliest ones, can be admitted.
    """
    expiry = state.groupBy(*KEYS, "chain").agg(
        F.collect_list(F.col("ts") + F.col("window")).alias("expiry")
    )
    stage = F.coalesce(
        F.size(F.filter("expiry", lambda e: e <= F.col("ts"))), F.lit(0)
    )
    staged = rows.join(expiry, [*KEYS, "chain"], "left").withColumn(
        "stage", F.when(F.col("expiry").isNull(), F.lit(0)).otherwise(stage)
    )
    # the largest limit lets the planner cut before the shuffle, the kind's own one decides
    most = rows.agg(F.max("soft")).first()[0] or 1
    return top_per_group(
        staged, [*KEYS, "chain", "stage"], [F.col("ts"), F.col("event_id")], most, "nth"
    ).filter(F.col("nth") <= F.col("soft")).drop("expiry", "stage", "nth")


def _decide_long_chains(rows: DataFrame) -> DataFrame:
    rows = materialize(rows, "long-chains")
    last = rows.agg(F.max("chunk")).first()[0]
    latest = [F.desc("ts"), F.desc("event_id")]
    state = rows.limit(0).select(*COLUMNS)
    most = rows.agg(F.max("soft")).first()[0] or 1
    admitted = []
    for number in range(0 if last is None else last + 1):
        chunk = rows.filter(F.col("chunk") == number)
        oversize = _possible(chunk.filter("oversize"), state)
        todo = chunk.filter("not oversize").unionByName(oversize)
        carried = state.withColumn("carried", F.lit(True))
        queue = todo.select(*COLUMNS, F.lit(False).alias("carried")).unionByName(carried)
        done = _run_chains(queue).filter("soft_ok")
        done = materialize(done.select(*COLUMNS, "carried"), "chunk-admitted")
        admitted.append(done.filter("not carried").select(*KEYS, "event_id"))
        state = top_per_group(done, [*KEYS, "chain"], latest, most, "nth") \
            .filter(F.col("nth") <= F.col("soft")).select(*COLUMNS)
    if not admitted:
        return rows.select(*KEYS, "ts", "event_id", F.lit(True).alias("soft_ok"))
    winners = reduce(DataFrame.unionByName, admitted).withColumn("soft_ok", F.lit(True))
    return rows.join(winners, [*KEYS, "event_id"], "left").select(
        *KEYS, "ts", "event_id", F.coalesce("soft_ok", F.lit(False)).alias("soft_ok")
    )


def soft_limit(
    requests: DataFrame, window: PerKind, soft: PerKind, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Adds ``soft_ok`` to (kind, ip, ts, event_id); ``ts`` and ``window`` in microseconds.

    A request is admitted while fewer than ``soft`` earlier admitted requests of its key
    lie less than ``window`` before it. Ids are unique.
    """
    sliced = (
        keyed(requests.select(*KEYS, "ts", "event_id"))
        .withColumn("window", by_kind(window))
        .withColumn("soft", by_kind(soft))
        .withColumn("width", F.expr(f"greatest(window div {SLICES_PER_WINDOW}, 1)"))
        .withColumn("slice", F.expr("(ts - pmod(ts, width)) div width"))
    )
    slices = materialize(_slices(sliced, chunk_rows), "time-slices")
    placed = sliced.join(slices, [*KEYS, "slice"])
    result = [*KEYS, "ts", "event_id", "soft_ok"]

    quiet = placed.filter(F.col("chain_rows") <= F.col("soft")).withColumn("soft_ok", F.lit(True))
    crowded = F.col("chain_rows") > F.col("soft")
    busy = placed.filter(crowded & ~F.col("long"))
    busy = _run_chains(busy.withColumn("carried", F.lit(False)))
    decided = quiet.select(*result).unionByName(busy.select(*result))
    if not slices.filter("long").isEmpty():
        decided = decided.unionByName(
            _decide_long_chains(placed.filter(crowded & F.col("long"))).select(*result)
        )
    return decided


def day_of(ts: Column) -> Column:
    """UTC day number of microseconds."""
    day = F.lit(86_400_000_000)
    return F.floor((ts - F.pmod(ts, day)) / day)


# rejected requests are not numbered; they go to so many parts of their key and day
REJECT_PARTS = 1024


def daily_cap(decided: DataFrame, daily: PerKind) -> DataFrame:
    """Adds ``daily_ok``: the first ``daily`` soft-admitted requests of a key and UTC day.

    A request the cap rejects has used its slot in the sliding window all the same. The
    soft limit bounds how many admitted rows a key and day can bring here.
    """
    part = F.when(F.col("soft_ok"), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64("event_id"), F.lit(REJECT_PARTS))
    )
    today = Window.partitionBy(*KEYS, day_of(F.col("ts")), part).orderBy("ts", "event_id")
    return decided.withColumn("_nth", F.row_number().over(today)).withColumn(
        "daily_ok", F.col("soft_ok") & (F.col("_nth") <= by_kind(daily))
    ).drop("_nth")


def limiter(
    requests: DataFrame,
    window: PerKind,
    soft: PerKind,
    daily: PerKind | None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Both limits. Requests with a true ``bypass`` skip them and are not recorded."""
    requests = keyed(requests)
    has_bypass = "bypass" in requests.columns
    skip = F.coalesce(F.col("bypass"), F.lit(False)) if has_bypass else F.lit(False)
    decided = soft_limit(requests.filter(~skip), window, soft, chunk_rows)
    if daily is None:
        decided = decided.withColumn("daily_ok", F.col("soft_ok"))
    else:
        decided = daily_cap(decided, daily)
    decided = decided.withColumn("admitted", F.col("soft_ok") & F.col("daily_ok"))
    if not has_bypass:
        return decided
    free = requests.filter(skip).select(*KEYS, "ts", "event_id")
    yes = {c: F.lit(True) for c in ("soft_ok", "daily_ok", "admitted")}
    return decided.unionByName(free.withColumns(yes))


def guard_limits(
    requests: DataFrame, limits: dict[str, tuple[int, int, int]] = GUARD_LIMITS
) -> DataFrame:
    """The limiter with the limits of each kind: soft, window in seconds, daily."""
    return limiter(
        requests,
        {kind: seconds * 1_000_000 for kind, (_, seconds, _) in limits.items()},
        {kind: soft for kind, (soft, _, _) in limits.items()},
        {kind: daily for kind, (_, _, daily) in limits.items()},
    )


def daily_counts(requests: DataFrame) -> DataFrame:
    return keyed(requests).groupBy(*KEYS, day_of(F.col("ts")).alias("day")).agg(
        F.count("*").alias("requests")
    )


def trailing_hits(requests: DataFrame, window: int) -> DataFrame:
    """Adds ``hits``: all requests of the key in the ``window`` microseconds up to each one.

    Requests of one key and moment are counted together. Each count enters at its moment and
    leaves a window later, and hits are the running balance. The changes are dealt to blocks
    of near equal numbers by key and time; a block starts from the balance of the earlier
    blocks of its key, so a hot key is shared by as many tasks as it needs.
    """
    rows = keyed(requests.select(*KEYS, "ts", "event_id"))
    moments = rows.groupBy(*KEYS, "ts").agg(F.count("*").alias("change"))
    leaving = moments.select(*KEYS, F.col("ts") + window, (-F.col("change")).alias("change"))
    changes = moments.unionAll(leaving).repartitionByRange(*KEYS, "ts").withColumn(
        "block", F.spark_partition_id()
    )
    changes = materialize(changes, "hit-changes")
    earlier = Window.partitionBy(*KEYS).orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    opening = changes.groupBy(*KEYS, "block").agg(F.sum("change").alias("balance")).select(
        *KEYS, "block", F.coalesce(F.sum("balance").over(earlier), F.lit(0)).alias("opening")
    )
    so_far = Window.partitionBy(*KEYS, "block").orderBy("ts").rangeBetween(
        Window.unboundedPreceding, 0
    )
    balance = (
        changes.withColumn("balance", F.sum("change").over(so_far))
        .filter("change > 0")
        .join(opening, [*KEYS, "block"])
        .select(*KEYS, "ts", (F.col("balance") + F.col("opening")).alias("hits"))
    )
    return rows.join(balance, [*KEYS, "ts"])
