"""The whole request guard on a stream: origin, owner's bypass, limits of each kind.

Two operators over Spark's typed state variables, each with a lifetime of its own in the RocksDB
store. ``guard_stream`` decides on arrival, as a live guard must, and marks requests older than
one of their key decided before. ``guard_in_event_time`` holds requests until the watermark has
passed them and decides them in the order of (ts, event_id) by event-time timers, so that every
arrival order within the delay gives what the batch job gives; what comes later than that is not
decided but returned as ``late``.

Ips are dealt to ``IP_BUCKETS`` buckets of a kind, whose state is one: a key of its own for each
ip costs some ten messages between the worker and the store in every batch that names it. Per
bucket, maps by ip hold the last admitted times and, apart as it lives longer, the newest time
with the admitted requests per day; only the ips of a batch are read and written. In event time
the waiting requests lie in slices of time, each batch's apart, so that they are read when their
slice is due and not in every batch. An ip of many requests is one task's work in either
operator, as each decision depends on the one before; what it holds is bounded by the limit, or
by the requests of one delay.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..operators.limits import KEYS, keyed
from ..operators.requests import passes_origin

DECIDED = "kind string, ip string, ts bigint, event_id bigint, soft_ok boolean, daily_ok boolean, admitted boolean, late boolean"
DAY = 86_400_000_000
# buckets of the ips of a kind; a stored stream keeps its own
IP_BUCKETS = 256
# microseconds of a slice of waiting requests
SLICE = 60_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Limits = dict[str, tuple[int, int, int]]
Decision = tuple[bool | None, bool | None]


def use_typed_state(spark: SparkSession) -> None:
    """State variables need the RocksDB store; set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Guard(StatefulProcessor):
    """Decides on arrival; requests of an ip in one micro-batch in the order of (ts, event_id)."""

    def __init__(self, limits: Limits, live: bool) -> None:
        self.limits, self.live = limits, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        longest = max(seconds for _, seconds, _ in self.limits.values()) * 1000
        day = V.DAILY_STATE_TTL_SECONDS * 1000
        hits_ttl, day_ttl = (longest, day) if self.live else (None, None)
        self.handle = handle
        self.hits = handle.getMapState("hits", "ip string", "ts array<bigint>", hits_ttl)
        self.days = handle.getMapState(
            "days", "ip string", "newest bigint, days array<bigint>, used array<bigint>", day_ttl
        )

    def _decide(
        self, kind: str, ip: str, todo: list[tuple[int, int]], marks: bool = True
    ) -> Iterator[Row]:
        """Decide requests of one ip in order; its state is read and written once."""
        if kind not in self.limits:
            raise ValueError(f"no limits for kind {kind}")
        soft, seconds, daily = self.limits[kind]
        window = seconds * 1_000_000
        known = self.days.getValue((ip,))
        newest, days, counts = known if known else (None, [], [])
        used = dict(zip(days, counts, strict=True))
        # hits live no longer than the days
        stored = self.hits.getValue((ip,)) if known else None
        before = sorted(stored[0]) if stored else []
        hits, last = before, newest
        for ts, event_id in todo:
            hits = [t for t in hits if ts - t < window]
            soft_ok, daily_ok = len(hits) < soft, False
            if soft_ok:
                hits.append(ts)
                day = ts // DAY
                daily_ok = used.get(day, 0) < daily
                if daily_ok:
                    used[day] = used.get(day, 0) + 1
            yield _row(kind, ip, ts, event_id, (soft_ok, daily_ok),
                       marks and newest is not None and ts < newest)
            last = ts if last is None else max(last, ts)
        if hits != before:
            self.hits.updateValue((ip,), (hits,)) if hits else self.hits.removeKey((ip,))
        if self.live:
            # a counter's lifetime ends a day after its last request, not with the ip
            oldest = (last - V.DAILY_STATE_TTL_SECONDS * 1_000_000) // DAY
            used = {day: n for day, n in used.items() if day >= oldest}
        if self.live or (last, used) != (newest, dict(zip(days, counts, strict=True))):
            self.days.updateValue((ip,), (last, list(used), list(used.values())))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        todo = defaultdict(list)
        for r in rows:
            if r.bypass:
                yield _row(key[0], r.ip, r.ts, r.event_id, (True, True), False)
            else:
                todo[r.ip].append((r.ts, r.event_id))
        for ip, held in todo.items():
            yield from self._decide(key[0], ip, sorted(held))

    def close(self) -> None:
        pass


class EventTimeGuard(Guard):
    """Holds requests until the watermark has passed them."""

    def __init__(self, limits: Limits) -> None:
        super().__init__(limits, live=False)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState(
            "waiting", "slice bigint, part bigint", "ips array<string>, ts array<bigint>, ids array<bigint>"
        )

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = []
        for r in rows:
            if r.event_id is None:  # a heartbeat, which moves the watermark only
                continue
            if r.bypass:
                yield _row(key[0], r.ip, r.ts, r.event_id, (True, True), False)
            elif r.ts // 1000 < passed:
                yield _row(key[0], r.ip, r.ts, r.event_id, (None, None), True)
            else:
                held.append((r.ts, r.event_id, r.ip))
        if held:
            self._hold(held)
            self._wake(min(held)[0])

    def _hold(self, held: list[tuple[int, int, str]]) -> None:
        """Store requests by slice, under a number that no part of the bucket has."""
        part = 1 + max((part for _, part in self.waiting.keys()), default=0)
        slices = defaultdict(list)
        for request in held:
            slices[request[0] // SLICE].append(request)
        for number, requests in slices.items():
            ts, ids, ips = map(list, zip(*requests, strict=True))
            self.waiting.updateValue((number, part), (ips, ts, ids))

    def _wake(self, ts: int) -> None:
        self.handle.registerTimer(ts // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        stored = [tuple(k) for k in self.waiting.keys()]
        due, left = defaultdict(list), []
        for place in stored:
            if place[0] * SLICE // 1000 >= passed:
                continue
            ips, times, ids = self.waiting.getValue(place)
            for ip, ts, event_id in zip(ips, times, ids, strict=True):
                if ts // 1000 < passed:
                    due[ip].append((ts, event_id))
                else:
                    left.append((ts, event_id, ip))
            self.waiting.removeKey(place)
        for ip, requests in due.items():
            yield from self._decide(key[0], ip, sorted(requests), marks=False)
        if left:
            self._hold(left)
        if due:
            # the first that still waits: of the slice in part, or of a whole one
            later = [place[0] * SLICE for place in stored if place[0] * SLICE // 1000 >= passed]
            if left or later:
                self._wake(min(left)[0] if left else min(later))


def _row(kind: str, ip: str, ts: int, event_id: int, decision: Decision, late: bool) -> Row:
    soft_ok, daily_ok = decision
    admitted = None if soft_ok is None else soft_ok and daily_ok
    return Row(kind=kind, ip=ip, ts=ts, event_id=event_id, soft_ok=soft_ok,
               daily_ok=daily_ok, admitted=admitted, late=late)


def _decided(requests: DataFrame, processor: StatefulProcessor, time_mode: str) -> DataFrame:
    bypass = F.col("bypass") if "bypass" in requests.columns else F.lit(False)
    bucket = F.pmod(F.xxhash64("ip"), F.lit(IP_BUCKETS)).alias("bucket")
    rows = keyed(requests).select(*KEYS, "ts", "event_id", F.coalesce(bypass, F.lit(False)).alias("bypass"), bucket)
    return rows.groupBy("kind", "bucket").transformWithState(processor, DECIDED, "Append", time_mode)


def guard_stream(requests: DataFrame, limits: Limits = V.GUARD_LIMITS, live: bool = True) -> DataFrame:
    """Decide a stream of (kind, ip, ts, event_id) on arrival; ``ts`` in microseconds.

    Requests with a true ``bypass`` pass and are not recorded. ``live`` lets hits and day
    counters expire by the clock; a replay of stored requests keeps them.
    """
    use_typed_state(requests.sparkSession)
    return _decided(requests, Guard(limits, live), "ProcessingTime" if live else "None")


def guard_in_event_time(
    requests: DataFrame, delay: str, limits: Limits = V.GUARD_LIMITS
) -> DataFrame:
    """Decide a stream in the order of its own times, which may come late by ``delay``.

    A row without ``event_id`` is a heartbeat: it moves the watermark, and nothing else.
    """
    use_typed_state(requests.sparkSession)
    timed = requests.withColumn("at", F.timestamp_micros("ts")).withWatermark("at", delay)
    # the state operator itself would drop late rows, if it saw the watermark's column
    return _decided(timed.drop("at"), EventTimeGuard(limits), "EventTime")


def outcome() -> Column:
    """What became of a decided request: late, soft, daily or admitted."""
    return (
        F.when(F.col("late") & F.col("soft_ok").isNull(), F.lit("late"))
        .when(~F.col("soft_ok"), F.lit("soft")).when(~F.col("daily_ok"), F.lit("daily"))
        .otherwise(F.lit("admitted"))
    )


def guarded(log: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(event_id, kind, ip, outcome) of requests with origin, host and bypass.

    Requests from a foreign origin end there (``origin``) and use up no limit; ``decide`` is
    one of the guards, of the stream or of the batch job.
    """
    passes = passes_origin()
    names = ["event_id", *KEYS]
    decided = decide(log.filter(passes))
    if "late" not in decided.columns:
        decided = decided.withColumn("late", F.lit(False))
    foreign = keyed(log.filter(~passes)).select(*names, F.lit("origin").alias("outcome"))
    return decided.select(*names, outcome().alias("outcome")).unionByName(foreign)
