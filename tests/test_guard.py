"""The guard on typed state against the batch job and one request at a time."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import Row, functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from lodescan.operators import limits as M
from lodescan.session import new_folder
from lodescan.streaming import guard as G
from lodescan.streaming.limiter import run_available
from tests.test_limits import brute_force

REQUEST = "kind string, ip string, ts bigint, event_id bigint, bypass boolean"
LIMITS = {"audit": (3, 4, 5), "deep": (1, 3, 2), "page": (6, 1, 400)}
SECOND = 1_000_000


def batches(spark, parts, schema=REQUEST):
    """A stream that takes each list of rows as one micro-batch."""
    folder = new_folder(spark, "guard-source")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def requests(seed, n=250, span=40 * SECOND):
    draw = random.Random(seed)
    return [(draw.choice(list(LIMITS)), draw.choice([None, "", "a", "a", "a", "b"]), draw.randrange(span), event,
             draw.random() < 0.1) for event in range(n)]


def expected(rows):
    found = {e: (True, True) for *_, e, bypass in rows if bypass}
    for kind, (soft, seconds, daily) in LIMITS.items():
        own = [(k, ip or "0.0.0.0", ts, e) for k, ip, ts, e, bypass in rows if k == kind and not bypass]
        found |= brute_force(own, seconds * SECOND, soft, daily)
    return found


def decisions(out):
    return {r.event_id: (r.soft_ok, r.daily_ok) for r in out.collect()}


def test_typed_state_decides_as_one_request_at_a_time(spark):
    rows = sorted(requests(1), key=lambda r: (r[2], r[3]))
    stream = batches(spark, [rows[:90], rows[90:91], rows[91:]])
    out = run_available(G.guard_stream(stream, LIMITS, live=False), spark, "typed")
    assert decisions(out) == expected(rows)
    assert out.filter("late").isEmpty()
    assert {r.admitted for r in out.filter("soft_ok and daily_ok").select("admitted").distinct().collect()} == {True}


def test_requests_that_come_late_are_marked(spark):
    rows = [("audit", "a", 9 * SECOND, 1, False), ("audit", "a", 5 * SECOND, 2, False), ("deep", "a", 5 * SECOND, 3, False)]
    out = run_available(G.guard_stream(batches(spark, [[r] for r in rows]), LIMITS, live=False), spark, "marked")
    assert {r.event_id: r.late for r in out.collect()} == {1: False, 2: True, 3: False}


@pytest.mark.parametrize("seed", [2, 3])
def test_any_arrival_within_the_delay_gives_the_batch_result(spark, seed):
    """Rows are shuffled by less than the delay; some come much later and are set aside."""
    draw = random.Random(seed)
    rows, delay = requests(seed), 6 * SECOND
    behind = [r for r in rows if r[3] % 17 == 4 and r[2] < 20 * SECOND]
    on_time = sorted((r for r in rows if r not in behind), key=lambda r: r[2] + draw.randrange(delay - 1_000))
    beat = [("page", "x", 60 * SECOND, None, False)]
    stream = batches(spark, [on_time[:70], on_time[70:140], on_time[140:], behind, beat])
    out = run_available(G.guard_in_event_time(stream, "6 seconds", LIMITS), spark, "event-time")
    late = {r[3] for r in behind if not r[4]}
    assert {r.event_id for r in out.filter("late").collect()} == late
    assert decisions(out.filter("not late")) == expected([r for r in rows if r[3] not in late])
    assert out.count() == len(rows)
    # and that is what the batch job decides
    limits = {k: (soft, seconds, daily) for k, (soft, seconds, daily) in LIMITS.items()}
    batch = M.guard_limits(spark.createDataFrame([r for r in rows if r[3] not in late], REQUEST), limits)
    assert decisions(batch) == decisions(out.filter("not late"))


def test_what_waits_is_not_decided(spark):
    rows = [("audit", "a", 10 * SECOND, 1, False), ("audit", "a", 30 * SECOND, 2, False)]
    out = run_available(G.guard_in_event_time(batches(spark, [rows]), "6 seconds", LIMITS), spark, "waiting")
    assert [r.event_id for r in out.collect()] == [1]


def test_the_chain_ends_foreign_requests_first(spark):
    """A request from a foreign origin uses up no limit; the owner's passes without one."""
    schema = REQUEST + ", origin string, host string"
    rows = [("deep", "a", SECOND, 1, False, "https://evil.example", "tool.example"),
            ("deep", "a", 2 * SECOND, 2, False, "https://tool.example", "tool.example"),
            ("deep", "a", 3 * SECOND, 3, True, None, None),
            ("deep", "a", 4 * SECOND, 4, None, "https://tool.example", "tool.example"),
            ("deep", "a", 9 * SECOND, 5, False, "https://tool.example", "tool.example"),
            ("deep", "a", 20 * SECOND, 6, False, "https://tool.example", "tool.example")]
    wanted = {1: "origin", 2: "admitted", 3: "admitted", 4: "soft", 5: "admitted", 6: "daily"}
    batch = G.guarded(spark.createDataFrame(rows, schema), lambda r: M.guard_limits(r, LIMITS))
    assert {r.event_id: r.outcome for r in batch.collect()} == wanted
    stream = batches(spark, [rows[:3], rows[3:]], schema)
    out = run_available(G.guarded(stream, lambda r: G.guard_stream(r, LIMITS, live=False)), spark, "chain")
    assert {r.event_id: r.outcome for r in out.collect()} == wanted


def test_live_state_has_lifetimes(spark):
    """A live guard runs on the clock and keeps its state from batch to batch until it expires."""
    stream = batches(spark, [[("deep", "a", SECOND, 1, False)], [("deep", "a", 2 * SECOND, 2, False)]])
    out, checkpoint = new_folder(spark, "live"), new_folder(spark, "live-checkpoint")
    query = (
        G.guard_stream(stream, LIMITS).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).start()
    )
    try:  # on the clock, batches go on when there is nothing to read
        ends = time.monotonic() + 60
        while time.monotonic() < ends and sum(p["numInputRows"] for p in query.recentProgress) < 2:
            time.sleep(0.2)
        time.sleep(1)
    finally:
        query.stop()
    assert {r.event_id: r.admitted for r in spark.read.parquet(out).collect()} == {1: True, 2: False}
    assert query.exception() is None


class Kept(dict):
    """A state map that counts the messages it would cost, and the values that it hands out."""

    messages, handed = 0, 0

    def getValue(self, key):
        self.messages += 1
        found = self.get(tuple(key))
        self.handed += len(found[0]) if found and isinstance(found[0], list) else 0
        return found

    def updateValue(self, key, value):
        self.messages += 1
        self[tuple(key)] = value

    def removeKey(self, key):
        self.messages += 1
        del self[tuple(key)]


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Kept())

    def registerTimer(self, at):
        self.timers.add(at)


def test_what_waits_is_read_when_its_slice_is_due_and_ips_share_a_state():
    """Forty batches under a delay of ten minutes: a waiting request is read once or twice."""
    delay, step = 600 * SECOND, 20 * SECOND
    guard, handle = G.EventTimeGuard({"audit": (2, 60, 5)}), Handle()
    guard.init(handle)
    rows, out, batches = [], [], 0
    draw = random.Random(9)
    for number in range(40):
        passed = TimerValues(-1, max(0, (number * step - delay) // 1000))
        part = [Row(ip=f"ip{draw.randrange(20)}", ts=number * step - draw.randrange(delay // 2) + delay, bypass=False,
                    event_id=100 * number + i) for i in range(100)]
        rows += part
        out += guard.handleInputRows(("audit", 3), iter(part), passed)
        for at in sorted(t for t in handle.timers if t <= passed.getCurrentWatermarkInMs()):
            out += guard.handleExpiredTimer(("audit", 3), passed, None)
            handle.timers.discard(at)
            batches += 1
    while handle.timers:  # as a heartbeat would
        last = TimerValues(-1, 10**9)
        at = min(handle.timers)
        out += guard.handleExpiredTimer(("audit", 3), last, None)
        handle.timers.discard(at)
    own = [("audit", r.ip, r.ts, r.event_id) for r in rows]
    assert {r.event_id: (r.soft_ok, r.daily_ok) for r in out} == brute_force(own, 60 * SECOND, 2, 5)
    assert len(out) == len(rows) and not any(r.late for r in out)
    waiting, days = handle.maps["waiting"], handle.maps["days"]
    assert not waiting and waiting.handed <= 2 * len(rows)
    # a read and a write for each ip that a decided batch names, at most
    assert len(days) == 20 and days.messages <= 2 * 20 * (batches + 1)


def test_unknown_kinds_are_a_mistake(spark):
    stream = batches(spark, [[("other", "a", SECOND, 1, False)]])
    with pytest.raises(Exception, match="no limits for kind other"):
        run_available(G.guard_stream(stream, LIMITS, live=False), spark, "unknown")


def test_many_keys_and_batches_equal_the_batch_job(spark):
    draw = random.Random(5)
    rows = sorted(((draw.choice(list(LIMITS)), f"ip{min(draw.randrange(60), 20)}", draw.randrange(90 * SECOND), e, False)
                   for e in range(600)), key=lambda r: (r[2], r[3]))
    stream = batches(spark, [rows[at:at + 200] for at in range(0, 600, 200)])
    out = run_available(G.guard_stream(stream, LIMITS, live=False), spark, "many")
    batch = M.guard_limits(spark.createDataFrame(rows, REQUEST).drop("bypass"), LIMITS)
    assert decisions(out) == decisions(batch) == expected(rows)
    per_key = defaultdict(int)
    for r in rows:
        per_key[r[0], r[1]] += 1
    assert out.count() == sum(per_key.values())
    assert out.filter(F.col("admitted") != (F.col("soft_ok") & F.col("daily_ok"))).isEmpty()
