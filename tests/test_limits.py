import random
from collections import defaultdict

import pytest

from lodescan.operators import limits as M


def brute_force(rows, window, soft, daily):
    """One request at a time, as the live limiter does."""
    hits, used, out = defaultdict(list), defaultdict(int), {}
    for kind, ip, ts, event in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (kind, ip)
        live = [t for t in hits[key] if ts - t < window]
        ok = len(live) < soft
        hits[key] = live + [ts] if ok else live
        counted = False
        if ok:
            day = (key, ts // 86_400_000_000)
            counted = daily is None or used[day] < daily
            used[day] += counted
        out[event] = (ok, counted)
    return out


def requests(seed, n, span, hot_share=0.4, step=1):
    r = random.Random(seed)
    rows = []
    for event in range(n):
        ip = "hot" if r.random() < hot_share else f"ip{r.randrange(12)}"
        rows.append((r.choice(["audit", "deep"]) if ip != "hot" else "audit", ip, r.randrange(span) // step * step, event))
    return rows


SCHEMA = "kind string, ip string, ts bigint, event_id bigint"


@pytest.mark.parametrize(
    "seed, n, span, window, soft, chunk, step",
    [
        (1, 400, 100_000, 3_200, 3, 1_000_000, 1),  # every chain in one task
        (2, 500, 40_000, 3_200, 3, 25, 1),  # the hot chain goes through many chunks
        (3, 500, 3_000, 3_200, 2, 10, 1),  # slices larger than a chunk
        (4, 300, 5_000, 160, 1, 7, 50),  # equal timestamps
        (5, 300, 900, 10, 4, 5, 1),  # window shorter than its slices
    ],
)
def test_soft_and_daily_equal_brute_force(spark, seed, n, span, window, soft, chunk, step):
    rows = requests(seed, n, span, step=step)
    df = spark.createDataFrame(rows, SCHEMA)
    out = M.limiter(df, window, soft, 5, chunk_rows=chunk).collect()
    assert len(out) == n
    expected = brute_force(rows, window, soft, 5)
    assert {r.event_id: (r.soft_ok, r.daily_ok) for r in out} == expected
    assert all(r.admitted == (r.soft_ok and r.daily_ok) for r in out)


def test_kinds_have_their_own_limits_and_nulls_one_ip(spark):
    r = random.Random(9)
    rows = []
    for event in range(400):
        ip = r.choice([None, "", "0.0.0.0", "a", "b"])
        rows.append((r.choice(["audit", "deep", "page"]), ip, r.randrange(40_000), event))
    limits = {"audit": (3, 0.004, 5), "deep": (1, 0.0025, 2), "page": (6, 0.001, 400)}
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (1_000_000, 20):
        out = M.limiter(
            df, {k: int(s * 1e6) for k, (_, s, _) in limits.items()},
            {k: v[0] for k, v in limits.items()}, {k: v[2] for k, v in limits.items()}, chunk_rows=chunk,
        ).collect()
        assert len(out) == len(rows)
        expected = {}
        for kind, (soft, seconds, daily) in limits.items():
            own = [(k, ip or "0.0.0.0", ts, e) for k, ip, ts, e in rows if k == kind]
            expected |= brute_force(own, int(seconds * 1e6), soft, daily)
        assert {r.event_id: (r.soft_ok, r.daily_ok) for r in out} == expected


def test_unknown_kinds_are_a_mistake(spark):
    df = spark.createDataFrame([("other", "a", 1, 1)], SCHEMA)
    with pytest.raises(Exception, match="no limits for kind other"):
        M.guard_limits(df).collect()


def test_null_kinds_and_ips_keep_their_rows(spark):
    rows = [(None, None, 1, 1), (None, None, 2, 2), ("a", "x", 1, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.event_id: r.soft_ok for r in M.soft_limit(df, 10, 1).collect()} == {1: True, 2: False, 3: True}
    assert {r.event_id: r.hits for r in M.trailing_hits(df, 10).collect()} == {1: 1, 2: 2, 3: 1}


def test_rejects_do_not_extend_the_window(spark):
    rows = [("audit", "a", t, i) for i, t in enumerate([0, 5, 9, 10, 19, 20])]
    out = M.soft_limit(spark.createDataFrame(rows, SCHEMA), 10, 1).orderBy("ts").collect()
    assert [r.soft_ok for r in out] == [True, False, False, True, False, True]


def test_bypass_records_nothing(spark):
    rows = [("audit", "a", t, t, t < 3) for t in range(5)]
    df = spark.createDataFrame(rows, SCHEMA + ", bypass boolean")
    out = M.limiter(df, 100, 1, None).collect()
    assert {r.event_id: r.admitted for r in out} == {0: True, 1: True, 2: True, 3: True, 4: False}


@pytest.mark.parametrize("window", [1_600, 37])
def test_trailing_hits(spark, window):
    rows = requests(7, 400, 9_000, step=10)
    out = M.trailing_hits(spark.createDataFrame(rows, SCHEMA), window).collect()
    by_key = defaultdict(list)
    for kind, ip, ts, event in rows:
        by_key[kind, ip].append(ts)
    expected = {e: sum(t - window < x <= t for x in by_key[k, i]) for k, i, t, e in rows}
    assert {r.event_id: r.hits for r in out} == expected


def test_daily_counts(spark):
    day = 86_400_000_000
    rows = [("a", "x", 0, 1), ("a", "x", day - 1, 2), ("a", "x", day, 3)]
    out = M.daily_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.day, r.requests) for r in out} == {(0, 2), (1, 1)}
