from pyspark.sql import functions as F

from lodescan.functions import scoring as S
from lodescan.operators import audit as A

NONE = {
    "has_organization": False, "complete_local_entity": False, "has_faq_schema": False,
    "question_headings": 0, "pages_with_schema": 0, "schema_types": [], "pages_with_meta": 0,
    "page_count": 10, "home_title": "", "has_breadcrumb": False, "home_img_count": 4,
    "home_img_with_alt": 0, "is_https": False, "has_viewport": False, "has_og": False,
    "looks_stale": True, "commerce_state": "none", "has_entity_graph": False,
    "has_local_business": False,
}
ALL = {
    "has_organization": True, "complete_local_entity": True, "has_faq_schema": True,
    "question_headings": 3, "pages_with_schema": 1, "schema_types": ["a", "b", "c"],
    "pages_with_meta": 8, "home_title": "A fine descriptive title", "has_breadcrumb": True,
    "home_img_with_alt": 4, "is_https": True, "has_viewport": True, "has_og": True,
    "looks_stale": False, "has_entity_graph": True, "has_local_business": True,
}
SCHEMA = (
    "has_organization boolean, complete_local_entity boolean, has_faq_schema boolean, "
    "question_headings bigint, pages_with_schema bigint, schema_types array<string>, "
    "pages_with_meta bigint, page_count bigint, home_title string, has_breadcrumb boolean, "
    "home_img_count int, home_img_with_alt int, is_https boolean, has_viewport boolean, "
    "has_og boolean, looks_stale boolean, commerce_state string, has_entity_graph boolean, "
    "has_local_business boolean"
)


def scores(spark, *changes):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [[({**NONE, **change})[n] for n in names] for change in changes]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    return A.with_scores(df).select("pct", "grade", "organic", "answer", "local").collect()


def test_extremes(spark):
    low, high, plain, empty = scores(
        spark, {}, ALL, {**ALL, "has_og": False}, {"commerce_state": "installed_empty"}
    )
    assert tuple(low) == (8, "F", 0, 0, 0)
    assert (high.pct, high.grade) == (94, "A")  # 97 points, capped
    assert (high.organic, high.answer, high.local) == (94, 100, 95)
    assert plain.pct == 93  # all weights but the one for social tags
    assert empty.pct == 8  # floored


def test_no_entity_graph_caps_the_score(spark):
    capped, = scores(spark, {**ALL, "has_entity_graph": False})
    assert (capped.pct, capped.grade) == (79, "C")


def test_steps(spark):
    one, three, two_types, meta, title, images = scores(
        spark,
        {"question_headings": 1},
        {"question_headings": 3},
        {"schema_types": ["a", "b"], "pages_with_schema": 1},
        {"pages_with_meta": 7},
        {"home_title": "Untitled page of this site"},
        {"home_img_count": 0},
    )
    assert (one.answer, three.answer) == (9, 18)
    assert two_types.answer == 18
    assert meta.organic == 21
    assert title.organic == 0
    assert images.organic == 18


def test_tier_boundaries(spark):
    sizes = [6, 7, 19, 20, 49, 50]
    df = spark.createDataFrame([(s, h) for h in (False, True) for s in sizes], "p int, h boolean")
    tiers = [r[0] for r in df.coalesce(1).select(S.classify(F.col("p"), F.col("h"))).collect()]
    assert tiers[:6] == ["small", "medium", "medium", "large", "large", "enterprise"]
    assert set(tiers[6:]) == {"large"}


def test_grades_and_bands(spark):
    values = [59, 60, 69, 70, 79, 80, 89, 90, None]
    df = spark.createDataFrame([(v,) for v in values], "p int").coalesce(1)
    rows = df.select(S.letter_grade(F.col("p")).alias("g"), S.grade_color(F.col("p")).alias("c")).collect()
    assert [r.g for r in rows][:8] == list("FDDCCBBA")
    assert rows[8].c == "#e8a07a" and rows[0].c == "#e2735a" and rows[7].c == "#7fd0a8"
    meter = spark.createDataFrame([(39.4,), (39.5,), (70.0,), (140.0,), (None,)], "v double").coalesce(1)
    rows = meter.select(S.meter_value(F.col("v")).alias("v")).withColumn("c", S.meter_color(F.col("v"))).collect()
    assert [r.v for r in rows] == [39, 40, 70, 100, 0]
    assert [r.c for r in rows] == ["#c0492a", "#c9952f", "#2f4a3e", "#2f4a3e", "#c0492a"]


def test_quotes(spark):
    quotes = {r.tier: r for r in A.tier_quotes(spark).collect()}
    assert {t: q.quote_total for t, q in quotes.items()} == {
        "small": 2000, "medium": 5000, "large": 9500, "enterprise": None
    }
    assert quotes["enterprise"].enterprise and quotes["enterprise"].phases is None
    assert quotes["large"].first_price == 2500 and len(quotes["large"].phases) == 3


def test_offers_and_labels(spark):
    df = spark.createDataFrame([(True, 95), (False, 90), (False, 89), (False, None)], "e boolean, p int").coalesce(1)
    assert [r[0] for r in df.select(S.offer_kind(F.col("e"), F.col("p"))).collect()] == ["call", "refresh", "phase_1", "phase_1"]
    df = spark.createDataFrame([("high",), ("med",), ("low",), (None,)], "p string").coalesce(1)
    assert [r[0] for r in df.select(S.priority_label(F.col("p"))).collect()] == ["Critical", "Important", "Polish", "Polish"]


def test_second_attempts_follow_fast_failures_only(spark):
    """Against the rule, attempt by attempt: after 429 and 5xx once, never after a timeout."""
    from itertools import product

    from lodescan.operators.judgment import speed_outcomes

    ends = [("http", 200), ("http", 404), ("http", 429), ("http", 500), ("timeout", None), ("network", None), None]
    rows, wanted = [], {}
    for page, made in enumerate(product(ends[:-1], ends)):
        final = made[0]
        for n, end in enumerate(made):
            if end:
                rows.append((page, n, *end, f"b{page}-{n}"))
        if made[0][0] == "http" and made[0][1] in (429, 500):
            final = made[1]
        number = 1 if final is made[1] and made[0][0] == "http" and made[0][1] in (429, 500) else 0
        kind = "error" if final is None or final[0] == "network" else final[0]
        if kind == "http":
            kind = "ok" if final[1] == 200 else "error"
        wanted[page] = (kind, f"b{page}-{number}" if kind == "ok" else None)
    rows.append((0, 2, "timeout", None, None))  # a third attempt is never looked at
    attempts = spark.createDataFrame(rows, "page_id int, attempt int, ended string, http int, body string")
    found = {r.page_id: (r.status, r.body) for r in speed_outcomes(attempts).collect()}
    assert found == wanted
