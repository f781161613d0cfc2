import json

from pyspark.sql import functions as F

from lodescan.operators import judgment as J
from lodescan.sources import sinks

FINDINGS = [
    {"priority": "high", "title": "No hours", "rec": "Add them"},
    {"priority": "high", "title": "Thin copy", "rec": "Confirm the address"},
    {"priority": "low", "title": "Likely fine"},
]


def reply(**fields):
    return json.dumps(fields)


def test_parse_model_json(column):
    texts = [
        "```json\n" + reply(role="a") + "\n```",
        "  " + reply(role="b") + " ",
        '{"role":"c"',
        '{"role":"d"} {"role":"e"}',
        '{"role":"f"},{"role":"g"}',
        "null",
        "",
        "[]",
        None,
    ]
    roles = column(lambda c: J.parse_model_json(c, J.PAGE_REPLY)["role"], texts)
    assert roles == ["a", "b"] + [None] * 7
    present = column(lambda c: J.parse_model_json(c, J.PAGE_REPLY).isNotNull(), texts)
    assert present == [True, True, False, False, False, False, False, True, False]


def test_hedges(column):
    hedged = {
        "please CONFIRM it": True, "reconfirm": False, "it may help": True, "may.": False,
        "maybe": False, "may  help": False, "might be": True, "could be": True, "could become": False,
        "check that": True, "check this": False, "check if": True, "check iffy": False,
        "unlikely": False, "likely": True, "not verified": True, "seems": True,
    }

    def priority(text):
        finding = F.struct(F.lit("high").alias("priority"), F.lit(None).cast("string").alias("title"), text.alias("rec"))
        return J.demote_hedged(F.array(finding))[0]["priority"]

    got = column(priority, list(hedged))
    assert got == ["med" if h else "high" for h in hedged.values()]


def results(spark):
    pages = spark.createDataFrame(
        [("a.com", 1, 10, "https://a.com/"), ("a.com", 2, 11, "https://a.com/x"), ("a.com", 3, 12, "https://a.com/y"), ("a.com", 4, 13, "bad")],
        "site_key string, crawl_rank int, page_id bigint, url string",
    )
    responses = spark.createDataFrame(
        [(10, reply(role="Home", findings=FINDINGS)), (11, "oops"), (12, None), (99, reply(role="x"))],
        "page_id bigint, text string",
    )
    return J.page_results(pages, responses)


def test_page_results(spark):
    rows = {r.page_id: r for r in results(spark).collect()}
    assert set(rows) == {10, 12, 13}  # 11 could not be parsed
    assert [f.priority for f in rows[10].findings] == ["high", "med", "low"]
    assert (rows[12].role, rows[12].findings) == ("", [])


def test_synthesis_and_report_lines(spark):
    text = J.synthesis_input(results(spark)).first().synthesis
    assert text == "https://a.com/ (Home): No hours; Thin copy; Likely fine\nhttps://a.com/y (): \nbad (): "
    summary = spark.createDataFrame([("a.com", 50)], "site_key string, site_size bigint")
    lines = J.report_lines(results(spark), summary).orderBy("pos").collect()
    assert [(x.path, x.label, x.coverage) for x in lines] == [
        ("/", "Critical", "3 of ~50"), ("/", "Important", "3 of ~50"), ("/", "Polish", "3 of ~50")
    ]
    assert J.report_lines(results(spark)).first().coverage == "3"


def test_deep_payload(spark):
    titled = results(spark).withColumn("title", F.lit("t"))
    pages = sinks.deep_payload(titled).first().pages
    assert [p.url for p in pages] == ["https://a.com/", "https://a.com/y", "bad"]


def test_clean_panel(column):
    row = {"name": "n" * 50, "role": "r" * 50, "comment": "c" * 300}
    panels = [reply(panel=[row] * 7), reply(panel=[]), reply(panel=None), "x", reply(panel=[{"name": "a"}])]
    got = column(J.clean_panel, panels)
    assert len(got[0]) == 6
    assert [len(v) for v in got[0][0]] == [30, 40, 260]
    assert got[1:4] == [None, None, None]
    assert tuple(got[4][0]) == ("a", "", "")


def speed(score, **lcp):
    audits = {"largest-contentful-paint": lcp} if lcp else {}
    return json.dumps({"lighthouseResult": {"categories": {"performance": {"score": score}}, "audits": audits}})


def test_speed_readings(spark):
    rows = [
        (1, "ok", speed(0.905, displayValue="2.1 s", numericValue=2100.5)),
        (2, "ok", speed(0.5)),
        (3, "ok", speed(0.49, displayValue="", numericValue=0)),
        (4, "ok", speed(None)),
        (5, "timeout", None),
        (6, "error", None),
        (7, "ok", "{}"),
    ]
    df = spark.createDataFrame(rows, "id int, status string, body string")
    got = {r.id: r for r in J.speed_readings(df).collect()}
    assert [got[i].score for i in range(1, 8)] == [91, 50, 49, None, 20, None, None]
    assert (got[1].lcp, got[1].lcp_ms) == ("2.1 s", 2100.5)
    assert (got[3].lcp, got[3].lcp_ms) == (None, None)
    assert got[1].read.startswith("Fast") and "takes 2.1 s to appear" in got[1].read
    assert got[2].read.startswith("Middling") and got[3].read.startswith("Slow")
    assert "40 seconds" in got[5].read and got[6].read is None


def test_site_reports(spark):
    rows = [("a", reply(summary="s", surfaces={"answer": "x"}, findings=FINDINGS)), ("b", "no")]
    got = {r.site_key: r.report for r in J.site_reports(spark.createDataFrame(rows, "site_key string, text string")).collect()}
    assert got["b"] is None
    assert (got["a"].summary, got["a"].surfaces.answer, got["a"].findings[1].priority) == ("s", "x", "med")
