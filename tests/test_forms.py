from pyspark.sql import functions as F

from lodescan.operators import intake as N
from lodescan.operators import leads as L
from lodescan.operators import requests as R
from lodescan.sources import sinks

LEAD = "lead_id int, received_at string, name string, email string, url string, tier string, score string, business string, works string, broken string, budget string, mockup boolean"


def leads(spark):
    rows = [
        (1, "t1", "Ann", "a@x.y", None, None, '{"grade":"B","pct":83}', None, "w" * 1500, "", None, True),
        (2, "t1", "Ann", "a@x.y", "u", "small", "C", "Shop", "", None, "5", None),
        (3, "t2", "", "b@x.y", *[None] * 8),
        (4, "t2", "Bob", None, *[None] * 8),
        (5, "t3", " ", "c", *[None] * 8),
    ]
    return spark.createDataFrame(rows, LEAD)


def test_validate_leads(spark):
    accepted, rejected = L.validate_leads(leads(spark))
    rows = {r.lead_id: r for r in accepted.collect()}
    assert set(rows) == {1, 2, 5}
    assert {r.lead_id for r in rejected.collect()} == {3, 4}
    assert (len(rows[1].works), rows[1].url, rows[1].mockup, rows[2].mockup) == (1000, "", True, False)


def test_lead_summary(spark):
    accepted, _ = L.validate_leads(leads(spark))
    rows = {r.lead_id: r for r in L.lead_summary(accepted).collect()}
    assert (rows[1].score_text, rows[2].score_text) == ("B (83%)", "C")
    assert (rows[1].headline, rows[2].headline) == ("Ann ()", "Shop (small)")
    assert rows[2].works_text == "(blank)" and "Mockup: YES" in rows[1].body


def test_last_lead_wins(spark):
    accepted, _ = L.validate_leads(leads(spark))
    assert {r.lead_id for r in sinks.latest_leads(accepted).collect()} == {2, 5}


def test_valid_email(column):
    cases = {" a@b.c ": "a@b.c", "a@b": None, "a b@c.d": None, "@b.c": None, "a@b.c\n": "a@b.c", "": None, None: None, "x" * 300 + "@b.c": "x" * 200}
    assert column(L.valid_email, list(cases)) == list(cases.values())


def submissions(spark):
    rows = [
        (1, " Cafe & Co ", "", "12 Main", "  ", ["Home", "FAQ"], "Open?", " Yes ", "", "ignored"),
        (2, None, None, "", None, [], "", "answer only", "Why?", ""),
        (3, "Bot", "x", "1", "1", ["Home"], "q", "a", "", ""),
        (4, "   ", "", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "submission_id int, business string, hp string, address string, phone string, pages array<string>, q1 string, a1 string, q2 string, a2 string")
    c = F.col
    layout = [
        ("Contact", [N.text_answer("Address", c("address")), N.text_answer("Phone", c("phone"))]),
        ("Pages", [N.choice_answer("Pages needed", c("pages"))]),
        ("FAQs", [N.faq_answer(1, c("q1"), c("a1")), N.faq_answer(2, c("q2"), c("a2"))]),
    ]
    return N.filter_honeypot(df.withColumn("sections", N.collect_sections(layout)))


def test_intake_flatten(spark):
    rows = N.intake_flatten(submissions(spark)).collect()
    got = sorted((r.submission_id, r.section_no, r.pos, r.section, r.q, r.v) for r in rows if r.q)
    assert got == [
        (1, 0, 0, "Contact", "Address", "12 Main"),
        (1, 1, 0, "Pages", "Pages needed", "Home, FAQ"),
        (1, 2, 0, "FAQs", "FAQ 1", "Open? — Yes"),
        (2, 0, 0, "FAQs", "FAQ 2", "Why?"),
    ]
    assert {r.submission_id for r in rows} == {1, 2, 4}
    assert {r.submission_id: r.business_label for r in rows}[4] == "a client"


def test_intake_markdown(spark):
    rows = {r.submission_id: r for r in N.intake_markdown(submissions(spark)).collect()}
    assert rows[1].slug == "cafe-co"
    assert rows[1].document == (
        "# Project Intake — Cafe & Co\n\n## Contact\n- **Address:** 12 Main\n\n"
        "## Pages\n- **Pages needed:** Home, FAQ\n\n## FAQs\n- **FAQ 1:** Open? — Yes\n"
    )
    assert (rows[4].slug, rows[4].document) == ("intake", "# Project Intake — your business\n")


def test_requests(spark):
    rows = [
        (1, "Newport", "", "US", "s" * 400, "u" * 200, "https://Tool.example", "tool.example", None),
        (2, None, "OR", None, None, None, "https://tool.example:8080", "tool.example", False),
        (3, "", None, "", None, None, "null", "tool.example", True),
        (4, "a", "b", "c", "", "", None, "tool.example", False),
    ]
    df = spark.createDataFrame(rows, "id int, city string, region string, country string, src string, ua string, origin string, host string, bypass boolean")
    df = df.withColumns({"org": F.lit(None).cast("string"), "ip": F.lit("1")})
    meta = {r.id: r for r in R.request_meta(df).collect()}
    assert [meta[i]["where"] for i in (1, 2, 3, 4)] == ["Newport, US", "OR", "", "a, b, c"]
    assert (len(meta[1].src), len(meta[1].ua), meta[3].owner_run, meta[2].org) == (300, 160, True, "")
    accepted, rejected = R.split_by_origin(df)
    assert {r.id for r in accepted.collect()} == {1, 3}
    assert {r.id for r in rejected.collect()} == {2, 4}
