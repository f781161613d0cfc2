"""Forms posted as JSON texts, and the walk over JSON-LD trees."""

import json

from lodescan.functions import html as H
from lodescan.functions.text import strict_json
from lodescan.operators.jsonld import schema_types_walk
from lodescan.operators.posts import BAD_ITEM, BAD_SECTION, NOT_JSON, posted_answers, read_posts
from pyspark.sql import functions as F


def read(spark, *bodies):
    rows = [(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    forms, unread = read_posts(spark.createDataFrame(rows, "submission_id int, body string"))
    answers = sorted(
        ((r.submission_id, r.business_label, r.section_no, r.section, r.pos, r.q, r.v)
         for r in posted_answers(forms).collect()),
        key=lambda r: tuple(-1 if v is None else v for v in (r[0], r[2], r[4])),
    )
    return answers, {r.submission_id: r.reason for r in unread.collect()}


def items(*found):
    return {"business": "Cafe", "sections": [{"name": "S", "items": list(found)}]}


def test_items_of_any_shape(spark):
    answers, unread = read(spark, items(
        {"q": "a", "v": " b "}, {"q": None}, 7, "text", [], {"q": 1, "v": False},
        {"q": "list", "v": ["x", None, 2]}, {"q": "tree", "v": {"k": [1]}}, {"v": 2.5},
    ))
    assert unread == {}
    assert [r[5:] for r in answers] == [
        ("a", " b "), ("", ""), ("", ""), ("", ""), ("", ""), ("1", "false"), ("list", "x,,2"),
        ("tree", '{"k":[1]}'), ("", "2.5"),
    ]
    assert {r[:4] for r in answers} == {(0, "Cafe", 0, "S")} and [r[4] for r in answers] == list(range(9))


def test_forms_without_answers_keep_a_row(spark):
    answers, unread = read(
        spark, {}, "null", "5", [], {"sections": []}, {"sections": "x"}, {"sections": {"items": [1]}},
        {"sections": [{"name": "N"}, 3, {"items": []}, {"items": 0, "name": 4}]},
    )
    assert unread == {}
    assert answers[:7] == [(i, "a client", *[None] * 5) for i in range(7)]
    assert [r[2:] for r in answers[7:]] == [
        (0, "N", None, None, None), (1, "", None, None, None), (2, "", None, None, None),
        (3, "4", None, None, None),
    ]


def test_unreadable_forms_go_aside_and_bots_nowhere(spark):
    bad = [
        None, "", "{", "{} {}", '{"a":1}, {"b":2}', "1],[2", '1},{"v":2', "{'a':1}",
        {"sections": [None]}, {"sections": [{"items": {"q": 1}}]}, {"sections": [{"items": "x"}]},
        items({"q": "a"}, None),
    ]
    bots = [
        {"hp": "x"}, {"hp": 1}, {"hp": True}, {"hp": []}, {"hp": {}, "sections": [None]}, {"hp": " "},
    ]
    answers, unread = read(spark, *bad, *bots)
    assert answers == []
    assert unread == dict(enumerate([NOT_JSON] * 8 + [BAD_SECTION] * 3 + [BAD_ITEM]))


def test_business_label_and_empty_hidden_field(spark):
    given = ["", None, "  ", 0, False, [], 42, True, " a ", "x" * 130, "y" * 119 + "  z"]
    answers, _ = read(spark, *({"business": b, "hp": h} for b, h in zip(given, ["", None, False, 0] * 3)))
    assert [r[1] for r in answers] == ["a client"] * 6 + ["42", "true", "a", "x" * 120, "y" * 119]


def test_no_posts(spark):
    assert read(spark.createDataFrame([], "a int").sparkSession) == ([], {})


def test_strict_json(column):
    texts = ["1", " [1] ", "null", '"a"', "1 2", "1,2", "1],[2", '1},{"v":2', '1,"v":2', "", None, "01", "[1],"]
    found = column(lambda v: F.to_json(strict_json(v)), texts)
    assert found == ["1", "[1]", "null", '"a"'] + [None] * 9


def python_types(node, found):
    if isinstance(node, list):
        for child in node:
            python_types(child, found)
    elif isinstance(node, dict):
        own = node.get("@type")
        if isinstance(own, str) and own:
            found.add(own)
        if isinstance(own, list):
            found.update(x for x in own if isinstance(x, str))
        for child in node.values():
            python_types(child, found)
    return found


def test_walk_meets_every_level(spark):
    deep = {"@type": "Leaf"}
    for _ in range(120):
        deep = {"x": [deep]}
    blocks = [
        [{"@type": "A", "x": {"@type": ["B", "", None]}}, {"@type": ""}, {"@type": "A"}],
        [], deep, {"@type": {"@type": "In"}}, {"a": "\"@type\":\"no\""}, 5, "text",
        {"@graph": [{"@type": ["C[", "D]"], "y": [[[{"@type": "E"}]]]}]},
    ]
    pages = [(i, f'<script type="application/ld+json">{json.dumps(b)}</script>') for i, b in enumerate(blocks)]
    pages += [(100, None), (101, "<p>none</p>"), (102, '<script type="application/ld+json">{"@type":"X"},{}</script>')]
    frame = spark.createDataFrame(pages, "page_id int, html string")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = {r.page_id: r.schema_types for r in schema_types_walk(frame).collect()}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit
    assert got == {i: sorted(python_types(b, set())) for i, b in enumerate(blocks)} | {
        100: [], 101: [], 102: []
    }
    tree = frame.filter("html is not null").select("page_id", H.schema_types_tree(F.col("html")).alias("t"))
    assert {r.page_id: sorted(r.t) for r in tree.collect()} == {i: t for i, t in got.items() if i != 100}
