from __future__ import annotations

import json

from pyspark.sql import functions as F

from docfathom.operators import model_json as J


def _read(spark, texts, *columns):
    return [tuple(r)[1:] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *(f(F.col("t")) for f in columns)).orderBy("i").collect()]


def test_answers_are_found_in_what_is_around_them(spark):
    cases = {
        '{"a":1}': '{"a":1}', '```json\n{"a":1}\n```': '{"a":1}', "```JSON {\"a\":1}```": '{"a":1}', 'x {"s":"} \\" {","p":{}} y {"k":2}': '{"p":{},"s":"} \\" {"}', '{"a":1': None, '{"a":1} tail': '{"a":1}', "{'a':1}": None,
        "": None, "null": "null", '5 {"a":2}': '{"a":2}', "5] x": None, '[1,{"a":2}]': '[1,{"a":2}]', 'say "{" {"a":1}': None, '{"a":1,"a":2}': None, "\\{": None, "}{}": "{}",
    }
    assert [r[0] for r in _read(spark, [*cases, None], lambda c: F.to_json(J.parsed(c)))] == [*cases.values(), None]
    assert _read(spark, ['{"t":"' + "{\\\"" * 50_000 + '"} x'], lambda c: F.length(J.first_object(c))) == [(150_008,)]


def test_only_a_whole_document_holds_an_answer(spark):
    cases = {' {"answer":" y "} ': "y", '```\n{"answer":"y"}\n```': "y", '{"answer":"y"} tail': '{"answer":"y"} tail', '{"answer":1}': '{"answer":1}', "[1]": "[1]", "plain": "plain", "": ""}
    assert [r[0] for r in _read(spark, [*cases, None], J.answer_text)] == [*cases.values(), ""]


def test_shapes_are_asserted_path_by_path(spark):
    claim = {"id": "c", "subquestionId": "s", "text": "t", "quote": "q", "citationIds": ["x"]}
    cases = [
        ({"claims": [claim], "more": 1}, []), ({"claims": []}, []), ({"claims": [claim] * 3, "unansweredSubquestions": ["s"]}, []), ({"claims": [claim] * 4}, [("$.claims", "too_many")]),
        ({"claims": {}}, [("$.claims", "not_array")]), ({}, [("$.claims", "missing")]), ([claim], [("$", "not_object")]), (None, [("$", "not_object")]),
        ({"claims": [claim, None, claim | {"id": 1, "quote": None}], "unansweredSubquestions": None}, [("$.claims[1]", "not_object"), ("$.claims[2].id", "not_string"), ("$.claims[2].quote", "not_string"), ("$.unansweredSubquestions", "not_array")]),
        ({"claims": [claim | {"citationIds": ["a", 2, []]}], "unansweredSubquestions": [True]}, [("$.claims[0].citationIds[1]", "not_string"), ("$.claims[0].citationIds[2]", "not_string"), ("$.unansweredSubquestions[0]", "not_string")]),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, None)], "i int, t string").select("i", J.parsed(F.col("t")).alias("v"), F.lit(1).alias("path"))
    got: dict[int, list] = {}
    for r in J.violations(rows, "i", "v", J.GROUNDED).collect():
        got.setdefault(r["i"], []).append((r["path"], r["rule"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: w for i, (_, w) in enumerate(cases) if w} | {99: [("$", "invalid_json")]}
    assert {r["i"] for r in rows.filter(J.conforms(F.col("v"), J.GROUNDED)).collect()} == {i for i, (_, w) in enumerate(cases) if not w}
    assert J.claims(rows, "i", "v").groupBy("i").count().filter("i = 2").first()["count"] == 3
    assert J.violations(rows.limit(0), "i", "v", J.GROUNDED).count() == 0


def test_a_verification_needs_its_memory_delta(spark):
    memory = {"activeTopic": "", "summaryUpdate": "", "explicitLearningProgress": [], "responsePreferences": []}
    good = {"claims": [{"id": "c", "supported": True, "directlyAnswers": False, "reasonCode": "x"}], "subquestions": [{"id": "s", "covered": True}], "memoryDelta": memory}
    cases = [(good, set()), (good | {"memoryDelta": []}, {"$.memoryDelta not_object"}), (good | {"memoryDelta": memory | {"activeTopic": None}}, {"$.memoryDelta.activeTopic not_string"}), (good | {"subquestions": [{"id": "s", "covered": "yes"}]}, {"$.subquestions[0].covered not_boolean"})]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, t string").select("i", J.parsed(F.col("t")).alias("v"))
    found = J.violations(rows, "i", "v", J.VERIFICATION).collect()
    assert [{f"{r['path']} {r['rule']}" for r in found if r["i"] == i} for i in range(len(cases))] == [w for _, w in cases]
