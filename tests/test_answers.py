"""Sources of captured answers and nodes of JSON texts."""

import json

import pytest

from veritrail.operators import corpus as K

REF = {"type": "ai_overview_reference", "url": "https://a.example/x", "title": "X", "text": "an excerpt"}
LINK = {"type": "link_element", "url": "http://b.example", "text": "not an excerpt"}


def body(answer, *more):
    return json.dumps({"tasks": [{"result": [{"items": [answer, *more]}]}]})


def answer(**fields):
    return {"type": "ai_overview", "markdown": "Full text.", "references": [REF]} | fields


CASES = {
    "whole": (body(answer()), "available", []),
    "no references at all": (body({"type": "ai_overview", "markdown": "x"}), "unknown", []),
    "none given": (body(answer(references=[])), "available", []),
    "null references": (body(answer(references=None)), "unknown", []),
    "links alone": (body({"type": "ai_overview", "markdown": "x", "links": [LINK]}), "incomplete", []),
    "two items": (body(answer(), answer()), "incomplete", []),
    "unknown kind": (body(answer(type="other")), "incomplete", ["unsupported_source_structure"]),
    "unknown field": (body(answer(colour=1)), "incomplete", ["unsupported_source_fields"]),
    "images": (body(answer(images={})), "incomplete", ["unsupported_source_fields"]),
    "no images": (body(answer(images=[])), "available", []),
    "fragment inside": (body(answer(items=[{"type": "ai_overview_element", "markdown": "Full", "references": []}])), "available", []),
    "fragment outside": (body(answer(items=[{"type": "ai_overview_element", "markdown": "Other", "references": []}])), "incomplete", ["fragment_not_in_aggregate_answer"]),
    "element without references": (body(answer(items=[{"type": "ai_overview_element"}])), "incomplete", []),
    "items no list": (body(answer(items={})), "incomplete", ["unsupported_source_structure"]),
    "item no object": (body(answer(components=[1])), "incomplete", ["malformed_source_element"]),
    "references no list": (body(answer(references={})), "unknown", ["malformed_reference_collection"]),
    "reference no object": (body(answer(references=[REF, "x"])), "incomplete", ["malformed_reference"]),
    "reference without url": (body(answer(references=[REF | {"url": "ftp://a.example"}, REF | {"url": None}])), "incomplete", ["malformed_reference"]),
    "reference of another kind": (body(answer(references=[REF | {"type": "other"}])), "incomplete", ["unsupported_reference_type"]),
    "excerpt no text": (body(answer(references=[REF | {"text": 5}])), "incomplete", ["malformed_excerpt"]),
    "markup": (body(answer(markdown="a `b`")), "available", ["unsupported_citation_markup"]),
    "indented": (body(answer(markdown="a\n\tb")), "available", ["unsupported_citation_markup"]),
    "blank": (body(answer(markdown=" ")), "unknown", ["answer_absent"]),
    "no items": (body(5), "unknown", ["answer_absent"]),
    "broken": ("{", "unknown", ["answer_absent"]),
    "null": (None, "unknown", ["answer_absent"]),
    "another shape": ("[]", "unknown", ["answer_absent"]),
}


@pytest.mark.parametrize("name", CASES)
def test_state_and_diagnostics(name):
    text, state, diagnostics = CASES[name]
    got = K.answer_sources(text)
    assert got[:2] == (state, diagnostics)


def test_places_and_excerpts_at_any_depth():
    node = {"type": "ai_overview_element", "references": [REF]}
    for _ in range(400):
        node = {"type": "ai_overview_expanded_component", "references": [], "components": [node]}
    state, diagnostics, found = K.answer_sources(body(answer(links=[LINK], items=[node], components=[{"type": "ai_overview_element", "references": [REF, REF]}])))
    assert (state, diagnostics) == ("available", []) and len(found) == 5
    at = "/tasks/0/result/0/items/0"
    assert [x["location"] for x in found[:4]] == [at + "/references/0", at + "/links/0", at + "/items/0" + "/components/0" * 400 + "/references/0", at + "/components/0/references/0"]
    assert [x["excerpt"] for x in found[:2]] == ["an excerpt", None]


def test_walk_of_a_table(spark):
    rows = spark.createDataFrame([(1, CASES["whole"][0], "x"), (1, None, "y"), (2, "{", "z")], "k long, body string, state string")
    got = sorted((r["k"], r["state"], len(r["sources"])) for r in K.walk_references(rows, "k", "body").collect())
    assert got == [(1, "available", 1), (1, "unknown", 0), (2, "unknown", 0)] and K.walk_references(rows.limit(0), "k", "body").count() == 0


def test_nodes_with_pointers():
    got = list(K.json_nodes('{"a/b": [1.50, {"~": null}], "": "x", "c": {}, "d": [], "e": true, "é": -0, "s": ""}'))
    assert got == [("", "object", None), ("/a~1b", "array", None), ("/a~1b/0", "number", "1.50"), ("/a~1b/1", "object", None), ("/a~1b/1/~0", "null", None), ("/", "string", "x"), ("/c", "object", None),
                   ("/d", "array", None), ("/e", "boolean", "true"), ("/é", "number", "-0"), ("/s", "string", "")]
    assert list(K.json_nodes("NaN")) == list(K.json_nodes("{")) == list(K.json_nodes("")) == [("", "invalid", None)]
    assert list(K.json_nodes('{"a": 1, "a": 2}'))[1:] == [("/a", "number", "2")]


def test_nodes_of_a_table(spark):
    long = json.dumps(list(range(25_000)))  # more than a portion
    rows = spark.createDataFrame([(1, '{"a": [true]}'), (1, '{"a": [true]}'), (2, None), (3, "x"), (4, long)], "k long, body string")
    got = K.json_pointers(rows, "k", "body")
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {1: 6, 3: 1, 4: 25_001}
    assert got.where("k = 4 and pointer = concat('/', value)").count() == 25_000
