"""Sections end at the next heading of their level, and at their box's end."""

from veritrail.operators.corpus import parse_page

PAGE = """<html lang=de><head><title>x</title></head><body><article><h1>Top</h1><p>one</p>
<div class="background-container"><h2>Box</h2><p>in</p><h3>Deep</h3><p>in deep</p></div><p>after</p>
<h2>Next</h2><div class="accordion-item"><h3>Ask</h3><p>answer</p></div><div class="accordion-item"><p>loose</p></div><p>tail</p></article></body></html>"""


def read(**how):
    got = parse_page(PAGE, "https://a.example/", **how)
    blocks, text = got["blocks"], got["text"]
    name = lambda i: text[blocks[i]["start"] : blocks[i]["end"]]
    above = {name(i): [name(h) for h in b["headings"]] for i, b in enumerate(blocks)}
    sections = {name(i): text[b["start"] : b["section_end"]].split() for i, b in enumerate(blocks) if b["kind"] == "heading"}
    return got["reason"], above, sections


def test_headings_end_with_their_box():
    reason, above, sections = read()
    assert reason == ""
    assert above["in"] == ["Top", "Box"] and above["Deep"] == ["Top", "Box"] and above["in deep"] == ["Top", "Box", "Deep"]
    assert above["after"] == ["Top"] and above["answer"] == ["Top", "Next", "Ask"] and above["loose"] == above["tail"] == ["Top", "Next"]
    assert sections["Box"] == "Box in Deep in deep".split() and sections["Deep"] == "Deep in deep".split() and sections["Ask"] == "Ask answer".split()
    assert sections["Next"] == "Next Ask answer loose tail".split() and sections["Top"][-1] == "tail"


def test_without_boxes_headings_reach_the_next_one():
    _, above, sections = read(scopes=frozenset())
    assert above["after"] == ["Top", "Box", "Deep"] and above["tail"] == ["Top", "Next", "Ask"] and sections["Deep"] == "Deep in deep after".split()
