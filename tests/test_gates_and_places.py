"""Budget gates, heading stacks, markers and quote places against plain loops on random cases."""

import random
import re

from pyspark.sql import functions as F

from veritrail.operators import claims, textunits


def plain_gate(calls, limits):
    """Call by call, with the state written out."""
    made = generations = decisions = 0
    spent, closed, halted = 0.0, False, False
    out = []
    for generation, cost, halts in calls:
        if closed:
            out.append("stopped")
            continue
        why = None
        if halted:
            why = "halted"
        elif made >= limits.calls:
            why = "calls"
        elif spent + cost > limits.cost + 1e-12:
            why = "cost"
        elif generation and generations >= limits.generations:
            why = "generations"
        elif not generation and decisions >= limits.decisions:
            why = "decisions"
        out.append(why)
        if why:
            closed = True
        else:
            made, spent, halted = made + 1, spent + cost, halts
            generations, decisions = generations + generation, decisions + (not generation)
    return out


def test_stage_budgets_equal_a_loop(spark):
    r = random.Random(4)
    for limits in (claims.Limits(12, 5, 9, 40.0), claims.Limits(0, 5, 5, 9.0), claims.Limits(100, 3, 100, 1e9)):
        rows, want = [], {}
        for run in range(60):
            calls = [(r.random() < 0.4, r.choice([0.0, 1.0, 2.5, 6.0]), r.random() < 0.03) for _ in range(r.randint(0, 40))]
            for n, (call, why) in enumerate(zip(calls, plain_gate(calls, limits), strict=True)):
                rows.append((f"run{run}" if run else None, n, *call))
                want[f"run{run}" if run else None, n] = why
        table = spark.createDataFrame(rows, "run string, at int, generation boolean, reservation double, halts boolean").repartition(5)
        got = claims.stage_budgets(table.where("run is not null"), "run", ["at"], limits).collect()
        assert {(x.run, x.at): x.stopped_by for x in got} == {k: v for k, v in want.items() if k[0]}
        assert all(x.admitted == (x.stopped_by is None) for x in got)
    assert claims.stage_budgets(table.where("false"), "run", ["at"], limits).count() == 0


def test_heading_stack_equals_a_stack(spark):
    r, rows, want = random.Random(8), [], {}
    for doc in range(80):
        stack, active = [], None
        for ord_ in range(r.randint(0, 40)):
            heading = r.random() < 0.4
            level = r.randint(1, 6) if heading else None
            if heading:
                while stack and stack[-1][1] >= level:
                    stack.pop()
                want[doc, ord_] = (None, stack[-1][0] if stack else None, [o for o, _ in stack])
                stack.append((ord_, level))
                active = ord_
            else:
                want[doc, ord_] = (active, None, [o for o, _ in stack])
            rows.append((doc, ord_, "heading" if heading else "sentence", level))
    table = spark.createDataFrame(rows, "doc int, ord int, kind string, level int").repartition(3)
    got = {(x.doc, x.ord): (x.active, x.above, list(x.path)) for x in textunits.heading_stack(table, "doc").collect()}
    assert got == want


def test_markers_by_bracket_depth(spark):
    marker = re.compile(textunits.MARKER)
    r, rows, want = random.Random(3), [], set()
    parts = ["[", "]", "!", "a", " ", "\n", "[[1]](https://a.example/x)", "[[12]](https://b.example/y)", "[[3]](https://c.example/(z))", "[[4]](ftp://a.example/x)", "[text](https://a.example/x)", "ä🍎"]
    urls = {"https://a.example/x", "https://b.example/y", "https://c.example/"}
    for key in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14))) + ("`" if key % 50 == 7 else "\n    code" if key % 50 == 9 else "")
        rows.append((key, text))
        if "`" in text or "\n    " in text:
            continue
        for m in marker.finditer(text):
            before = text[: m.start()]
            if m.group(1) in urls and before[-1:] not in ("!", "[") and before.count("[") == before.count("]"):
                want.add((key, int(m.group()[2 : m.group().index("]")]), m.group(1), m.start(), m.end()))
    answers = spark.createDataFrame([*rows, (999, None), (998, "")], "key int, text string")
    captured = spark.createDataFrame([(k, u) for k in range(300) for u in urls], "key int, url string")
    got = textunits.citation_markers(answers, captured, "key", "text", "url").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and len(want) > 50


def test_quotes_within_named_units(spark):
    text = "Eins zwei. Drei vier. Drei fünf."
    units = [(1, 0, 0, 10, "sentence"), (1, 1, 11, 21, "sentence"), (1, 2, 22, 32, "sentence"), (1, 3, 0, 32, "paragraph")]
    cases = [  # quote, named, expected
        ("zwei", [0], ("located", 5, 9, 0)), ("Drei", [1], ("located", 11, 15, 1)), ("Drei", [1, 2], ("location_ambiguous", None, None, None)), ("Drei", [0], ("quote_missing", None, None, None)),
        ("zwei. Drei", [0, 1], ("located", 5, 15, None)), ("vier. Drei", [1, 3], ("located", 16, 26, 3)), ("zwei", [0, 1], ("invalid_source_units", None, None, None)), ("zwei", [1, 0], ("invalid_source_order", None, None, None)),
        ("zwei", [0, 0], ("invalid_source_units", None, None, None)), ("zwei", [0, 9], ("invalid_source_units", None, None, None)), ("zwei", [], ("invalid_source_units", None, None, None)),
        ("zwei. Drei vier. Drei", [0, 2], ("incomplete_source_units", None, None, None)),
    ]
    anchors = spark.createDataFrame([(1, n, q, named) for n, (q, named, _) in enumerate(cases)], "doc int, anchor int, quote string, named array<int>")
    found = spark.createDataFrame(units, "doc int, ord int, start long, end long, kind string")
    got = {x.anchor: (x.status, x.start, x.end, x.unit) for x in textunits.locate_in_units(anchors, found, spark.createDataFrame([(1, text)], "doc int, text string"), "doc").collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(cases)}
    overlapping = spark.createDataFrame([(1, 0, "aa", [0])], "doc int, anchor int, quote string, named array<int>")
    line = spark.createDataFrame([(1, 0, 0, 3, "sentence")], "doc int, ord int, start long, end long, kind string")
    assert textunits.locate_in_units(overlapping, line, spark.createDataFrame([(1, "aaa")], "doc int, text string"), "doc").first().status == "location_ambiguous"


def test_lines_of_texts_that_share_a_key(spark):
    rows = textunits.lf_lines(spark.createDataFrame([(1, "a\nbc"), (1, "a\nbc"), (2, "")], "k int, t string"), "k", "t", keep=True)
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 0, 1, "a"), (1, 0, 0, 1, "a"), (1, 1, 2, 4, "bc"), (1, 1, 2, 4, "bc"), (2, 0, 0, 0, "")]
    assert rows.where(F.length("line") != F.col("end") - F.col("start")).count() == 0
