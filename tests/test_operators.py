"""Small cases of the evidence operators, faults injected one at a time."""

import pytest
from pyspark.sql import functions as F

from veritrail.functions import text as T
from veritrail.operators import claims as C
from veritrail.operators import constraints as G
from veritrail.operators import corpus as K
from veritrail.operators import guards
from veritrail.operators import retrieval as R
from veritrail.operators import store as S
from veritrail.sources import raw


def test_tokens(spark):
    row = spark.sql("select 'Nicht nur 3,5 mmol/l, kein Wert < 70 mg/dl und ≥ 5 %!' a, '!!!' b, '5–10' c").select(*[T.tokens(F.col(x)).alias(x) for x in "abc"]).first()
    assert row.a == ["nicht", "nur", "3,5", "mmol/l", "kein", "wert", "<", "70", "mg/dl", "und", "≥", "5", "%"]
    assert row.b == [] and row.c == ["5", "10"]


def test_fusion(spark):
    semantic = R.top_k(spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.1)], "q int, id string, score double"), "q", "id")
    lexical = R.top_k(spark.createDataFrame([(1, "B", 100.0), (1, "C", 1.0)], "q int, id string, score double"), "q", "id")
    rows = R.rrf_fuse(semantic, lexical, "q", "id").orderBy("fused_rank").collect()
    assert [r.id for r in rows] == ["B", "A", "C"]
    assert rows[0].fused == round(1 / 61 + 1 / 62, 12) and (rows[0].semantic_rank, rows[0].lexical_rank) == (2, 1)


def test_top_k_ties(spark):
    scores = spark.range(120).select(F.lit(1).alias("q"), F.col("id"), F.lit(1.0).alias("score"))
    assert [r.id for r in R.top_k(scores, "q", "id").orderBy("rank").collect()] == list(range(50))
    trace = R.path_trace(scores, "q", "id", F.col("eligible")).first()
    assert (trace.eligible, trace.omitted, trace.tied_at_boundary) == (120, 70, True)


def test_membership(spark):
    hits = spark.createDataFrame([(1, "a", 1, 1.0), (1, "a", 2, 0.5), (2, "b", 2, 1.0), (3, "c", 1, float("nan")), (4, "d", 1, 1.0)], "q int, id string, rank int, score double")
    assert {(r.q, r.code) for r in R.membership_violations(hits, "q", "id").collect()} == {(1, "path_membership_mismatch"), (2, "path_rank_mismatch"), (3, "invalid_path_scores")}


def test_neighbours(spark):
    rows = spark.createDataFrame([("x", i, f"p{i}", s) for i, s in enumerate("AAAB")], "a string, o int, id string, h string")
    assert {r.id: r.context for r in R.neighbours(rows, "a", "o", "id", "h").collect()} == {"p0": ["p0", "p1"], "p1": ["p0", "p1", "p2"], "p2": ["p1", "p2"], "p3": ["p3"]}


def test_cursor():
    cursor = S.write_cursor("s", "k", None, 3, 9)
    assert S.read_cursor(cursor, "s", "k", None) == (3, 9)
    for bad in (("t", "k", None), ("s", "x", None)):
        with pytest.raises(ValueError, match="invalid_cursor"):
            S.read_cursor(cursor, *bad)
    with pytest.raises(ValueError, match="invalid_cursor"):
        S.read_cursor("?" * 9000, "s", "k", None)


def test_upsert(spark):
    existing = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "id string, sha256 string, seq long")
    incoming = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3"), ("c", "3"), ("d", "4"), ("d", "5")], "id string, sha256 string")
    rows = {r.id: (r.outcome, r.seq) for r in S.upsert_plan(incoming, existing).collect()}
    assert rows == {"a": ("idempotent", 1), "b": ("immutable_id_conflict", 2), "c": ("appended", 3), "d": ("immutable_id_conflict", 0)}


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1,"a":2}', '{"a":1}}', '{"a":1},2', "x", "[1]", "NaN"]
    found = spark.createDataFrame([(x,) for x in texts], "t string").select(S.strict_json(F.col("t")).alias("s")).collect()
    assert [r.s for r in found][:6] == ["ok", "invalid_json", "invalid_json", "invalid_json", "invalid_json", "ok"]


def test_decoding():
    import zlib

    assert raw.inflate(zlib.compress(b"ab"), "deflate", 10) == (b"ab", "ok")
    assert raw.inflate(zlib.compress(b"ab") + b"x", "deflate", 10)[1] == "trailing_data"
    assert raw.inflate(zlib.compress(b"a" * 99), "deflate", 10)[1] == "body_too_large"
    assert raw.decode_html("ä".encode(), "utf-8") == ("ä", "ok")
    assert raw.decode_html(b"<meta charset=latin-1>", "utf-8")[1] == "charset_conflict"
    assert raw.decode_html(b"\xff", None)[1] == "invalid_bytes"


def test_schema():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer"}}}
    assert [guards.schema_check(x, schema) for x in ({"a": 1}, {"a": True}, {}, {"a": 1, "b": 2}, [])] == [None, "type", "required", "additionalProperties", "type"]


def test_lineage(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 6), (8, 8)], "id long, parent long")
    rows = {r.id: (r.root, r.depth) for r in G.lineage_roots(links, "id", "parent").collect()}
    assert rows == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (None, -1), 6: (None, -1), 7: (None, -1), 8: (None, -1)}


def test_history(spark):
    rows = spark.createDataFrame([(1, None, "a", 1), (2, 1, "a", 2), (3, 1, "b", 0), (4, 5, "a", 1), (5, 4, "a", 1)], "id long, prev long, s string, t int")
    codes = {(r.id, r.code) for r in G.history_violations(rows, "id", "prev", "s", "t").collect()}
    assert codes == {(1, "branched_history"), (3, "history_subject_mismatch"), (3, "history_time_reversed"), (4, "history_cycle"), (5, "history_cycle")}


def test_spans(spark):
    texts = spark.createDataFrame([(1, "Äpfel 🍎 sind rot.")], "text_id int, text string")
    spans = spark.createDataFrame([(1, 1, 8, 17, "sind rot."), (2, 1, -1, 3, "x"), (3, 1, 3, 3, ""), (4, 1, 0, 5, "Apfel"), (5, 1, 0, 99, "x")], "owner int, text_id int, start int, end int, exact_text string")
    assert {r.owner: r.code for r in G.span_violations(spans, texts).collect()} == {2: "span_out_of_bounds", 3: "span_out_of_bounds", 4: "quote_mismatch", 5: "span_out_of_bounds"}


def test_regions(spark):
    rows = [(1, 0, 0, 10, "sentence", 0, False), (1, 1, 11, 20, "sentence", 0, True), (1, 2, 15, 18, "bullet", 1, False), (1, 3, 40, 50, "sentence", 0, False)]
    targets = spark.createDataFrame(rows, "k int, ord int, start int, end int, kind string, parent int, gap boolean")
    assert [(r.start, r.end, r.n) for r in C.region_groups(targets, "k").orderBy("region").collect()] == [(0, 20, 3), (40, 50, 1)]


def test_routing(spark):
    claims = spark.createDataFrame([(1, "available"), (2, "available"), (3, "incomplete"), (4, "incomplete")], "c int, availability string")
    references = spark.createDataFrame([(1, "https://www.example.com/x"), (2, "https://example.com.evil.org/"), (3, "https://notexample.com/"), (4, "http://example.com")], "c int, url string")
    assert {r.c: r.status for r in C.citation_routing(claims, references, "c", "example.com").collect()} == {1: "yes", 2: "no", 3: "unclear", 4: "yes"}


def test_page():
    page = "<html lang=de><title>T</title><body><nav>x</nav><article><h1>Kopf</h1><p>Eins <b>zw</b>ei:</p><ol start=3><li>a<li value=7>b<ul><li>c</li></ul></li></ol></article>"
    got = K.parse_page(page, "https://a.example/")
    assert got["reason"] == ""
    assert got["text"] == "Kopf\n\nEins zwei:\n\n3. a\n7. b\n  - c"
    assert K.parse_page(page.replace("lang=de", "lang=en"), "")["reason"] == "wrong_language"
    assert K.parse_page("<p>x", "")["reason"] == "root_missing"


def test_page_chrome_lists_and_sections():
    body = """<h1>Blatt</h1><div class="consent x">Zustimmen</div><header>Vorspann</header>
<ul><li>eins<br>zwei<ul><li>innen</li></ul>nach</li><li><p>drei</p><p>vier <a href="/q">Q</a></p></li></ul><ul class="related-pages"><li>mehr</li></ul>
<ol><li>neu</li></ol><div>frei</div><div>weiter</div><div class="faq-question">Wann?</div><div hidden><p>Jetzt.</p></div>
<aside class="advice"><p>Achtung.</p></aside><footer class="references"><h2>Belege</h2><p>Von <a href="#e">E</a>.</p></footer><div class="share-tools">Teilen</div>"""
    got = K.parse_page(f"<html lang=de><title>T</title><body><article>{body}</article><footer>Fuss</footer>", "https://a.example/")
    assert got["reason"] == ""
    assert got["text"] == "Blatt\n\nVorspann\n\n- eins\nzwei\n  - innen nach\n- drei vier Q\n\n1. neu\n\nfrei\n\nweiter\n\nWann?\n\nJetzt.\n\nAchtung.\n\nBelege\n\nVon E."
    assert [(b["level"], b["headings"]) for b in got["blocks"] if b["kind"] == "heading"] == [(1, []), (2, [0]), (2, [0])]
    assert [x.rsplit("/", 1)[1] for x in got["excluded"]] == ["div[1]", "ul[2]", "div[6]"]
    spans = [got["blocks"][x["block"]]["start"] + x["start"] for x in got["links"]]
    assert [got["text"][a : a + 1] for a in spans] == ["Q", "E"] and [x["navigable"] for x in got["links"]] == [True, True]
    assert K.parse_page("<article><h1>A</h1><nav><p class=sources>x</p></nav></article>", "")["reason"] == "chrome_contains_article_reference"


def test_queries_import_without_extras():
    from veritrail.plans import catalog

    assert len(catalog.QUERIES) > 90 and set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_guided_schema_and_pins():
    schema = {"type": "object", "title": "x", "properties": {"a": {"type": "string", "minLength": 2}, "b": {"type": "array", "minItems": 1, "items": {"type": "string", "minLength": 1}}}}
    assert guards.guided_schema(schema) == {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "string"}}}}
    assert guards.version_mismatches({"no-such-package": "1"}) == [("no-such-package", "1", "")]
