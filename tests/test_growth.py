"""What must not grow: broadcasts, edges that no rule reads, and pairs of a search."""

from pyspark.sql import functions as F

from veritrail.operators import links
from veritrail.plans import bundle, catalog

SMALL = "/root/testdata/sf0.001"


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_record_graph_broadcasts_nothing(spark, capsys):
    for name in ("manifest_violations", "claim_violations"):
        plan = plan_of(catalog.QUERIES[name](spark, SMALL), capsys)
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_only_edges_that_rules_read(spark):
    kinds = ["claim", "text_unit", "observation"]
    records = bundle.records(spark.read.parquet(f"{SMALL}/documents.parquet"), kinds)
    roles = {r.role for r in links.edges(records, {("claim", "observation_id"), (None, "context_unit_ids")}).select("role").distinct().collect()}
    assert roles == {"observation_id", "context_unit_ids"}
    assert links.cards(records, {"run"}).schema["card"].dataType.names == ["run"]
    all_of_claims = {tuple(r) for r in links.violations(records, ["run_mismatch", "missing_id"]).where("kind = 'claim'").collect()}
    assert all_of_claims and all_of_claims == {tuple(r) for r in links.violations(records, ["run_mismatch", "missing_id"], ["claim"]).collect()}


def test_every_card_entry_a_rule_reads_is_found():
    for code, kind, role, rule in links.edge_rules():
        assert links._entries("o", [rule]) | links._entries("t", [rule]), (code, kind, role)
    assert links._entries("t", [F.col("t.run").isin(*map(str, range(99))) & (F.col("t.text") == F.col("o.claim"))]) == {"run", "text"}


def test_lookup_of_missing_records_with_many_events(spark, tmp_path):
    spark.createDataFrame([(d,) for d in (0, 1, 2, 5)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    made = [(e, 1, "click", "{}") for e in (7, 1000000, 1000035)]  # as many events that the ids asked for in vain are given
    spark.createDataFrame(made, "event_id long, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in catalog.QUERIES["record_lookup"](spark, str(tmp_path)).collect()}
    assert got == {("event-1000000", "not_found", ""), ("event-7", "succeeded", "click"), ("event-14", "not_found", ""), ("event-1000035", "not_found", "")}


def test_search_equals_all_pairs_scored(spark, monkeypatch):
    import random

    from veritrail.operators import retrieval as R

    draw = random.Random(7)
    rows = [(i, [draw.gauss(0, 1) for _ in range(5)]) for i in range(90)]
    rows += [(100 + i, [x * 2 for x in rows[3][1]]) for i in range(9)] + [(200, [1.0, None, 0.0, 0.0, 1.0]), (220, [1.0, 2.0]), (240, None), (260, [2.0, 1.0])]
    rows += [(300 + i, [x + 1e-7 * i for x in rows[5][1]]) for i in range(9)]  # scores that differ by less than they are rounded
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    monkeypatch.setattr(R, "ASKED", 2)
    monkeypatch.setattr(R, "SEARCHED", 30)
    args = (asked, table, "query_id", "vec_id", "embedding")
    pairs = R.cosine_scores(*args)
    for k in (1, 6, 200):
        got, want = R.nearest(*args, k), R.top_k(pairs, "query_id", "vec_id", k)
        assert sorted(got.select("query_id", "vec_id", "score", "rank").collect(), key=str) == sorted(want.select("query_id", "vec_id", "score", "rank").collect(), key=str)
        got, want = R.nearest_trace(*args, k), R.path_trace(pairs, "query_id", "vec_id", F.col("eligible"), k)
        assert sorted(got.collect()) == sorted(want.collect())


def test_search_makes_no_row_for_each_pair(spark, capsys):
    plan = plan_of(catalog.QUERIES["semantic_path_trace"](spark, SMALL), capsys)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scores_are_not_shuffled_before_the_best_are_taken(spark, capsys):
    from veritrail.operators import retrieval as R

    documents, items = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    scores = R.bm25_scores(items, documents, "item_id", "text", "doc_id", "text")
    plan = plan_of(scores, capsys)
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(item_id#" not in plan.split("HashAggregate")[1]


def test_scores_with_many_query_terms_are_the_same(spark, monkeypatch):
    from veritrail.operators import retrieval as R

    documents, items = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    brought = R.bm25_scores(items, documents, "item_id", "text", "doc_id", "text").collect()
    monkeypatch.setattr(R, "SMALL", 0)
    assert sorted(brought) == sorted(R.bm25_scores(items, documents, "item_id", "text", "doc_id", "text").collect())


def test_language_counts_take_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from veritrail.llm import language

    words = " ".join(f"wort{i % 977} und so weiter" for i in range(100))
    batch = pa.RecordBatch.from_arrays([pa.array(["de", "fr"] * 1000), pa.array([words] * 2000)], names=["g", "t"])  # 4 MB of texts
    tracemalloc.start()
    found = language.gram_counts(iter([batch]), ["de", "fr"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20 and sum(found.column(2).to_pylist()) > 4 * 1000 * 1000


def test_sentences_without_a_cut_are_not_searched_for_abbreviations(monkeypatch):
    from veritrail.operators import textunits as U

    cut = U.sentences("Es kostet z. B. 3.5 Euro. Danach mehr.")
    assert cut == [(0, 25), (26, 38)] and U.sentences(" \n") == U.sentences("") == []
    monkeypatch.setattr(U, "_PROTECT", None)
    assert U.sentences("  Ein Satz [mit Klammer, dann Dr.\n") == [(2, 33)] and U.sentences("Ohne Punkt") == [(0, 10)]


def test_unit_digests_do_not_depend_on_null_keys_beside_them(spark):
    from veritrail.operators import textunits as U

    alone, beside = (spark.createDataFrame(rows, "k long, t string").coalesce(1) for rows in ([(1, "Ein Satz.")], [(1, "Ein Satz."), (None, "Noch einer."), (2, None), (3, "")]))
    of_one = [sorted(r.digest for r in U.units(x, "k", "t").where("k = 1").collect()) for x in (alone, beside)]
    assert of_one[0] == of_one[1] and len(of_one[0]) == 2 and U.units(beside, "k", "t").count() == 4


def test_pages_leave_python_as_arrow_columns(spark, capsys, monkeypatch):
    from veritrail.operators import layout as L

    monkeypatch.setattr(L, "ROWS", 3)
    pages = ["<p class='a b' id=x title=''>1<b>2</b></p>" * 2, None, "", "<i c='d'>é", "<br>"]
    table = spark.createDataFrame(list(enumerate(pages)), "k long, html string").coalesce(1)
    found = L.elements(table, "k", "html", signed=True)
    assert "MapInArrow" in plan_of(found, capsys)
    assert {r.k: [e.asDict() for e in r.elements] for r in found.collect()} == {k: L.page_elements(p, signed=True) for k, p in enumerate(pages)}


def test_lineages_of_near_parents_are_written_once(spark, monkeypatch):
    import random

    from veritrail.operators import constraints as G

    written, plain = [], G.materialise
    monkeypatch.setattr(G, "materialise", lambda df, name: written.append(plain(df, name)) or written[-1])
    monkeypatch.setattr(G, "discard", lambda df: None)
    near = spark.range(3000).selectExpr("id", "nullif(id, 0) - 1 as parent")
    assert sorted(map(tuple, G.lineage_roots(near, "id", "parent").collect())) == [(i, 0, i) for i in range(3000)]
    assert sum(x.count() for x in written) < 2 * 3000
    draw = random.Random(5)
    for run in (1, 4, 7, 1 << 18):
        monkeypatch.setattr(G, "RUN", run)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(run, 2000))
        parents = {i: draw.choice([None, i, i - 1, i - 2, draw.randrange(200), 500]) if i % 3 == 0 else i - 1 if i else None for i in range(200)}
        want = set()
        for i in parents:
            at, steps = i, 0
            while steps <= 200 and parents.get(at) is not None:
                at, steps = parents[at], steps + 1
            if steps > 200:
                want.add((i, None, -1))
            elif at in parents:
                want.add((i, at, steps))
        got = G.lineage_roots(spark.createDataFrame([(i, p) for i, p in parents.items()], "id long, parent long"), "id", "parent").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def test_closures_are_summed_as_longs(spark):
    from veritrail.operators import lineage

    digests = spark.createDataFrame([("f" * 64,)] * 3, "d string").agg(*lineage._sums("d"))
    assert {f.dataType.simpleString() for f in digests.schema} == {"bigint"} and set(digests.first()) == {3 * (2**32 - 1)}


def test_spans_of_texts_in_pieces(spark, monkeypatch):
    from veritrail.functions import text as T

    texts = ["", None, "a\nb\r\n🍎é" * 5, "0123456789" * 3, "x"]
    spans = spark.createDataFrame([(t, a, a + n) for t in texts for a in range(40) for n in range(12)], "t string, a long, b long")
    for size in (1, 4, 1024):
        monkeypatch.setattr(T, "PIECE", size)
        cut = spans.select("t", "a", "b", T.slice_of_pieces(T.pieces(F.col("t")), F.col("a"), F.col("b")).alias("got"))
        assert [r for r in cut.collect() if r.got != (None if r.t is None else r.t[r.a : r.b])] == []


def test_quotes_meet_only_sentences_near_them(spark, capsys, monkeypatch):
    import random

    from veritrail.functions import text as T
    from veritrail.operators import textunits as U

    draw = random.Random(3)
    texts = {k: "".join(draw.choice("abé🍎") for _ in range(60)) for k in range(8)}
    units = [(k, o, a, min(60, a + draw.randrange(16)), draw.choice(["sentence", "sentence", "heading"])) for k in texts for o in range(12) for a in [draw.randrange(58)]]
    of = {(k, o): (a, b, kind) for k, o, a, b, kind in units}
    anchors, want = [], {}
    for i in range(1500):
        k, named = draw.randrange(8), sorted(draw.sample(range(12), draw.choice([1, 2, 2, 3])))
        low, high = min(of[k, o][0] for o in named), max(of[k, o][1] for o in named)
        at = draw.randrange(low, high + 1)
        quote = texts[k][at : min(high, at + draw.randrange(1, 12))] or "a"
        anchors.append((k, i, quote, named))
        places = [p for p in range(low, high - len(quote) + 1) if texts[k][p : p + len(quote)] == quote]
        a, b = (places[0], places[0] + len(quote)) if places else (0, 0)
        holding = [(of[k, o][1] - of[k, o][0], o) for o in named if of[k, o][0] <= a and b <= of[k, o][1]]
        crossed = [o for o in range(12) if o not in named and of[k, o][2] == "sentence" and of[k, o][0] < b and a < of[k, o][1]]
        if len(places) != 1:
            want[i] = ("location_ambiguous" if places else "quote_missing", None, None, None)
        elif any(of[k, o][0] >= b or a >= of[k, o][1] for o in named):
            want[i] = ("invalid_source_units", None, None, None)
        elif not holding and crossed:
            want[i] = ("incomplete_source_units", None, None, None)
        else:
            want[i] = ("located", a, b, min(holding)[1] if holding else None)
    assert len({x[0] for x in want.values()}) == 5
    found = spark.createDataFrame(units, "k long, ord long, start long, end long, kind string")
    asked = spark.createDataFrame(anchors, "k long, anchor long, quote string, named array<long>")
    for size in (3, 1024):
        monkeypatch.setattr(T, "PIECE", size)
        monkeypatch.setattr(U, "PIECE", size, raising=False)
        located = U.locate_in_units(asked, found, spark.createDataFrame(list(texts.items()), "k long, text string"), "k")
        assert {r.anchor: (r.status, r.start, r.end, r.unit) for r in located.collect()} == want
    assert "Join [k#" in (plan := plan_of(located, capsys)) and "__piece" in plan  # no row for each quote and sentence of a text
