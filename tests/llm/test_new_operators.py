"""Decontamination, whitening and branch merging on small and messy tables, against brute-force versions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import decontam, merge, whiten

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_hits(texts, items, span=10):
    known = {}
    for item, text in items:
        w = terms(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if w else ():
            known.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(k) for k in known}
    out = []
    for text in texts:
        w, hit, found = terms(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit |= set(range(i, i + n))
                    found |= known[tuple(w[i : i + n])]
        found = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def benchmark_cases():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Äpfel", "ÄPFEL", "straße", "İx", "K9", "🍎"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 9, 10, 11, 14, 40, 80])))) for i in range(30)]
    items += [(100, "one"), (101, "Two, words"), (7, items[3][1]), (102, items[3][1]), (None, "null item words " * 4), (103, ""), (104, None), (105, "... !!"), (106, "aa bb " * 12)]
    texts = ["", None, "!!!", "one", "ONE two WORDS", "aa bb " * 40, "bb aa " * 5, "null item words " * 5]
    for _ in range(120):
        parts = []
        for _ in range(r.randint(1, 5)):
            parts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))))
            w = terms(r.choice(items)[1])
            if w:
                a = r.randint(0, len(w) - 1)
                parts.append(r.choice([" ", ", ", "\n"]).join(w[a : a + r.randint(1, 25)]).upper() if r.random() < 0.3 else " ".join(w[a : a + r.randint(1, 25)]))
        texts.append(" - ".join(parts))
    texts.append(" ".join(r.choice(vocabulary) for _ in range(30_000)) + " " + items[4][1])
    return texts + texts[-3:-1], items


def test_decontamination_equals_brute_force(spark):
    texts, items = benchmark_cases()
    rows = [(None if i % 17 == 3 else i, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, map int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    want = sorted(zip([repr(r[0]) for r in rows], plain_hits(texts, items), strict=True))
    got = decontam.decontaminate(docs, bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((repr(r[0]), tuple(r[1:])) for r in got.collect()) == want
    assert sum(x[1][4] for x in want) > 60


def test_decontamination_keeps_every_shared_window_whatever_the_bits(spark, monkeypatch):
    texts, items = benchmark_cases()
    monkeypatch.setattr(decontam, "MOST_BITS", 12)  # nearly every place passes the first test
    monkeypatch.setattr(decontam, "LEAST_BITS", 12)
    docs = spark.createDataFrame(list(enumerate(texts[:60])), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = dict(enumerate(plain_hits(texts[:60], items)))
    assert {r[0]: tuple(r[1:]) for r in decontam.decontaminate(docs, bench).collect()} == want
    places = decontam.hits(docs, bench).collect()
    for r in places:
        assert len(terms(texts[r.doc_id])) >= r.first_word + r.length and len(r.items) >= (0 if r.length > 3 else 1)


def test_decontamination_of_empty_tables(spark):
    none = "item_id long, text string"
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for items in ([], [(1, None), (2, "?")]):
        got = sorted(decontam.decontaminate(docs, spark.createDataFrame(items, none)).collect())
        assert [tuple(r)[:4] + (r.contaminated,) for r in got] == [(1, 3, 0, 0, False), (2, 0, 0, 0, False)] and got[0].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert decontam.decontaminate(docs.where("false"), spark.createDataFrame([(1, "a b")], none)).count() == 0


def exact(vectors):
    keep = [i for i, v in enumerate(vectors) if v is not None and len(v) == 5 and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in vectors[i]] for i in keep])
    return keep, x


def test_whitening_equals_eigh(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 5)) * [3.0, 1.0, 0.2, 0.01, 0.5] @ r.normal(size=(5, 5))
    vectors = [list(map(float, v)) for v in base]
    vectors[5], vectors[6], vectors[7][2], vectors[8][1], vectors[9][0] = None, [], None, math.nan, math.inf
    vectors[10] = vectors[11] = vectors[12]
    vectors[13] = [1.0, 2.0]
    vectors[14][0] = 1e30
    keys = [None if i % 50 == 20 else i for i in range(400)]
    rows = [(k, v, i, 1.0) for i, (k, v) in enumerate(zip(keys, vectors, strict=True))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened double").repartition(3)
    vectors[14] = None  # has no exact long
    keep, x = exact(vectors)
    n, d = x.shape
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    values, basis = values[::-1], basis[:, ::-1]
    want = (x - x.mean(0)) @ basis / np.sqrt(values)
    sums = x.sum(0).astype(object)
    deviation = ((n * x.astype(object) - sums) ** 2).sum(1)
    got = whiten.whitening(table).collect()
    assert len(got) == n * d
    signs = {}
    by_key = {(keys[i], c + 1): (want[j, c], deviation[j]) for j, i in enumerate(keep) for c in range(d) if keys[i] is not None}
    for g in got:
        assert g.n == n and g.identity_error <= 1e-9 and abs(g.explained / (values[g.component - 1] / values.sum()) - 1) < 1e-9
        if g.vec_id is not None:
            w, dev = by_key[g.vec_id, g.component]
            assert g.deviation == dev
            if abs(w) > 1e-3:
                assert signs.setdefault(g.component, np.sign(w * g.whitened)) == np.sign(w * g.whitened) and abs(abs(w) - abs(g.whitened)) < 1e-6 * abs(w) + 1e-8
    assert sorted(repr(g.vec_id) for g in got if g.component == 1) == sorted(repr(keys[i]) for i in keep)


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whitening(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whitening(spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0])], schema)).collect() == []
    one = whiten.whitening(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    line = whiten.whitening(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(10)], schema)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in line) and {r.component for r in line} == {1, 2, 3}
    large = whiten.whitening(spark.createDataFrame([(i, [2.0**41 * i, 1.0]) for i in range(5)], schema)).collect()
    assert {r.deviation for r in large} == {None} | {r.deviation for r in large if r.vec_id == 2}  # beyond a long but in the middle
    tiny = spark.createDataFrame([(i, [1000.0 * math.sin(i), 0.5 * math.cos(3 * i)]) for i in range(300)], schema)
    assert whiten.whitening(tiny).select(F.max("identity_error")).first()[0] < 1e-9


def test_jacobi():
    r = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 33):
        a = r.normal(size=(d, d))
        a = a @ np.diag(10.0 ** -np.linspace(0, 5, d)) @ a.T
        values, basis = whiten.jacobi(a)
        assert np.allclose(basis.T @ basis, np.eye(d), atol=1e-12) and np.allclose(basis @ np.diag(values) @ basis.T, a, atol=1e-12 * max(1, np.abs(a).max())) and (np.diff(values) <= 0).all()
    for pairs in (whiten._rounds(7), whiten._rounds(8)):
        flat = [tuple(x) for p, q in pairs for x in zip(p.tolist(), q.tolist(), strict=True)]
        assert len(flat) == len(set(flat)) and len(flat) in (21, 28)
    scaled = np.diag([1e12, 1.0, 1e-6]) + 1e-7  # small eigenvalues to full relative accuracy
    assert abs(whiten.jacobi(scaled)[0][2] / 1.1e-6 - 1) < 0.01


def test_codes_are_the_crc():
    for doc_id in (0, 7, -12, 123456789, None):
        codes = merge.Codes(doc_id)
        say = lambda branch, name: zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 11
        for name in ("row", "lang", "source"):
            assert codes.named(name.encode()) == (say("L", name), say("R", name))
        left, right = codes.lines(70_005)
        for i in (*range(120), 999, 1000, 65_535, 65_536, 70_004):
            assert (left[i], right[i]) == (say("L", i), say("R", i))


def plain_merge(rows):
    """Row by row and branch by branch: each branch is written out in full, then compared with the base."""
    code = lambda b, d, n: zlib.crc32(f"{b}:{'' if d is None else d}:{n}".encode()) % 11
    out, added = [], {}
    for d, text, lang, source in rows:
        base = {"lang": lang or "", "source": source or ""}
        lines = (text or "").split("\n")
        for i, line in enumerate(lines):
            base["line", i], base["gap", i] = line, None
        side = {}
        for b in "LR":
            new = dict(base)
            for k, v in base.items():
                c = code(b, d, k if isinstance(k, str) else k[1])
                if isinstance(k, str):
                    new[k] = {0: "", 1: v + "!", 2: v + "?"}.get(c, v)
                elif k[0] == "line":
                    new[k] = {0: None, 1: v + "!", 2: v + "?"}.get(c, v)
                else:
                    new[k] = {3: "!", 4: "?"}.get(c)
            c = code(b, d, "row")
            side[b] = None if c == 0 else new
            if c in (3, 4):
                added.setdefault(None if d is None else -(1 if b == "L" else 2) - d, set()).add((base["lang"], base["source"], "!?"[c - 3]))
        n, state = [0, 0, 0, 0], base
        if side["L"] is None or side["R"] is None:
            other = side["L"] or side["R"]
            if other is not None and other != base:
                n[2] = 1
            else:
                n[0], state = 1, None
        else:
            state = dict(base)
            for k, v in base.items():
                x, y = side["L"][k], side["R"][k]
                if (x, y) == (v, v):
                    continue
                if x == v or y == v or x == y:
                    state[k] = y if x == v else x
                    n[0] += 1
                elif k[0] == "gap":
                    n[3] += 1
                elif x is None or y is None:
                    n[2] += 1
                else:
                    n[1] += 1
        if state is None:
            out.append((d, None, None, None, *n))
        else:
            kept = [state[k, i] for i in range(len(lines)) for k in ("line", "gap") if state[k, i] is not None]
            out.append((d, state["lang"], state["source"], hashlib.sha256("\n".join(kept).encode()).hexdigest(), *n))
    for d, values in added.items():
        lang, source, text = min(values)
        out.append((d, lang, source, hashlib.sha256(text.encode()).hexdigest(), 1, 0, 0, 0) if len(values) == 1 else (d, None, None, None, 0, 0, 0, 1))
    return sorted(out, key=repr)


def merge_cases():
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice(["", "a", "ä 🍎", "x" * 50]) for _ in range(r.choice([0, 1, 2, 7, 30, 130]))), r.choice(["en", "", None]), r.choice(["s", None])) for i in range(600)]
    rows += [(700, None, None, None), (701, "", "", ""), (702, "\n" * 12_000, "en", "s"), (703, "a\r\nb c\x0bd", "en", "s"), (-4, "neg", "en", "s"), (None, "no id\nat all", "en", "s"), (None, None, None, None)]
    return rows + rows[3:40] + [(i, "other", "fr", "t") for i in range(100, 140)]


def test_merge_equals_brute_force(spark):
    rows = merge_cases()
    table = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, lang string, source string, n_clean int, one string").repartition(3)
    got = merge.merge_branches(table)
    assert got.columns == ["doc_id", "lang", "source", "text_sha256", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]
    want = plain_merge(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert min(sum(r[i] for r in want) for i in (4, 5, 6, 7)) > 20
    full = merge.merge_branches(table, full=True).where("text is not null").collect()
    assert full and all(hashlib.sha256(r.text.encode()).hexdigest() == r.text_sha256 for r in full)
    assert merge.merge_branches(table.where("false")).collect() == []


@pytest.mark.parametrize("query", ["merge", "decontam"])
def test_twins_on_messy_tables(spark, query):
    """The SQL twins give the same rows on the messy tables as well."""
    con = duckdb.connect()
    if query == "merge":
        rows = [r for r in merge_cases() if r[0] is not None]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        got, sql = merge.merge_branches(docs), merge.ORACLE
    else:
        texts, items = benchmark_cases()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        con.register("benchmark", bench.toArrow())
        got, sql = decontam.decontaminate(docs, bench), decontam.ORACLE
    con.register("documents", docs.toArrow())
    found = con.sql(sql)
    assert sorted(map(repr, found.select(*[f'"{c}"' for c in got.columns]).fetchall())) == sorted(repr(tuple(r)) for r in got.collect())
