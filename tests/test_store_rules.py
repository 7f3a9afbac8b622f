"""Cursors, artifacts with errors, receipts of responses, version chains, normal form C."""

import base64
import hashlib
import unicodedata
import zlib

import pytest

from veritrail.functions import text as T
from veritrail.operators import constraints as G
from veritrail.operators import retrieval as R
from veritrail.operators import store as S


def test_a_cursor_must_be_a_record_of_its_filter(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", "r") for i in range(1, 10)], "seq long, kind string, analysis_run_id string")
    seqs = lambda **how: [r["seq"] for r in S.page(rows, **how).collect()]
    assert seqs(limit=2, after=3, kind="a") == [5, 7] and seqs(limit=9, after=3, through=6) == [4, 5, 6] and seqs(limit=1) == [1]
    for wrong in ({"after": 3, "kind": "b"}, {"after": 10}, {"after": 3, "kind": "a", "run": "other"}):
        with pytest.raises(ValueError, match="invalid_cursor"):
            S.page(rows, 2, **wrong)
    seen, after = [], 0
    while got := seqs(limit=2, after=after, kind="a"):
        seen, after = seen + got, got[-1]
    assert seen == [1, 3, 5, 7, 9]


def test_artifacts_with_wrong_digests_are_told(spark):
    good, digest = base64.b64encode(b"one").decode(), hashlib.sha256(b"one").hexdigest()
    rows = [("p", digest, good), ("p", digest, good), ("q", digest, good), ("p", digest, base64.b64encode(b"two").decode()), ("p", "x", good), ("p", "x", "?"), ("p", None, good), ("p", digest, None)]
    got = {(r["access"], r["sha256"], r["status"]): r["content"] for r in S.put_artifacts(spark.createDataFrame(rows, "access string, sha256 string, content_base64 string")).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {
        ("p", digest, "stored"): b"one", ("q", digest, "stored"): b"one", ("p", digest, "artifact_hash_mismatch"): None, ("p", "x", "artifact_hash_mismatch"): None, ("p", "x", "invalid_base64"): None,
        ("p", None, "artifact_hash_mismatch"): None, ("p", digest, "invalid_base64"): None,
    }


PLAIN, HTML = {"Content-Type": "text/plain"}, {"CONTENT-TYPE": "Text/HTML; charset=x", "Set-Cookie": "a"}
RESPONSES = {  # headers, body, complete, error -> role, content, encoded?, complete, error
    "html": (HTML, b"<p>", True, None, "raw-html", b"<p>", False, True, None),
    "other": (PLAIN, b"<p>", True, None, "response-body", b"<p>", False, True, None),
    "packed": (PLAIN | {"Content-Encoding": " DEFLATE"}, zlib.compress(b"x" * 20), True, None, "response-body", b"x" * 20, True, True, None),
    "bomb": (PLAIN | {"content-encoding": "deflate"}, zlib.compress(b"x" * 1000), True, None, None, None, True, False, "body_too_large"),
    "broken": (PLAIN | {"content-encoding": "gzip"}, b"zz", True, None, None, None, True, False, "decode_failed"),
    "long": (PLAIN, b"x" * 31, True, None, "partial-body", b"x" * 31, False, False, "response_too_large"),
    "as long as may be": (PLAIN, b"x" * 30, True, None, "response-body", b"x" * 30, False, True, None),
    "cut": (HTML, b"x", False, None, "partial-body", b"x", False, False, "incomplete_body"),
    "failed": (HTML, b"x", True, "timeout", "partial-body", b"x", False, False, "timeout"),
    "nothing": (HTML, None, True, None, None, None, False, False, "missing_body"),
    "refused": (HTML, None, False, "dns", None, None, False, False, "dns"),
    "empty": (HTML, b"", True, None, "raw-html", b"", False, True, None),
    "no headers": (None, b"x", True, None, "response-body", b"x", False, True, None),
}


def test_receipts_of_responses(spark):
    rows = spark.createDataFrame([(name, *r[:4]) for name, r in RESPONSES.items()], "name string, headers map<string,string>, body binary, complete boolean, error string")
    got = {r["name"]: r for r in S.response_receipts(rows, ("content-type", "content-encoding"), 30).collect()}
    for name, (headers, body, _, _, role, content, packed, complete, error) in RESPONSES.items():
        r = got[name]
        assert (r["role"], r["content"] and bytes(r["content"]), r["encoded"] is not None, r["complete"], r["error"]) == (role, content, packed, complete, error), name
        assert r["received"] == (None if body is None else len(body)) and r["decoded"] == (len(content) if complete else None)
        assert set(r["headers"] or {}) == {k.lower() for k in headers or {}} - {"set-cookie"} and (r["omitted"] or []) == (["set-cookie"] if headers and "Set-Cookie" in headers else [])


def test_version_chains(spark):
    rows = [(1, None, "u"), (2, 1, "u"), (3, 2, "v"), (4, 9, "u"), (5, 6, "u"), (6, 7, "u"), (7, 6, "u"), (8, 8, None), (10, 2, None), (11, 10, None)]
    got = sorted(tuple(r) for r in G.version_violations(spark.createDataFrame(rows, "id long, previous long, url string"), "id", "previous", "url").collect())
    other, cycle = "previous_article_url_mismatch", "article_history_cycle"
    assert got == [(3, other), (4, "missing_id"), (5, cycle), (6, cycle), (7, cycle), (8, cycle), (10, other)]
    assert G.version_violations(spark.createDataFrame([], "id long, previous long, url string"), "id", "previous", "url").count() == 0


def test_every_character_reaches_normal_form(spark):
    """Each code point alone, and after each of the letters it may join, is as Python composes it."""
    alone = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    pairs = [d for c in range(0x110000) if not 0xD800 <= c < 0xE000 for d in (unicodedata.normalize("NFD", chr(c)),) if len(d) > 1 and d != chr(c)]
    texts = sorted(set(alone + pairs + ["éạ́", "plain", "é", ""]))
    rows = spark.createDataFrame([(x, unicodedata.normalize("NFC", x)) for x in texts] + [(None, None)], "x string, y string")
    wrong = rows.select("x", "y", T.nfc(rows["x"]).alias("z")).where("not (y <=> z)")
    assert len(texts) > 10_000 and wrong.count() == 0


def test_index_against_its_passages(spark):
    passages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e"), (6, "f")], "id long, text string")
    index = spark.createDataFrame([(1, "a", 1), (2, "x", 9), (4, None, 2), (5, "e", 1), (5, "e", 1), (6, "f", 0), (7, "g", None)], "id long, text string, token_count int")
    got = sorted(tuple(r) for r in R.index_violations(index, passages, "id", 8).collect())
    assert got == [(2, "index_representation_mismatch"), (2, "invalid_index_lengths"), (3, "passage_not_indexed"), (5, "indexed_twice"), (6, "invalid_index_lengths"), (7, "index_without_passage"), (7, "invalid_index_lengths")]
    assert R.index_violations(index.limit(0), passages.limit(0), "id", 8).count() == 0


def test_sound_postings(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "c")], "id long, text string")
    sound = R.postings(texts, "id", "text")
    assert R.sparse_violations(sound, texts, "id").count() == 0
    rows = [(1, "a", 2, 3), (1, "b", 1, 3), (4, "c", 1, 2), (5, "d", 1, 1), (6, "e", 0, 0), (7, "f", 1, 2), (7, "f", 1, 2), (8, None, 1, 1), (9, "g", 1, 2), (9, "h", 1, 3)]
    known = spark.createDataFrame([(i,) for i in (1, 1, 4, 6, 7, 8, 9)], "id long")
    got = sorted(tuple(r) for r in R.sparse_violations(spark.createDataFrame(rows, "id long, term string, tf long, dl long"), known, "id").collect())
    assert got == [(4, "invalid_length"), (5, "unknown_passage"), (6, "invalid_frequency"), (7, "invalid_vocabulary"), (8, "invalid_vocabulary"), (9, "invalid_length")]
