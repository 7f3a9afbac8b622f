"""Three-way merge of two branches of a table of texts: codes by CRC linearity, then one pass over the lines of each document.

A branch changes what its codes tell: the code of a thing is ``crc32("branch:doc_id:name") mod 11``.  A CRC-32 is linear, so that

* the state after ``"L:doc_id:"`` is computed once per document and carried on by each name (for numbers of g digits: the state shifted by g zero bytes, XOR the number's own CRC);
* the right branch's code is the left one's XOR a constant that depends on the length alone, as the two strings differ in their first byte.

Both codes of a line choose one of 36 outcomes (what becomes of the line, what of the gap after it, what it counts), and a single pass writes the merged text.
Rows that the branches add meet by id in one aggregation; nothing else is shuffled.

Defined results: nulls in text, lang or source are empty; a null id is written as nothing in the code's string and stays null; rows of one id are merged each on
its own; values that branches add under one id count once if all are equal and are one conflict otherwise; an added id that the table holds already is a row
beside that row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

#: The codes' modulus and marks.
CODES = 11
MARKS = {1: "!", 2: "?", 3: "!", 4: "?"}
NONE = 5  # stands for all codes that change nothing
RESULT = "doc_id long, lang string, source string, text_sha256 string, n_clean long, n_edit_edit long, n_edit_delete long, n_insert_insert long"
_TABLE = 1 << 16


@cache
def side_constant(length: int) -> int:
    """CRC of a string that begins with L, XOR that of the same with R: the same for all strings of one length."""
    rest = bytes(length - 1)
    return zlib.crc32(b"L" + rest) ^ zlib.crc32(b"R" + rest)


def shifted(state: int, n: int) -> int:
    """The CRC's contribution after n more bytes."""
    return zlib.crc32(bytes(n), state) ^ zlib.crc32(bytes(n))


@cache
def _numbers(block: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"%d" % i) for i in range(block * _TABLE, (block + 1) * _TABLE)), np.uint32, _TABLE)


class Codes:
    """The codes of one document's things in both branches."""

    def __init__(self, doc_id: int | None):
        self.prefix = b"L:%s:" % (b"" if doc_id is None else b"%d" % doc_id)
        self.state = zlib.crc32(self.prefix)

    def named(self, name: bytes) -> tuple[int, int]:
        left = zlib.crc32(name, self.state)
        return left % CODES, (left ^ side_constant(len(self.prefix) + len(name))) % CODES

    def lines(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of lines 0 to n - 1."""
        left = np.empty(n, np.uint32)
        right = np.empty(n, np.uint32)
        for block in range(-(-n // _TABLE)):
            start, stop = block * _TABLE, min(n, (block + 1) * _TABLE)
            left[start:stop] = (_numbers(block) if block < 16 else _numbers.__wrapped__(block))[: stop - start]
        start, digits = 0, 1
        while start < n:
            stop = min(n, 10**digits)
            left[start:stop] ^= np.uint32(shifted(self.state, digits))
            right[start:stop] = left[start:stop] ^ np.uint32(side_constant(len(self.prefix) + digits))
            start, digits = stop, digits + 1
        return left % CODES, right % CODES


def settle(base: object, left: object, right: object) -> tuple[object, str | None]:
    """Three-way merge of one value: the outcome and whether it is clean, a conflict or nothing."""
    if left == base and right == base:
        return base, None
    if left == base or right == base or left == right:
        return (right if left == base else left), "clean"
    return base, "conflict"


def _outcomes() -> tuple[list[tuple[str | None, str | None]], np.ndarray]:
    """For each pair of line codes (left * 6 + right): (what is appended to the line, None: dropped; the line inserted after, if any) and its four counts."""
    ends, counts = [], np.zeros((36, 4), np.int64)
    for left in range(6):
        for right in range(6):
            at = left * 6 + right
            line = [None if x == 0 else MARKS[x] if x in (1, 2) else "" for x in (left, right)]
            gap = [MARKS[x] if x in (3, 4) else None for x in (left, right)]
            text, how = settle("", *line)
            inserted, gap_how = settle(None, *gap)
            ends.append((text, inserted))
            counts[at, 0] += (how == "clean") + (gap_how == "clean")
            counts[at, 1] += how == "conflict" and None not in line
            counts[at, 2] += how == "conflict" and None in line
            counts[at, 3] += gap_how == "conflict"
    return ends, counts


ENDS, COUNTS = _outcomes()
_CHANGES = np.array([end != ("", None) for end in ENDS])  # outcomes other than the base's


def edited(value: str, code: int) -> str:
    """A branch's value of a column."""
    return "" if code == 0 else value + MARKS[code] if code in (1, 2) else value


def merged_lines(lines: list[str], left: np.ndarray, right: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The merged lines and the counts of the four kinds."""
    pair = np.minimum(left, NONE) * 6 + np.minimum(right, NONE)
    counts = np.bincount(pair, minlength=36) @ COUNTS
    out, done = [], 0
    for i in np.flatnonzero(_CHANGES[pair]).tolist():
        out += lines[done:i]
        done = i + 1
        end, inserted = ENDS[pair[i]]
        if end is not None:
            out.append(lines[i] + end)
        if inserted is not None:
            out.append(inserted)
    return out + lines[done:], counts


def merge_row(doc_id: int | None, lang: str, source: str, text: str) -> tuple[str | None, str | None, str | None, int, int, int, int]:
    """(lang, source, text, clean, edit-edit, edit-delete, insert-insert) of one row; three nulls if the merge drops it."""
    codes = Codes(doc_id)
    row = codes.named(b"row")
    sides = {name: (value, *(edited(value, c) for c in codes.named(name))) for name, value in ((b"lang", lang), (b"source", source))}
    lines = text.split("\n")
    by_line = codes.lines(len(lines))
    if 0 in row:
        other = 2 - row.index(0)  # place of the branch that may keep the row, in sides' tuples
        kept = row[other - 1] != 0 and (any(v[other] != v[0] for v in sides.values()) or bool((by_line[other - 1] < NONE).any()))
        return (lang, source, text, 0, 0, 1, 0) if kept else (None, None, None, 1, 0, 0, 0)
    out, counts = merged_lines(lines, *by_line)
    values = []
    for value, left, right in sides.values():
        found, how = settle(value, left, right)
        values.append(found)
        counts[0] += how == "clean"
        counts[1] += how == "conflict"
    return (*values, "\n".join(out), *counts.tolist())


def _rows(batches: Iterator[pa.RecordBatch], full: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, langs, sources, texts = (c.to_pylist() for c in batch.columns)
        out = []
        for doc_id, lang, source, text in zip(ids, langs, sources, texts, strict=True):
            lang, source, text, *counts = merge_row(doc_id, lang or "", source or "", text or "")
            digest = None if text is None else hashlib.sha256(text.encode()).hexdigest()
            out.append((doc_id, lang, source, *([text] if full else []), digest, *counts))
        names = ["doc_id", "lang", "source", *(["text"] if full else []), "text_sha256", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]
        kinds = [pa.int64(), *[pa.string()] * (4 if full else 3), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for less, code in enumerate(Codes(doc_id).named(b"row"), 1):
                if code in (3, 4):
                    out.append((None if doc_id is None else -less - doc_id, lang or "", source or "", MARKS[code]))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "lang", "source", "text"])


def merge_branches(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id", full: bool = False) -> DataFrame:
    """Per id ever present: lang, source, ``text_sha256`` (three nulls if it is absent) and the counts of clean changes and conflicts; with ``full`` the merged ``text`` too."""
    narrow = [F.col(key).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source")]
    schema = RESULT.replace("text_sha256", "text string, text_sha256") if full else RESULT
    rows = documents.select(*narrow, F.col(text).alias("text")).mapInArrow(lambda batches: _rows(batches, full), schema)
    added = documents.select(*narrow).mapInArrow(_added, "doc_id long, lang string, source string, text string")
    value = F.struct("lang", "source", "text")
    met = added.groupBy("doc_id").agg(F.min(value).alias("one"), F.max(value).alias("other"))
    same = F.col("one") == F.col("other")
    taken = [F.when(same, F.col(f"one.{x}")).alias(x) for x in ("lang", "source", *(["text"] if full else []))]
    nothing = F.lit(0).cast("long")
    met = met.select("doc_id", *taken, F.when(same, F.sha2("one.text", 256)).alias("text_sha256"), same.cast("long").alias("n_clean"),
                     nothing.alias("n_edit_edit"), nothing.alias("n_edit_delete"), (~same).cast("long").alias("n_insert_insert"))
    return rows.unionByName(met)


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i::BIGINT AS i, 0 AS step, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE step = 8),
base AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
things AS (
  SELECT r, doc_id, 'row' AS name, NULL::BIGINT AS i, NULL AS value FROM base UNION ALL
  SELECT r, doc_id, 'lang', NULL, lang FROM base UNION ALL
  SELECT r, doc_id, 'source', NULL, source FROM base UNION ALL
  SELECT r, doc_id, (i - 1)::VARCHAR, i - 1, lines[i] FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM base)),
sides AS (SELECT * , b.branch || ':' || COALESCE(doc_id::VARCHAR, '') || ':' || name AS said FROM things, (VALUES ('L'), ('R')) b(branch)),
coded AS (
  SELECT r, doc_id, name, i, value, branch,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(said, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 11 AS code
  FROM sides, crc),
pairs AS (
  SELECT r, doc_id, name, i, value, MAX(code) FILTER (branch = 'L') AS l, MAX(code) FILTER (branch = 'R') AS rr
  FROM coded GROUP BY ALL),
-- values of each side: of columns, of lines (null: dropped) and of gaps (null: nothing)
parts AS (
  SELECT r, doc_id, name AS kind, NULL::BIGINT AS i, value AS b,
         CASE l WHEN 0 THEN '' WHEN 1 THEN value || '!' WHEN 2 THEN value || '?' ELSE value END AS x,
         CASE rr WHEN 0 THEN '' WHEN 1 THEN value || '!' WHEN 2 THEN value || '?' ELSE value END AS y FROM pairs WHERE name IN ('lang', 'source')
  UNION ALL
  SELECT r, doc_id, 'line', i, value, CASE l WHEN 0 THEN NULL WHEN 1 THEN value || '!' WHEN 2 THEN value || '?' ELSE value END,
         CASE rr WHEN 0 THEN NULL WHEN 1 THEN value || '!' WHEN 2 THEN value || '?' ELSE value END FROM pairs WHERE i IS NOT NULL
  UNION ALL
  SELECT r, doc_id, 'gap', i, NULL, CASE l WHEN 3 THEN '!' WHEN 4 THEN '?' END, CASE rr WHEN 3 THEN '!' WHEN 4 THEN '?' END FROM pairs WHERE i IS NOT NULL),
settled AS (
  SELECT *, CASE WHEN x IS NOT DISTINCT FROM b THEN y WHEN y IS NOT DISTINCT FROM b OR x IS NOT DISTINCT FROM y THEN x ELSE b END AS v,
         x IS DISTINCT FROM b AS cx, y IS DISTINCT FROM b AS cy FROM parts),
summed AS (
  SELECT r, doc_id, MAX(v) FILTER (kind = 'lang') AS lang, MAX(v) FILTER (kind = 'source') AS source,
         COALESCE(string_agg(v, chr(10) ORDER BY i, kind = 'gap') FILTER (kind IN ('line', 'gap') AND v IS NOT NULL), '') AS text,
         bool_or(cx) AS cx, bool_or(cy) AS cy,
         COUNT(*) FILTER ((cx OR cy) AND NOT (cx AND cy AND x IS DISTINCT FROM y)) AS clean,
         COUNT(*) FILTER (cx AND cy AND x IS DISTINCT FROM y AND kind <> 'gap' AND x IS NOT NULL AND y IS NOT NULL) AS ee,
         COUNT(*) FILTER (cx AND cy AND x IS DISTINCT FROM y AND kind = 'line' AND (x IS NULL OR y IS NULL)) AS ed,
         COUNT(*) FILTER (cx AND cy AND x IS DISTINCT FROM y AND kind = 'gap') AS ii
  FROM settled GROUP BY r, doc_id),
rows_ AS (
  SELECT s.*, o.l, o.rr, b.lang AS base_lang, b.source AS base_source, list_aggregate(b.lines, 'string_agg', chr(10)) AS base_text,
         CASE WHEN o.l <> 0 AND o.rr <> 0 THEN 'merged' WHEN (o.l <> 0 AND s.cx) OR (o.rr <> 0 AND s.cy) THEN 'kept' ELSE 'gone' END AS fate
  FROM summed s JOIN base b USING (r) JOIN pairs o ON o.r = s.r AND o.name = 'row'),
added AS (
  SELECT -1 - doc_id AS doc_id, base_lang AS lang, base_source AS source, CASE l WHEN 3 THEN '!' ELSE '?' END AS text FROM rows_ WHERE l IN (3, 4) UNION ALL
  SELECT -2 - doc_id, base_lang, base_source, CASE rr WHEN 3 THEN '!' ELSE '?' END FROM rows_ WHERE rr IN (3, 4)),
met AS (SELECT doc_id, COUNT(DISTINCT (lang, source, text)) = 1 AS same, MIN(lang) AS lang, MIN(source) AS source, MIN(text) AS text FROM added GROUP BY doc_id)
SELECT doc_id, CASE fate WHEN 'merged' THEN lang WHEN 'kept' THEN base_lang END AS lang, CASE fate WHEN 'merged' THEN source WHEN 'kept' THEN base_source END AS source,
       CASE fate WHEN 'merged' THEN sha256(text) WHEN 'kept' THEN sha256(base_text) END AS text_sha256,
       (CASE fate WHEN 'merged' THEN clean WHEN 'kept' THEN 0 ELSE 1 END)::BIGINT AS n_clean, (CASE fate WHEN 'merged' THEN ee ELSE 0 END)::BIGINT AS n_edit_edit,
       (CASE fate WHEN 'merged' THEN ed WHEN 'kept' THEN 1 ELSE 0 END)::BIGINT AS n_edit_delete, (CASE fate WHEN 'merged' THEN ii ELSE 0 END)::BIGINT AS n_insert_insert
FROM rows_ UNION ALL
SELECT doc_id, CASE WHEN same THEN lang END, CASE WHEN same THEN source END, CASE WHEN same THEN sha256(text) END, same::BIGINT, 0::BIGINT, 0::BIGINT, (NOT same)::BIGINT FROM met
"""
