"""Text units: block scan, sentences, unit assembly, context windows, quotes, markers and cues."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PIECE, pieces, slice_of_pieces
from ..runtime import materialise

# German abbreviations that do not end a sentence, and cue pronouns: fixed values.
ABBREVIATIONS = "z. B.|d. h.|u. a.|o. ä.|i. d. R.|z.B.|d.h.|u.a.|bzw.|ca.|vgl.|Dr.|Prof.|Nr.|Abb.|Tab.|St.|Mio.|Mrd.|ggf.|inkl.|max.|min.|sog.|evtl."
CUES = "dies|diese|dieser|dieses|er|sie|es|ihre|ihr|sein|seine|dabei|dadurch|damit|daher|deshalb|hierbei|jener|jene|solche"
KINDS = ("heading", "paragraph", "bullet", "sentence")
ROWS = 50_000  # units of a batch that Python gives back

# What a line is, as one letter, the first that fits; lower case where the line starts with white space.
_LINE = re.compile(
    r"(?P<E>\s*$)"  # empty
    r"|(?P<H> {0,3}<(?:(?P<tag>[A-Za-z][A-Za-z0-9-]*)[\s/>]|!--))"  # raw HTML or a comment
    r"|(?P<F> {0,3}(?P<fence>`{3,}|~{3,}))"
    r"|(?P<A> {0,3}(?P<level>#{1,6})(?=[ \t]|$))"
    r"|(?P<R> {0,3}(?P<rule>[-*_])(?:[ \t]*(?P=rule)){2,}[ \t]*$)"  # a thematic break
    r"|(?P<I>(?P<indent>[ \t]*)(?:[-+*]|\d{1,9}[.)])[ \t]+(?=\S))"  # a list item
    r"|(?P<O>(?: {4}| {0,3}[<>\t])|.*\|)"  # indented code, quotes, tables
    r"|(?P<T>)"  # plain text
)
# Blocks as patterns over the letters of all lines: S is plain text with a Setext line below it, B a thematic break that is an item as well.
_BLOCK = re.compile(r"(?P<empty>E+)|(?P<html>H|h)|(?P<fence>F|f)|(?P<atx>A|a)|(?P<setext>[Ss].)|(?P<list>[Ii][IBihfrsotb]*)|(?P<text>[Tt]+)|(?P<solid>[^E]+)")


class Line(NamedTuple):
    """A line's place, text, and what it is."""

    start: int
    end: int
    text: str
    what: re.Match

    @property
    def kind(self) -> str:
        return self.what.lastgroup if len(self.what.lastgroup) == 1 else next(k for k in "EHFARIOT" if self.what[k] is not None)


def split_lines(text: str) -> list[tuple[int, int, int]]:
    """(start, end, next start) of every line; CRLF, CR and LF end lines."""
    out, at = [], 0
    for m in re.finditer(r"\r\n|\r|\n", text):
        out.append((at, m.start(), m.end()))
        at = m.end()
    if at < len(text) or not out:
        out.append((at, len(text), len(text)))
    return out


def _letters(lines: list[Line]) -> str:
    """One letter per line; see ``_LINE`` and ``_BLOCK``."""
    out = []
    for k, line in enumerate(lines):
        letter = line.kind
        if letter == "R" and _MARKER.match(line.text):
            letter = "B"
        elif letter == "T" and k + 1 < len(lines) and _level(lines[k + 1].text):
            letter = "S"
        out.append(letter.lower() if line.text[:1] in (" ", "\t") and letter != "E" else letter)
    return "".join(out)


_MARKER = re.compile(r"([ \t]*)([-+*]|\d{1,9}[.)])[ \t]+(?=\S)")


def _level(line: str) -> int:
    """The heading level that a Setext line gives, 0 if it is none."""
    mark = line.strip()
    return {"=": 1, "-": 2}.get(mark[:1], 0) if mark and mark.strip(mark[0]) == "" else 0


def _closing(lines: list[Line], first: int) -> int:
    """The last line of the raw HTML or fence that starts at ``first``: its closing line, or the last line of all."""
    what = lines[first].what
    if what["F"] is not None:
        end, after = re.compile(rf" {{0,3}}{re.escape(what['fence'][0])}{{{len(what['fence'])},}}\s*$").match, first + 1
    else:
        end, after = re.compile(rf"</{re.escape(what['tag'])}\s*>" if what["tag"] else "-->", re.IGNORECASE).search, first
    return next((k for k in range(after, len(lines)) if end(lines[k].text)), len(lines) - 1)


def _items(group: list[Line]) -> list[tuple[Line, re.Match, Line]] | None:
    """(first line, marker, last line) of each item of a list; None where it is nested or ambiguous."""
    marked = [(k, m) for k, line in enumerate(group) if (m := _MARKER.match(line.text))]
    tabs = any("\t" in line.text[: len(line.text) - len(line.text.lstrip())] for line in group)
    deeper = any(len(m[1]) > len(marked[0][1][1]) for _, m in marked)
    solid = any(_LINE.match(group[k].text, m.end()) and _solid(group[k].text[m.end() :]) for k, m in marked)
    if tabs or deeper or solid:
        return None
    ends = [k - 1 for k, _ in marked[1:]] + [len(group) - 1]
    return [(group[k], m, group[last]) for (k, m), last in zip(marked, ends, strict=True)]


def _solid(line: str) -> bool:
    """Whether a line by itself is markup whose inside is not read as text."""
    kind = Line(0, 0, line, _LINE.match(line)).kind
    return kind in "HFRO" or kind in "AI" and ("|" in line or bool(re.match(r" {4}| {0,3}\t", line)))


def scan(text: str) -> list[tuple[str, int, int, int | None, bool, int]]:
    """Markdown blocks: (kind, start, end, level, opaque, content start).

    Each line becomes a letter, and blocks are matched over the letters.  Nested or ambiguous lists are one
    opaque paragraph; unclosed HTML and fences run to the end.
    """
    lines = [Line(a, b, text[a:b], _LINE.match(text[a:b])) for a, b, _ in split_lines(text)]
    letters, out, at = _letters(lines), [], 0
    while at < len(lines):
        m = _BLOCK.match(letters, at)
        first, last, shape = lines[at], lines[m.end() - 1], m.lastgroup
        if shape in ("html", "fence"):
            stop = _closing(lines, at)
            last, at = lines[stop], stop
        else:
            at = m.end() - 1
        at += 1
        if shape in ("atx", "setext"):
            out.append(("heading", first.start, last.end, len(first.what["level"]) if shape == "atx" else _level(last.text), False, first.start))
        elif shape == "list" and (items := _items(lines[m.start() : m.end()])) is not None:
            out += [("bullet", one.start + len(mark[1]), end.end, None, False, one.start + mark.end()) for one, mark, end in items]
        elif shape != "empty":
            out.append(("paragraph", first.start, last.end, None, shape != "text", first.start))
    return out


_INLINE = re.compile(r"\\[\s\S]?|`+|[\[\](]")


def _partners(text: str) -> dict[int, int]:
    """Where the bracket or parenthesis opened at each place is closed."""
    open_, out = {"]": [], ")": []}, {}
    for m in re.finditer(r"[\[\]()]", text):
        if m[0] in "[(":
            open_["]" if m[0] == "[" else ")"].append(m.start())
        elif open_[m[0]]:
            out[open_[m[0]].pop()] = m.end()
    return out


def regions(text: str) -> tuple[dict[int, int], bool]:
    """Protected markup (escapes, code spans, balanced links with their targets) as ends by start, and whether all brackets balance."""
    partners, out, at, whole, last = _partners(text), {}, 0, True, -1
    while m := _INLINE.search(text, at):
        start, at, sign = m.start(), m.end(), m[0][0]
        if sign == "]":
            whole = False
            continue
        if sign == "(" and not (last == start and text[start - 1] == "]"):
            continue  # only a link's target is markup
        if sign == "`":
            close = text.find(m[0], at)
            at = close + len(m[0]) if close >= 0 else None
        elif sign != "\\":
            at = partners.get(start)
        if at is None:
            return out, False
        out[start] = last = at
    return out, whole


_PROTECT = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ABBREVIATIONS.split("|"))) + r")|\d+(?:[.,]\d+)+|\d{1,2}\.(?=\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert)\b)|https?://\S+?(?=[.!?…]*(?:\s|$))|\b(?:usw|etc)\.(?=\s+[a-zäöüß])")
_STOP = re.compile(r"([.!?…]++)[*_\"'”“»)\]’]*+(?=\s|\[|\Z)")
_MORE = re.compile(r"(?:[.!?…]+)?[*_\"'”“»)\]’]*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Sentence spans without surrounding white space; one span where markup is unbalanced."""
    fin = len(text.rstrip())
    stops = [m for m in _STOP.finditer(text) if m.end() < fin]
    if not stops:  # nothing to cut, whatever the markup
        return [(len(text) - len(text.lstrip()), fin)] if fin else []
    marks, whole = regions(text)
    cuts = {len(text)}
    if whole:
        safe = sorted([*marks.items(), *(m.span() for m in _PROTECT.finditer(text))])
        starts, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))
        for m in stops:
            known = bisect_right(starts, m.start())
            if not known or reach[known - 1] < m.end(1):
                cuts.add(_tail(text, m.end(), marks))
    edges = sorted(cuts)
    pieces = [(a, text[a:b]) for a, b in zip([0, *edges], edges, strict=False)]
    return [(a + len(x) - len(x.lstrip()), a + len(x.rstrip())) for a, x in pieces if x.strip()]


def _tail(text: str, at: int, marks: dict[int, int]) -> int:
    """Where a sentence ends that stops at ``at``: link markup that follows belongs to it."""
    while (link := re.compile(r"\s*").match(text, at).end()) in marks and text[link] == "[":
        at = marks[link]
        at = marks[at] if at in marks and text[at] == "(" else at
        at = _MORE.match(text, at).end()
    return at


def units(texts: DataFrame, key: str, text: str, limit_chars: int | None = None) -> DataFrame:
    """(key, ord, kind, start, end, level, opaque, parent, heading, digest): blocks and their sentences in document order.

    Order: start, longer first, then heading, paragraph, bullet, sentence.  ``heading`` is the order of the last heading before the unit, ``parent`` that of the
    block a sentence lies in; -1 where there is none.  Opaque blocks have no sentences.  A text longer than the limit, where one is given, has one row of kind ``index_limit_exceeded``.
    """

    def one(body: str) -> list[tuple]:
        if limit_chars is not None and len(body) > limit_chars:
            return [(0, "index_limit_exceeded", 0, len(body), 0, False, -1, -1)]
        found: list[tuple[int, int, int, int, bool, int]] = []
        for kind, a, b, level, opaque, content in scan(body):
            found.append((a, -b, KINDS.index(kind), level or 0, opaque, -1))
            if not opaque and kind != "heading":
                found += [(content + x, -(content + y), 3, 0, False, a) for x, y in sentences(body[content:b])]
        found.sort(key=lambda u: u[:3])
        place = {u[0]: i for i, u in reversed(list(enumerate(found))) if u[2] != 3}
        out, heading = [], -1
        for i, (a, b, kind, level, opaque, owner) in enumerate(found):
            out.append((i, KINDS[kind], a, -b, level, opaque, place.get(owner, -1), heading))
            if kind == 0:
                heading = i
        return out

    kinds = {"ord": pa.int64(), "kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "level": pa.int64(), "opaque": pa.bool_(), "parent": pa.int64(), "heading": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, body in enumerate(batch.column(1)):
                if text := body.as_py():
                    rows += one(text)
                    owner += [i] * (len(rows) - len(owner))
                if len(rows) >= ROWS or rows and i == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], names=[key, *kinds])
                    rows, owner = [], []

    kind = texts.schema[key].dataType.simpleString()
    made = texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, ord long, kind string, start long, end long, level long, opaque boolean, parent long, heading long")
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("None")), "kind", "start", "end")
    return made.withColumn("digest", F.substring(F.sha2(name, 256), 1, 16))


def lf_lines(texts: DataFrame, key: str, text: str, keep: bool = False) -> DataFrame:
    """(key, ord, start, end) of the lines of texts that use LF only, in built-in functions; with ``keep`` each ``line`` too.  Texts that share a key stay apart."""
    numbered = texts.select(key, F.monotonically_increasing_id().alias("__row"), F.col(text).alias("__text"))
    lines = numbered.select(key, "__row", F.posexplode(F.split("__text", "\n")).alias("ord", "line"))
    before = W.partitionBy("__row").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    rows = lines.select(key, F.col("ord").cast("long").alias("ord"), start.cast("long").alias("start"), F.length("line").alias("n"), *["line"] * keep)
    return rows.select(key, "ord", "start", (F.col("start") + F.col("n")).cast("long").alias("end"), *["line"] * keep)


def heading_stack(found: DataFrame, key: str, deepest: int = 6) -> DataFrame:
    """Units with ``active`` (the last heading before a unit, null for headings), ``above`` (a heading's parent) and ``path`` (all headings a unit is under, outermost first).

    Units have ord, kind and, for headings, level 1 to ``deepest``.  A new heading takes all of its own level or deeper off the stack, so the heading on top is the last one of a
    lower level.  The stack is thus known from the last heading of each level: of level l it is on the stack where no later heading has a lower level, nor the same one.
    """
    before = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    heading = F.col("kind") == "heading"
    last = [F.last(F.when(heading & (F.col("level") == n), F.col("ord")), ignorenulls=True).over(before).alias(f"__{n}") for n in range(1, deepest + 1)]
    seen = found.select("*", *last)
    places = [F.col(f"__{n}") for n in range(1, deepest + 1)]
    lower = [F.when(F.lit(n) < F.col("level"), place) for n, place in enumerate(places, 1)]
    parent = F.array_max(F.array(*lower))
    on_stack = [F.when(~F.coalesce(place < F.array_max(F.array(*places[: n - 1])), F.lit(False)) if n > 1 else F.lit(True), place) for n, place in enumerate(places, 1)]
    path = F.array_compact(F.array(*on_stack))
    path = F.when(heading, F.filter(path, lambda p: p <= F.coalesce(parent, F.lit(-1)))).otherwise(path)
    active = F.when(~heading, F.array_max(F.array(*places)))
    return seen.select(*found.columns, active.alias("active"), F.when(heading, parent).alias("above"), path.alias("path"))


def unit_violations(found: DataFrame, key: str) -> DataFrame:
    """(key, code): orders that do not run from 0, headings that are not the last one before, children of opaque blocks."""
    order = found.groupBy(key).agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n"), F.countDistinct("ord").alias("kinds"))
    broken = order.where("low <> 0 or high <> n - 1 or kinds <> n").select(key, F.lit("unit_order_mismatch").alias("code"))
    before = F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("ord")), ignorenulls=True).over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    heads = found.withColumn("__b", before).where("heading <> __b").select(key, F.lit("not_a_heading").alias("code"))
    opaque = found.where("opaque").select(key, F.col("ord").alias("parent"))
    inside = found.where("parent >= 0").join(opaque, [key, "parent"]).select(key, F.lit("opaque_has_children").alias("code"))
    return broken.unionByName(heads).unionByName(inside)


def context_window(found: DataFrame, targets: DataFrame, key: str, before: int = 1, after: int = 1, clip: bool = True) -> DataFrame:
    """(key, ord): what the targets stand for, up to ``before`` and ``after`` neighbouring sentences, and the headings of all of them.

    A sentence stands for itself, a heading for itself and its first sentence, an opaque block for itself alone, another block for the sentences in it.
    With clipping the neighbours end at the first of another heading; since sentences of one heading are contiguous that is a filter.
    """
    said = found.where("kind = 'sentence'").withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("ord")))
    opaque = F.coalesce("opaque", F.lit(False)) if "opaque" in found.columns else F.lit(False)
    asked = found.join(targets, [key, "ord"], "left_semi").select(key, "ord", "kind", "heading", opaque.alias("closed"))
    own = [asked.where("kind = 'sentence'").select(key, "ord")]
    first = said.groupBy(key, "heading").agg(F.min("ord").alias("first"))
    own.append(asked.where("kind = 'heading'").select(key, F.col("ord").alias("heading")).join(first, [key, "heading"]).select(key, F.col("first").alias("ord")))
    if "parent" in found.columns:
        blocks = asked.where("kind not in ('heading', 'sentence') and not closed").select(key, F.col("ord").alias("parent"))
        own.append(said.join(blocks, [key, "parent"], "left_semi").select(key, "ord"))
    anchors = said.join(reduce(DataFrame.unionByName, own), [key, "ord"], "left_semi").select(key, F.col("place").alias("at"), F.col("heading").alias("under"))
    # Each anchor names the places around it, so that the join is by equality however many anchors a text has.
    around = anchors.select(key, "under", F.explode(F.sequence(F.col("at") - before, F.col("at") + after)).alias("place"))
    wanted = around.select(key, "place", F.col("under").alias("heading")) if clip else around.select(key, "place")
    near = said.join(wanted.distinct(), wanted.columns, "left_semi")
    themselves = asked.where("kind = 'heading' or closed").select(key, "ord", F.when(F.col("kind") == "heading", -1).otherwise(F.col("heading")).alias("heading"))  # a heading has none itself
    chosen = near.select(key, "ord", "heading").unionByName(themselves).distinct()
    heads = chosen.where("heading >= 0").select(key, F.col("heading").alias("ord"))
    return chosen.select(key, "ord").unionByName(heads).distinct()


def locate_quote(text: Column, quote: Column) -> Column:
    """Struct (status, start): located, quote_missing or location_ambiguous (overlapping hits count)."""
    first = F.locate(quote, text) if isinstance(quote, str) else F.instr(text, quote)
    second = F.instr(F.substring(text, first + F.lit(1), F.length(text)), quote)
    return F.struct(F.when(first == 0, "quote_missing").when(second > 0, "location_ambiguous").otherwise("located").alias("status"), F.when((first > 0) & (second == 0), first - 1).otherwise(-1).cast("long").alias("start"))


def locate_in_units(anchors: DataFrame, found: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, anchor, status, start, end, unit): each quote's place within the units that it names.

    Anchors have anchor (their id), quote and ``named``, the ords of units in order.  Only the hull of the named units is searched, overlapping occurrences counted.  Codes:
    ``invalid_source_units`` (none, a repeated or an unknown one, or one that the quote doesn't touch), ``invalid_source_order``, ``quote_missing``, ``location_ambiguous``,
    ``incomplete_source_units`` (no named unit holds the quote, and it crosses a sentence that isn't named), else ``located`` with the smallest named unit that holds it, or none.
    """
    own = anchors.withColumn("__n", F.size("named"))
    touched = own.select(key, "anchor", F.explode("named").alias("ord")).join(found.select(key, "ord", "start", "end"), [key, "ord"])
    hull = touched.groupBy(key, "anchor").agg(F.min("start").alias("low"), F.max("end").alias("high"), F.count("*").alias("known"), F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("units"))
    rows = own.join(hull, [key, "anchor"], "left").join(texts.select(key, pieces(F.col("text")).alias("__pieces")).hint("merge"), key)
    rows = rows.select(key, "anchor", "quote", "named", "__n", "known", "units", "low", slice_of_pieces(F.col("__pieces"), F.col("low"), F.col("high")).alias("__window"))
    rows = rows.withColumn("__first", F.instr("__window", F.col("quote")))
    rows = rows.withColumn("__again", F.instr(F.substring("__window", F.col("__first") + 1, F.length("__window")), F.col("quote"))).drop("__window")
    rows = rows.withColumn("start", F.col("low") + F.col("__first") - 1).withColumn("end", F.col("start") + F.length("quote"))
    holding = F.filter("units", lambda u: (u["start"] <= F.col("start")) & (F.col("end") <= u["end"]))
    smallest = F.array_min(F.transform(holding, lambda u: F.struct((u["end"] - u["start"]).alias("n"), u["ord"].alias("ord"))))["ord"]
    status = (
        F.when((F.col("__n") == 0) | (F.size(F.array_distinct("named")) < F.col("__n")) | (F.coalesce("known", F.lit(0)) < F.col("__n")), "invalid_source_units")
        .when(F.col("named") != F.sort_array("named"), "invalid_source_order")
        .when(F.col("__first") == 0, "quote_missing")
        .when(F.col("__again") > 0, "location_ambiguous")
        .when(F.exists("units", lambda u: (u["start"] >= F.col("end")) | (F.col("start") >= u["end"])), "invalid_source_units")
        .otherwise("located")
    )
    placed = rows.withColumn("status", status)
    good = F.col("status") == "located"
    placed = materialise(placed.select(key, "anchor", "named", "status", F.when(good, F.col("start")).alias("start"), F.when(good, F.col("end")).alias("end"), F.when(good, smallest).alias("unit")), "placed")
    # Sentences meet quotes by the pieces of the text that both touch, not by the text, which would make a row for each pair.
    sentences_ = found.where("kind = 'sentence'").select(key, F.col("ord").alias("s_ord"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), _touched_pieces("start", "end"))
    open_ = placed.where(good & F.col("unit").isNull()).select(key, "anchor", "named", "start", "end", _touched_pieces("start", "end"))
    crossed = open_.join(sentences_, [key, "__piece"]).where("s_start < end and start < s_end")
    unnamed = crossed.where(~F.array_contains("named", F.col("s_ord"))).select(key, "anchor").distinct().withColumn("__unnamed", F.lit(True))
    incomplete = good & F.col("unit").isNull() & F.coalesce("__unnamed", F.lit(False))
    told = placed.join(unnamed, [key, "anchor"], "left").withColumn("__incomplete", incomplete)
    place = [F.when(~F.col("__incomplete"), F.col(x)).alias(x) for x in ("start", "end", "unit")]
    return told.select(key, "anchor", F.when(F.col("__incomplete"), "incomplete_source_units").otherwise(F.col("status")).alias("status"), *place)


def _touched_pieces(start: str, end: str) -> Column:
    """The numbers of the pieces of a text that a span touches, a row each."""
    return F.explode(F.sequence(F.floor(F.col(start) / PIECE), F.floor(F.greatest(F.col(start), F.col(end) - 1) / PIECE))).alias("__piece")


def support_envelope(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest span that covers all anchors (start, end) of a key."""
    return anchors.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def smallest_unit(spans: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, start, end, unit): the order of the shortest unit that contains each span, -1 where none does."""
    u = found.select(key, F.col("start").alias("a"), F.col("end").alias("b"), "ord")
    both = spans.join(u, key, "left").withColumn("fits", (F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b")))
    best = F.min_by(F.col("ord"), F.when(F.col("fits"), F.struct(F.col("b") - F.col("a"), F.col("ord"))))
    return both.groupBy(key, "start", "end").agg(F.coalesce(best, F.lit(-1)).alias("unit"))


#: Fixed value: a numbered marker with its url.
MARKER = r"\[\[[0-9]+\]\]\((https?://[^\s()]+)\)"


def citation_markers(answers: DataFrame, references: DataFrame, key: str, text: str, url: str) -> DataFrame:
    """(key, number, url, start, end) of markers ``[[n]](url)`` that cite a captured url; answers with unsafe markup (code, HTML, escapes) have none.

    A marker counts if no ``!`` or ``[`` stands right before it and every bracket opened before it is closed there.  The text is cut at its markers; a fold over the pieces carries
    the place reached and the depth of brackets, so that each marker knows both without looking at the text again.
    """
    safe = answers.where(~F.col(text).rlike(r"[`<>\\]|(?:^|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])(?: {4}|\t)"))
    cut = safe.select(key, F.split(text, MARKER).alias("pieces"), F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)).alias("marks")).where(F.size("marks") > 0)
    depth = lambda s: F.length(F.regexp_replace(s, r"[^\[]", "")) - F.length(F.regexp_replace(s, r"[^\]]", ""))
    none = F.array().cast("array<struct<start:int,depth:int,before:string,mark:string>>")

    def step(acc: Column, x: Column) -> Column:
        start, level = acc["at"] + F.length(x["piece"]), acc["depth"] + depth(x["piece"])
        before = F.when(F.length(x["piece"]) > 0, F.right(x["piece"], F.lit(1))).otherwise(acc["last"])
        met = F.struct(start.alias("start"), level.alias("depth"), before.alias("before"), x["mark"].alias("mark"))
        return F.struct((start + F.length(x["mark"])).alias("at"), level.alias("depth"), F.lit(")").alias("last"), F.array_append(acc["out"], met).alias("out"))

    pairs = F.transform(F.arrays_zip(F.slice("pieces", 1, F.size("marks")).alias("piece"), F.col("marks").alias("mark")), lambda p: F.struct(p["piece"].alias("piece"), p["mark"].alias("mark")))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("last"), none.alias("out"))
    met = cut.select(key, F.explode(F.aggregate(pairs, start, step)["out"]).alias("m")).where((F.col("m.depth") == 0) & ~F.col("m.before").isin("!", "["))
    number, target = F.regexp_extract("m.mark", r"^\[\[([0-9]+)", 1), F.regexp_extract("m.mark", MARKER, 1)
    marks = met.select(key, number.cast("long").alias("number"), target.alias(url), F.col("m.start").cast("long").alias("start"), (F.col("m.start") + F.length("m.mark")).cast("long").alias("end"))
    return marks.join(references.select(key, url).distinct(), [key, url], "left_semi").select(key, "number", url, "start", "end")


def reference_cue(text: Column) -> Column:
    """Whether a sentence refers back: it starts with, or holds, a cue pronoun."""
    return text.rlike(rf"(?i)(^|[^\p{{L}}])({CUES})([^\p{{L}}]|$)")


def cue_context(found: DataFrame, key: str) -> DataFrame:
    """(key, ord, context): for each sentence with ``cue`` the nearest sentence before it under the same heading, else its heading, else -1."""
    w = W.partitionBy(key, "heading").orderBy("ord")
    said = found.where("kind = 'sentence'").withColumn("before", F.lag("ord").over(w))
    return said.where("cue").select(key, "ord", F.coalesce("before", F.when(F.col("heading") >= 0, F.col("heading")), F.lit(-1)).alias("context"))
