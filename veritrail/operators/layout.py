"""Page layouts: elements as nested intervals, tree patterns over them as columns and one aggregation, subtree signatures against an allow list."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import BLOCKS, CONTAINERS, VOID

# An element that the start of one of these ends; fixed values of HTML.
IMPLIED = {"p": BLOCKS | CONTAINERS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"})}
ELEMENT = "struct<ord:int,parent:int,before:int,last:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,text:string,signature:string>"
ROWS = 20_000  # elements of a batch that Python gives back, or those of one page


# A tag with quotes kept whole, a comment or declaration (what isn't closed takes the rest); a tag that another one cuts off is text, so that a page is read in linear time.
_MARK = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|!--(?:.*?-->|.*)|[!?][^>]*+(?:>|$))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'=/<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_RAW = {x: re.compile(rf"(?i)</{x}\b") for x in ("script", "style", "textarea", "title")}  # elements whose content holds no tags


class _Tree:
    """The elements of a page in document order; each with its parent, the sibling before it, the last element inside it and its own text."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.held: list[list] = []  # of each element its texts and the places of its children, in order
        self.newest: dict[int, int] = {}  # of each element its newest child
        self.open: list[int] = []
        self.tags: dict[str, int] = {}  # how many elements of each tag are open

    def read(self, page: str) -> None:
        at = 0
        while mark := _MARK.search(page, at):
            self._text(page[at : mark.start()])
            at = mark.end()
            ends, tag, rest = mark[1], mark[2], mark[3]
            if not tag:
                continue
            tag = tag.lower()
            if ends:
                self._end(tag)
                continue
            given: dict[str, str] = {}
            if rest:
                for name, *values in _ATTRIBUTE.findall(rest):
                    given.setdefault(name.lower(), unescape("".join(values)))
            self._start(tag, given)
            if tag in _RAW:
                end = _RAW[tag].search(page, at)
                stop = end.start() if end else len(page)
                self._text(page[at:stop], raw=tag in ("script", "style"))
                at = stop
        self._text(page[at:])

    def _start(self, tag: str, given: dict[str, str]) -> None:
        while self.open and tag in IMPLIED.get(self.rows[self.open[-1]]["tag"], ()):
            self._shut()
        here, parent = len(self.rows), self.open[-1] if self.open else -1
        self.rows.append({"ord": here, "parent": parent, "before": self.newest.get(parent, -1), "last": here, "tag": tag, "id": given.get("id", ""), "classes": given.get("class", "").split(), "attrs": given, "text": ""})
        self.held.append([])
        self.newest[parent] = here
        if parent >= 0:
            self.held[parent].append(here)
        if tag not in VOID:
            self.open.append(here)
            self.tags[tag] = self.tags.get(tag, 0) + 1

    def _shut(self) -> str:
        row = self.rows[self.open.pop()]
        row["last"] = len(self.rows) - 1
        self.tags[row["tag"]] -= 1
        return row["tag"]

    def _end(self, tag: str) -> None:
        if self.tags.get(tag):
            while self._shut() != tag:
                pass

    def _text(self, data: str, raw: bool = False) -> None:
        if data and self.open and (text := data.strip()):
            self.held[self.open[-1]].append(text if raw else unescape(text).strip())

    def finished(self, signed: bool) -> list[dict]:
        """All rows, with own texts and, if asked for, signatures: the hash of an element's tag, sorted attributes, and its texts and children's signatures in order."""
        while self.open:
            self._shut()
        for row, held in zip(reversed(self.rows), reversed(self.held), strict=True):
            row["text"], row["signature"] = " ".join(x for x in held if isinstance(x, str)), None
            if not signed:
                continue
            inside = [x if isinstance(x, str) else {"element": self.rows[x]["signature"]} for x in held]
            whole = json.dumps([row["tag"], sorted(row["attrs"].items()), inside], ensure_ascii=False, separators=(",", ":"))
            row["signature"] = hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()
        return self.rows


def page_elements(page: str | None, signed: bool = False) -> list[dict]:
    """The elements of one page; a null page has none."""
    reader = _Tree()
    reader.read(page or "")
    return reader.finished(signed)


def elements(pages: DataFrame, key: str, html: str, *others: str, signed: bool = False) -> DataFrame:
    """One row per page: key, ``others`` and its ``elements`` in document order (place i holds ord i).

    What lies inside an element is exactly the places after its own up to ``last``; -1 stands for no parent or no sibling before.  Without ``signed`` the signatures are null.
    """
    kept = [key, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends, first = [], [0], 0
            for i, page in enumerate(batch.column(len(kept))):
                rows += page_elements(page.as_py(), signed)
                ends.append(len(rows))
                if len(rows) >= ROWS or i == batch.num_rows - 1:
                    arrays = [c.slice(first, i + 1 - first) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _columns(rows))], names=[*kept, "elements"])
                    rows, ends, first = [], [0], i + 1

    kinds = ", ".join(f"`{x}` {pages.schema[x].dataType.simpleString()}" for x in kept)
    return pages.select(*kept, F.col(html).alias("__html")).mapInArrow(run, f"{kinds}, elements array<{ELEMENT}>")


def _columns(rows: list[dict]) -> pa.StructArray:
    """The elements as one Arrow array, made column by column."""
    ends = pa.array([0, *accumulate(len(r["attrs"]) for r in rows)], pa.int32())
    names, values = (pa.array([x for r in rows for x in part(r["attrs"])], pa.string()) for part in (dict.keys, dict.values))
    plain = {"ord": pa.int32(), "parent": pa.int32(), "before": pa.int32(), "last": pa.int32(), "tag": pa.string(), "id": pa.string(), "classes": pa.list_(pa.string()), "text": pa.string(), "signature": pa.string()}
    made = {name: pa.array([r[name] for r in rows], kind) for name, kind in plain.items()} | {"attrs": pa.MapArray.from_arrays(ends, names, values)}
    order = ["ord", "parent", "before", "last", "tag", "id", "classes", "attrs", "text", "signature"]
    return pa.StructArray.from_arrays([made[x] for x in order], names=order)


@dataclass(frozen=True)
class Layout:
    """Classes that a site's pages are made of."""

    container: str = "content"  # the one box of all frames
    frames: tuple[str, ...] = ("frame", "nav-breadcrumb", "share")  # what may lie directly in it
    toc: str = "toc"
    group: str = "accordion"  # questions; stands after a sibling that has a header with an h2
    item: str = "accordion-item"
    button: str = "accordion-headline"
    answer: str = "accordion-content"


def _has(e: Column, *classes: str) -> Column:
    return F.arrays_overlap(e["classes"], F.array(*map(F.lit, classes)))


def _facts(e: Column, every: Column, toc: Column, layout: Layout) -> Column:
    """What an element says about a group of elements that a rule compares: its id and links to it, or the item of a question."""
    inside = F.slice(every, e["ord"] + 2, e["last"] - e["ord"])
    above = F.when(e["parent"] >= 0, F.get(every, e["parent"]))
    sibling = F.when(e["before"] >= 0, F.get(every, e["before"]))
    titles = F.filter(F.slice(every, sibling["ord"] + 2, sibling["last"] - sibling["ord"]), lambda x: (x["tag"] == "h2") & (F.get(every, x["parent"])["tag"] == "header") & (F.get(every, x["parent"])["parent"] == sibling["ord"]))
    in_toc = F.coalesce((e["ord"] > toc["ord"]) & (e["ord"] <= toc["last"]), F.lit(False))
    href = F.coalesce(e["attrs"]["href"], F.lit(""))

    def fact(group: Column, role: str, first: Column, second: Column, good: Column) -> Column:
        return F.struct(group.alias("at"), F.lit(role).alias("role"), first.alias("first"), second.alias("second"), F.coalesce(good, F.lit(False)).alias("good"))

    empty, item = F.lit(""), F.concat(F.lit("/"), e["parent"].cast("string"))
    place = F.concat(F.lit("/"), e["ord"].cast("string"))
    found = F.array(
        F.when(e["id"] != "", fact(F.concat(F.lit("#"), e["id"]), "target", empty, empty, ~in_toc)),
        F.when(in_toc & (e["tag"] == "a"), fact(F.when(F.startswith(href, F.lit("#")), href).otherwise(place), "link", empty, empty, F.startswith(href, F.lit("#")))),
        F.when(_has(e, layout.button), fact(item, "button", e["id"], F.coalesce(e["attrs"]["aria-controls"], empty), (e["id"] != "") & (e["text"] == "") & _has(above, layout.item) & (F.size(F.filter(inside, lambda x: (x["parent"] == e["ord"]) & (x["tag"] == "h2"))) == 1))),
        F.when(_has(e, layout.answer) & _has(above, layout.item), fact(item, "answer", F.coalesce(e["attrs"]["aria-labelledby"], empty), e["id"], F.exists(inside, lambda x: x["tag"].isin("p", "ul", "ol")))),
        F.when(_has(e, layout.group) & (F.coalesce(F.size(titles), F.lit(0)) <= 0), fact(place, "site_faq_group_missing", empty, empty, F.lit(False))),
        F.when(_has(above, layout.container) & ~_has(e, *layout.frames), fact(place, "site_unselected_content", empty, empty, F.lit(False))),
        F.when(_has(e, layout.container) & (e["text"] != ""), fact(place, "site_unselected_content", empty, empty, F.lit(False))),
    )
    return F.array_compact(found)


def layout_violations(pages: DataFrame, key: str, html: str, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    """(key, code, at) of each broken assertion; ``at`` is an id as ``#id`` or an element's place as ``/ord``, empty for the page.

    Codes: site_layout_mismatch (not one container), site_unselected_content (a child of the container that is no known frame, or loose text in it), site_toc_mismatch (not one table of
    contents, or one without a link for each list item), site_toc_target_mismatch (a link of it that doesn't lead to exactly one element outside of it), duplicate_element_id, site_faq_mismatch
    (a button that isn't paired with the one answer of its item by both ids, has text of its own or not one heading, or whose answer is without paragraph or list), site_faq_group_missing.
    Pages that share a key stay apart; an empty or null page has neither container nor contents.  The pages are parsed once; only ids, links and questions are shuffled.
    """
    every = F.col("elements")
    tocs = F.filter(every, lambda e: _has(e, layout.toc))
    parsed = elements(pages, key, html).select(key, F.monotonically_increasing_id().alias("__page"), "elements", tocs.alias("tocs"), F.get(tocs, F.lit(0)).alias("toc"))
    within = F.slice(every, F.col("toc.ord") + 2, F.col("toc.last") - F.col("toc.ord"))
    links = F.size(F.filter(within, lambda e: e["tag"] == "a"))
    whole = [
        F.when(F.size(F.filter(every, lambda e: _has(e, layout.container))) != 1, "site_layout_mismatch"),
        F.when((F.size("tocs") != 1) | (links <= 0) | (links != F.size(F.filter(within, lambda e: e["tag"] == "li"))), "site_toc_mismatch"),
    ]
    of_page = F.transform(F.array_compact(F.array(*whole)), lambda code: F.struct(F.lit("").alias("at"), code.alias("role"), F.lit("").alias("first"), F.lit("").alias("second"), F.lit(False).alias("good")))
    facts = F.concat(of_page, F.flatten(F.transform(every, lambda e: _facts(e, every, F.col("toc"), layout))))
    rows = parsed.select(key, "__page", F.explode(facts).alias("f")).select(key, "__page", "f.*")
    role = lambda *names: F.col("role").isin(*names)
    only = lambda name, value: F.when(role(name), F.col(value))
    count = lambda name: F.count(F.when(role(name), 1))
    met = rows.groupBy(key, "__page", "at").agg(
        count("target").alias("targets"), count("link").alias("links"), count("button").alias("buttons"), count("answer").alias("answers"),
        F.coalesce(F.bool_and(F.when(role("target", "link"), F.col("good"))), F.lit(True)).alias("reachable"), F.coalesce(F.bool_and(F.when(role("button", "answer"), F.col("good"))), F.lit(True)).alias("paired"),
        *[f(only(r, c)).alias(f"{n}_{r}_{c}") for r in ("button", "answer") for c in ("first", "second") for n, f in (("min", F.min), ("max", F.max))],
        F.collect_set(F.when(~role("target", "link", "button", "answer"), F.col("role"))).alias("plain"),
    )
    same = lambda a, b: (F.col(f"min_{a}") == F.col(f"min_{b}")) & (F.col(f"max_{a}") == F.col(f"min_{b}"))
    fits = (F.col("answers") == 1) & F.col("paired") & same("button_first", "answer_first") & same("button_second", "answer_second")
    codes = F.array(
        F.when((F.col("links") > 0) & ((F.col("targets") != 1) | ~F.col("reachable")), "site_toc_target_mismatch"),
        F.when(F.col("targets") > 1, "duplicate_element_id"),
        F.when((F.col("buttons") > 0) & ~F.coalesce(fits, F.lit(False)), "site_faq_mismatch"),
    )
    return met.select(key, F.explode(F.concat("plain", F.array_compact(codes))).alias("code"), "at")


def subtree_signatures(pages: DataFrame, key: str, html: str, kinds: dict[str, str], *others: str) -> DataFrame:
    """(key, others, kind, ord, signature) of the elements that have one of the classes in ``kinds`` (class to kind)."""
    rows = elements(pages, key, html, *others, signed=True).select(key, *others, F.explode("elements").alias("e"))
    kind = F.coalesce(*[F.when(F.array_contains("e.classes", name), kind) for name, kind in kinds.items()], F.lit(None).cast("string"))
    return rows.select(key, *others, kind.alias("kind"), "e.ord", "e.signature").where("kind is not null")


def media_violations(pages: DataFrame, allowed: DataFrame, key: str, url: str, html: str, kinds: dict[str, str]) -> DataFrame:
    """(key, kind, ord, signature) of media whose subtree ``allowed`` (url, kind, signature) doesn't list for the page's url; a null url has no listed media."""
    found = subtree_signatures(pages, key, html, kinds, url)
    listed = allowed.select(F.col("url").alias(url), "kind", "signature")
    return found.join(listed, [url, "kind", "signature"], "left_anti").select(key, "kind", "ord", "signature")
