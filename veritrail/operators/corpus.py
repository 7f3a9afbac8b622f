"""Corpus ingestion: page parsing into blocks, language and root gates, links, passages, article status, version chains, manifests, capture responses."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import strict_json

# Fixed sets: chrome by element and by class, classes that chrome must not hold, elements that part blocks, block elements, elements that an article must not hold.
CHROME = frozenset("nav script style form noscript button iframe template".split())
CHROME_CLASSES = frozenset("consent cookie-banner breadcrumbs share-tools related-pages local-toc".split())
PROTECTED_CLASSES = frozenset("references sources footnotes article-meta advice".split())
FAQ_CLASS, FAQ_LEVEL = "faq-question", 2
SCOPE_CLASSES = frozenset("background-container accordion-item".split())  # boxes that headings inside them don't reach beyond
CONTAINERS = frozenset("div section article main header footer aside figure dl ul ol".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
UNSUPPORTED = frozenset("table math svg object embed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLANK = re.compile(r"[ \t\r\n\f]+")


class _Page(HTMLParser):
    """Blocks, headings, list items, links and exclusions of the page's one root element; the first problem is kept as a reason."""

    def __init__(self, root: str, url: str, most_depth: int = 200, scopes: frozenset[str] = SCOPE_CLASSES):
        super().__init__(convert_charrefs=True)
        self.root, self.url, self.most_depth = root, url, most_depth
        self.stack: list[tuple[str, bool, int]] = []  # (tag, is it chrome, its place among its like siblings)
        self.children: list[dict[str, int]] = [{}]  # tags so far under the document and each open element
        self.lang, self.reason, self.roots = "", "", 0
        self.blocks: list[dict] = []
        self.links: list[dict] = []
        self.excluded: list[str] = []
        self.inside = self.chrome = 0
        self.current: dict | None = None
        self.lists: list[list] = []
        self.outer = 0  # outermost lists so far
        self.scopes = scopes
        self.boxes: list[str] = []  # for each open element its locator if it is a scope, else nothing
        self.path: list[tuple[int, int, str]] = []  # (level, block, scope) of the open headings
        self.ends: dict[int, int] = {}  # of headings the block that ends their section
        self.h1 = 0

    def fail(self, reason: str) -> None:
        self.reason = self.reason or reason

    def locator(self) -> str:
        return "/".join(f"{t}[{k}]" for t, _, k in self.stack)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = given.get("lang", "").split("-")[0].lower()
        if tag in VOID:
            if tag == "br" and self.current is not None:
                self.current["text"] = self.current["text"].rstrip(" ") + "\n"
            return
        classes = set(given.get("class", "").split())
        opens = not self.chrome and (tag in BLOCKS and not self._in_item(tag) or FAQ_CLASS in classes)
        if not self.chrome:
            if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:
                self._pop()  # an implied end
            self._part(tag)
            if opens:
                self._close_block()
        here = self.children[-1]
        here[tag] = here.get(tag, 0) + 1
        hidden = tag in CHROME or bool(classes & CHROME_CLASSES)
        self.stack.append((tag, hidden, here[tag]))
        self.children.append({})
        self.boxes.append(self.locator() if classes & self.scopes else "")
        if len(self.stack) > self.most_depth:
            self.fail("depth_limit")
        if tag == self.root and not self.chrome and not hidden:
            self.roots += 1
            self.inside += 1
        if hidden and self.inside and not self.chrome:
            self.excluded.append(self.locator())
        self.chrome += hidden
        if self.inside and self.chrome and classes & PROTECTED_CLASSES:
            self.fail("chrome_contains_article_reference")
        if not self.inside or self.chrome:
            return
        if tag in UNSUPPORTED:
            self.fail("unsupported_structure")
        if tag in ("ul", "ol"):
            if "reversed" in given or given.get("type"):
                self.fail("unsupported_list")
            self.outer += not self.lists
            self.lists.append([tag, int(given["start"]) if given.get("start", "").lstrip("-").isdigit() else 1])
        if opens:
            self._open_block(f"h{FAQ_LEVEL}" if FAQ_CLASS in classes else tag, given)
        if tag == "a" and given.get("href") and self.current is not None:
            target = urljoin(self.url, given["href"])
            self.links.append({"block": len(self.blocks), "start": len(self.current["text"]), "href": given["href"], "target": target, "navigable": urlsplit(target).scheme in ("http", "https")})

    def _in_item(self, tag: str) -> bool:
        """A paragraph or container within a list item is part of the item's text."""
        return bool(self.lists) and tag not in ("li", "ul", "ol")

    def _part(self, tag: str) -> None:
        """A container's start or end ends the block at hand; within a list item it is a space."""
        if self._in_item(tag):
            if tag in CONTAINERS | BLOCKS and self.current is not None and self.current["text"][-1:] not in ("", " ", "\n"):
                self.current["text"] += " "
        elif tag in CONTAINERS:
            self._close_block()

    def _pop(self) -> str:
        name, hidden, _ = self.stack.pop()
        self.children.pop()
        self.boxes.pop()
        self.chrome -= hidden
        return name

    def _resume(self) -> None:
        """Text without a block of its own: the rest of a list item after a list in it, or a paragraph."""
        if self.lists and self.blocks and self.blocks[-1]["list"] == self.outer:
            last = self.blocks.pop()
            self.current = last | {"text": last["text"] + " ", "mark": 0, "pre": False}
        else:
            self._open_block("p", {})

    def _open_block(self, tag: str, given: dict[str, str]) -> None:
        kind = "heading" if tag[0] == "h" and tag[1:].isdigit() else "list_item" if tag == "li" else "paragraph"
        text = ""
        if kind == "list_item" and self.lists:
            now = self.lists[-1]
            if given.get("value", "").lstrip("-").isdigit():
                now[1] = int(given["value"])
            text = "  " * (len(self.lists) - 1) + (f"{now[1]}. " if now[0] == "ol" else "- ")
            now[1] += 1
        self.h1 += tag == "h1"
        self.current = {"kind": kind, "level": int(tag[1]) if kind == "heading" else 0, "text": text, "mark": len(text), "locator": self.locator(), "pre": tag == "pre", "list": self.outer if kind == "list_item" and self.lists else 0}
        self.current["within"] = [x for x in self.boxes if x]
        self.current["scope"] = next((x for x in reversed(self.boxes[:-1]) if x), "")

    def _end_sections(self, block: dict) -> None:
        """The headings that the next block is no longer under: those on top whose box it lies outside of; for a heading also those of its level or deeper."""
        while self.path and self.path[-1][2] and self.path[-1][2] not in block["within"]:
            self.ends[self.path.pop()[1]] = len(self.blocks)
        while block["kind"] == "heading" and self.path and self.path[-1][0] >= block["level"]:
            self.ends[self.path.pop()[1]] = len(self.blocks)

    def _close_block(self) -> None:
        block, self.current = self.current, None
        if block is None:
            return
        text = block["text"].rstrip()
        if len(text) <= block["mark"] and not text[block["mark"] :]:
            if any(link["block"] == len(self.blocks) for link in self.links):
                self.fail("empty_block_with_link")
            return
        self._end_sections(block)
        self.blocks.append({k: block[k] for k in ("kind", "level", "locator", "list", "within", "scope")} | {"text": text, "headings": [i for _, i, _ in self.path]})
        if block["kind"] == "heading":
            self.path.append((block["level"], len(self.blocks) - 1, block["scope"]))

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(t == tag for t, _, _ in self.stack):
            return
        if not self.chrome:
            self._part(tag)
            if tag in BLOCKS and not self._in_item(tag):
                self._close_block()
        while self.stack:
            covered = self.chrome > 0
            name = self._pop()
            if name in ("ul", "ol") and self.lists and self.inside and not covered:
                self.lists.pop()
            if name == self.root and self.inside and not covered:
                self._close_block()
                self.inside -= 1
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.inside and not self.chrome and data.strip():
            if self.current is None:
                self._resume()
            if self.current["pre"]:
                self.current["text"] += data
                return
        if self.current is not None and not self.chrome:
            piece = _BLANK.sub(" ", data)
            text = self.current["text"]
            self.current["text"] = text + (piece.lstrip(" ") if not text or text[-1:] in " \n" else piece)


def parse_page(page: str, url: str, language: str | None = "de", root: str = "article", most_chars: int = 1_000_000, scopes: frozenset[str] = SCOPE_CLASSES) -> dict:
    """Cleaned text and structure of a page, or the reason why it is unusable; unsupported structure is never guessed at."""
    reader = _Page(root, url, scopes=scopes)
    reader.feed(page)
    reader.close()
    reader._close_block()
    title = re.search(r"(?is)<title[^>]*>(.*?)</title", page)
    name = entities.unescape(title[1]).strip() if title else ""
    if reader.roots != 1:
        reader.fail("root_missing" if not reader.roots else "root_not_unique")
    if language and reader.lang not in ("", language):
        reader.fail("wrong_language")
    if reader.h1 != 1:
        reader.fail("h1_not_unique")
    if re.search(r"(?i)\b(404|not found|fehler)\b", name):
        reader.fail("error_page")
    pieces, at, before = [], 0, 0
    for i, block in enumerate(reader.blocks):
        gap = "" if not i else "\n" if block["list"] and block["list"] == before else "\n\n"  # the items of one list are lines
        pieces += [gap, block["text"]]
        block["start"] = at + len(gap)
        block["end"] = at = block["start"] + len(block["text"])
        before = block["list"]
    text = "".join(pieces)
    for i, block in enumerate(reader.blocks):
        ended = reader.blocks[reader.ends[i]]["start"] if i in reader.ends else len(text)
        block["section_end"] = ended if block["kind"] == "heading" else None
    if len(text) > most_chars:
        reader.fail("char_limit")
    return {"reason": reader.reason, "title": name, "text": text, "blocks": reader.blocks, "links": reader.links, "excluded": reader.excluded}


PARSED = "reason string, title string, text string, blocks array<struct<kind:string,level:long,start:long,end:long,headings:array<long>,locator:string,section_end:long>>, links array<struct<block:long,start:long,href:string,target:string,navigable:boolean>>, excluded array<string>"


def parse_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", language: str | None = "de") -> DataFrame:
    """One row per page with the result of ``parse_page``; a null page is unusable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for value, where, page in zip(frame[key], frame[url], frame[html], strict=True):
                got = parse_page(page, where or "", language) if page else {"reason": "missing_body", "title": "", "text": "", "blocks": [], "links": [], "excluded": []}
                blocks = [{k: b[k] for k in ("kind", "level", "start", "end", "headings", "locator", "section_end")} for b in got["blocks"]]
                rows.append((value, got["reason"], got["title"], got["text"], blocks, got["links"], got["excluded"]))
            yield pd.DataFrame(rows, columns=[key, "reason", "title", "text", "blocks", "links", "excluded"])

    return pages.select(key, url, html).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {PARSED}")


def article_status(receipts: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """(key, status, reason): failed by transport, unusable by its structure, or usable."""
    both = receipts.join(parsed.select(key, F.col("reason").alias("__r")), key, "left")
    reason = F.coalesce("error", F.nullif("__r", F.lit("")))
    return both.select(key, F.when(F.col("error").isNotNull(), "failed").when(reason.isNotNull(), "unusable").otherwise("usable").alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def passages(blocks: DataFrame, article: str, order: str) -> DataFrame:
    """(article, ord, start, end, first): one passage per block that is no heading; a paragraph that ends in ``:`` takes the list after it in.

    ``blocks`` has kind, start, end, headings (an id of its path), and colon.  Consecutive list items under one path are one list.
    """
    w = W.partitionBy(article).orderBy(order)
    rows = blocks.withColumn("item", F.col("kind") == "list_item")
    starts = F.coalesce(~(F.col("item") & F.lag("item").over(w) & F.lag("headings").over(w).eqNullSafe(F.col("headings"))), F.lit(True))
    rows = rows.withColumn("unit", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    units = rows.groupBy(article, "unit").agg(F.min(order).alias("first"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", order).alias("kind"), F.min_by("headings", order).alias("headings"), F.max_by("colon", order).alias("colon"))
    v = W.partitionBy(article).orderBy("unit")
    absorbs = lambda kind, colon, nxt, here, there: (kind == "paragraph") & colon & (nxt == "list_item") & here.eqNullSafe(there)
    takes = F.coalesce(absorbs(F.col("kind"), F.col("colon"), F.lead("kind").over(v), F.col("headings"), F.lead("headings").over(v)), F.lit(False))
    taken = F.coalesce(absorbs(F.lag("kind").over(v), F.lag("colon").over(v), F.col("kind"), F.lag("headings").over(v), F.col("headings")), F.lit(False))
    kept = units.withColumns({"end": F.when(takes, F.lead("end").over(v)).otherwise(F.col("end")), "__taken": taken}).where("not __taken and kind <> 'heading'")
    return kept.select(article, (F.row_number().over(v) - 1).cast("long").alias("ord"), "start", "end", "first")


def roundtrip_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Passages (text, start, end, exact_text) whose text is not what the source has at their span."""
    return rows.where(F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) != F.col("exact_text")).select(*key)


def membership_mismatch(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, code) where expected and stored members (key, sha256) differ: member_missing, member_unexpected, member_hash_mismatch."""
    both = expected.select(key, F.col("sha256").alias("a")).join(stored.select(key, F.col("sha256").alias("b")), key, "full_outer")
    code = F.when(F.col("b").isNull(), "member_missing").when(F.col("a").isNull(), "member_unexpected").when(F.col("a") != F.col("b"), "member_hash_mismatch")
    return both.select(key, code.alias("code")).where("code is not null")


# Fixed sets of an answer's structure: kinds of elements, their fields, kinds of references, and what can't be told apart from a citation marker.
ELEMENT_KINDS = frozenset("ai_overview ai_overview_element ai_overview_table_element ai_overview_expanded_element ai_overview_expanded_component".split())
ELEMENT_FIELDS = frozenset("type markdown text title items components references links images table position rank_group rank_absolute page xpath rectangle".split())
REFERENCE_KINDS = frozenset("ai_overview_reference link_element".split())
SOURCES = "state string, diagnostics array<string>, sources array<struct<location:string,type:string,url:string,title:string,excerpt:string>>"


def pointer(*steps: object) -> str:
    """A JSON pointer; ``~`` and ``/`` within a step are escaped."""
    return "".join("/" + str(x).replace("~", "~0").replace("/", "~1") for x in steps)


def answer_sources(body: str | None, root: tuple = ("tasks", 0, "result", 0, "items")) -> tuple[str, list[str], list[dict]]:
    """State, diagnostics and sources of one captured answer, walked without recursion.

    The answer is the first item below ``root``; references and links of it, and of its items and components at any depth, are sources.  The state is ``available`` where all of the structure
    is known and whole, ``incomplete`` where part of it isn't, ``unknown`` where no list of references was given.  Several items at the root, an unknown kind or field, a fragment that the answer's text
    lacks, and malformed entries make it incomplete; each has its diagnostic but the first, and a list of references that is missing or null.
    """
    try:
        node = json.loads(body or "")
        for step in root:
            node = node[step]
        first = node[0]
    except (ValueError, TypeError, LookupError, RecursionError):
        return "unknown", ["answer_absent"], []
    if not isinstance(node, list) or not isinstance(first, dict) or not isinstance(first.get("markdown"), str) or not first["markdown"].strip():
        return "unknown", ["answer_absent"], []
    found: set[str] = set()
    out: list[dict] = []
    whole, assessed, answer = len(node) == 1, False, first["markdown"]
    left = [(first, (*root, 0))]
    while left:
        here, path = left.pop()
        if here.get("type") not in ELEMENT_KINDS:
            found.add("unsupported_source_structure")
        if here.keys() - ELEMENT_FIELDS or here.get("images") not in (None, []):
            found.add("unsupported_source_fields")
        if here is not first and isinstance(here.get("markdown"), str) and here["markdown"] not in answer:
            found.add("fragment_not_in_aggregate_answer")
        whole &= here.get("references") is not None
        for name in ("references", "links"):
            given = here.get(name)
            if given is not None and not isinstance(given, list):
                found.add("malformed_reference_collection")
                continue
            assessed |= name == "references" and given is not None
            for i, entry in enumerate(given or []):
                url = entry.get("url") if isinstance(entry, dict) else None
                if not isinstance(url, str) or not re.fullmatch(r"(?i)https?://[^\s/?#]\S*", url):
                    found.add("malformed_reference")
                    continue
                if entry.get("type") not in REFERENCE_KINDS:
                    found.add("unsupported_reference_type")
                excerpt = entry.get("text") if name == "references" else None
                if excerpt is not None and not isinstance(excerpt, str):
                    found.add("malformed_excerpt")
                    excerpt = None
                out.append({"location": pointer(*path, name, i), "type": name, "url": url, "title": str(entry.get("title") or ""), "excerpt": excerpt or None})
        for name in ("components", "items"):
            inner = here.get(name, [])
            if not isinstance(inner, list):
                found.add("unsupported_source_structure")
                continue
            if not all(isinstance(x, dict) for x in inner):
                found.add("malformed_source_element")
            left += [(x, (*path, name, i)) for i, x in reversed(list(enumerate(inner))) if isinstance(x, dict)]
    state = "unknown" if not assessed and not out else "available" if whole and not found else "incomplete"
    if re.search(r"[`<>\\]|(?m:^(?: {4}|\t))", answer):
        found.add("unsupported_citation_markup")  # says nothing about the sources
    return state, sorted(found), out


def walk_references(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, state, diagnostics, sources) of each captured answer: see ``answer_sources``.  A null or broken body is ``answer_absent``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, *answer_sources(text)) for k, text in zip(frame[key], frame[body], strict=True)], columns=[key, "state", "diagnostics", "sources"])

    return answers.select(key, body).mapInPandas(run, f"`{key}` {answers.schema[key].dataType.simpleString()}, {SOURCES}")


class _Number(str):
    """A number as it is written."""


def _refuse(name: str) -> None:
    raise ValueError(name)


def json_nodes(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(pointer, kind, value) of each node in document order; the value of a number is as written, of a string itself, of containers and null none."""
    try:
        left = [("", json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse))]
    except (ValueError, RecursionError):
        yield "", "invalid", None
        return
    while left:
        at, node = left.pop()
        if isinstance(node, (dict, list)):
            inner = list(node.items() if isinstance(node, dict) else enumerate(node))
            left += [(at + pointer(step), x) for step, x in reversed(inner)]
            yield at, "object" if isinstance(node, dict) else "array", None
        elif isinstance(node, bool):
            yield at, "boolean", str(node).lower()
        else:
            yield at, "null" if node is None else "number" if isinstance(node, _Number) else "string", node and str(node)


def json_pointers(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pointer, kind, value) of each node of each text; a broken text is one node of kind ``invalid``, a null text has none, and of a name given twice the last counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes = [(k, *x) for k, text in zip(frame[key], frame[body], strict=True) if text is not None for x in json_nodes(text)]
            for at in range(0, len(nodes), 10_000):
                yield pd.DataFrame(nodes[at : at + 10_000], columns=[key, "pointer", "kind", "value"])

    return rows.select(key, body).mapInPandas(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, pointer string, kind string, value string")


def response_failure(status: Column, body: Column, tag: Column, language: str) -> Column:
    """The first failing check of a captured response, in order, or succeeded."""
    g = lambda p: F.get_json_object(body, p)
    return (
        F.when(status.isNull(), "transport_error")
        .when(body.isNull(), "missing_response")
        .when(~status.between(200, 299), F.concat(F.lit("http_"), status.cast("string")))
        .when(strict_json(body) != "ok", "invalid_json")
        .when(F.coalesce(g("$.status_code").cast("int"), F.lit(-1)) != 20000, "provider_error")
        .when(F.coalesce(g("$.tasks_count").cast("int"), F.lit(-1)) != 1, "task_count")
        .when(F.coalesce(g("$.tasks[0].data.tag"), F.lit("")) != tag, "tag_mismatch")
        .when(F.coalesce(g("$.tasks[0].result[0].language_code"), F.lit("")) != language, "language_mismatch")
        .when(F.trim(F.coalesce(g("$.tasks[0].result[0].items[0].markdown"), F.lit(""))) == "", "blank_answer")
        .otherwise("succeeded")
    )


def replay_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, with their side."""
    names = a.columns
    return a.exceptAll(b.select(*names)).withColumn("side", F.lit("first")).unionByName(b.select(*names).exceptAll(a).withColumn("side", F.lit("second")))
