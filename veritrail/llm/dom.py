"""A small tolerant HTML parser: a tree of block elements whose leaves are runs of inline text.

Unclosed and wrongly nested tags are closed the way browsers mostly do; scripts, styles, titles and comments hold no text.
A head needs no state of its own: what may stand in it has no text, and anything else ends it.
"""

from __future__ import annotations

import html
import re

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select option datalist".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
BLOCKS = frozenset(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"button", "body", "html"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("ul ol dl table article section div body aside nav main footer header form blockquote td".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)?""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


class Node:
    """A block element, or a run of inline text (tag ``#``)."""

    __slots__ = ("tag", "parent", "children", "names", "text", "linked", "depth", "controls", "images", "inside")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list[Node] = []
        self.text, self.linked, self.controls, self.images = "", 0, 0, 0
        self.inside = ""
        self.depth = parent.depth + 1 if parent else 0


def _names(attributes: str) -> str:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            out.append("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                out.append("hidden")
        else:
            out.append(value)
    return " ".join(out)


def parse(page: str) -> Node:
    """The root of the page's block tree."""
    root = Node("body", None)
    stack: list[tuple[str, Node]] = [("body", root)]  # open elements, inline ones with the block they are in
    node, links = root, 0
    pieces: list[str] = []
    linked = 0
    inline: list[str] = []

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                run = Node("#", node)
                run.text, run.linked, run.inside = text, min(linked, len(text)), " ".join(inline)
                node.children.append(run)
            pieces, linked = [], 0

    def close(depth: int) -> None:
        nonlocal node, links
        for tag, _ in stack[depth:]:
            if tag == "a":
                links -= 1
        if any(tag in BLOCKS for tag, _ in stack[depth:]):
            flush()
        del stack[depth:]
        node = stack[-1][1]

    at, n, skip = 0, len(page), ""
    low = None
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not skip:
            raw = page[at:stop]
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        closing, opening = m[1], m[2]
        if closing:
            tag = closing.lower()
            if skip:
                if tag == skip:
                    skip = ""
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break  # an inline end tag does not leave its block
            if tag in BLOCKS:
                flush()
            continue
        if not opening:
            continue
        tag, attributes = opening.lower(), m[3] or ""
        if skip and (tag not in ("script", "style", "title") or attributes.rstrip().endswith("/")):
            continue
        if tag in SKIPPED:
            if tag in ("select", "textarea"):
                node.controls += 1
            if tag in RAW:
                if low is None:
                    low = page.lower()
                end = low.find("</" + tag, at) if len(low) == n else -1
                if end < 0:
                    found = re.compile("</" + tag, re.IGNORECASE).search(page, at)
                    end = found.start() if found else n
                at = page.find(">", end) + 1 or n
            elif not attributes.rstrip().endswith("/"):
                skip = tag
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                pieces.append(" ")
            elif tag == "input":
                node.controls += 1
            elif tag == "img":
                node.images += 1
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            shut = CLOSES.get(tag, set())
            if tag in CLOSES_P and any(t == "p" for t, _ in stack):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in ("td", "th", "button"):
                        break
            if shut:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in shut:
                        close(i)
                        break
                    if stack[i][0] in SCOPES and stack[i][0] not in shut:
                        break
            new = Node(tag, node, _names(attributes))
            if tag == "button":
                node.controls += 1
            node.children.append(new)
            stack.append((tag, new))
            node = new
        else:
            if tag == "a":
                links += 1
            names = _names(attributes)
            if names and not pieces:
                inline[:] = [names]
            stack.append((tag, node))
        if len(stack) > 400:  # absurd nesting: keep the text, forget the depth
            close(200)
    flush()
    return root
