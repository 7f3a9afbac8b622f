"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded along the tree.

Every block element and every run of inline text is a node.  Its features are its own and its subtree's sizes and densities (text, links,
punctuation, controls, list items), depth, place in the page, sibling statistics, its element kind, and the attribute tokens of itself and its
ancestors by meaning.  The trees are trained on ``TRAIN_PAGES`` generated pages whose layouts, element choices and names vary and whose
main text is known; no page of the input is used.

Decoding: a node is dropped (with all below it), kept (children may still be dropped) or open (children decide).  The states of least cost
over the whole tree are found bottom-up, so no node is kept below a dropped one, and a stray prediction gives way to its surroundings.

Defined results: a null or empty page, or one without main text, has the empty text; blocks come in page order; equal pages give equal texts.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import slices
from .boost import Boost
from .dom import Node, parse

TRAIN_PAGES = 1200
LONG_NODES = 60  # about so many nodes of a long page train
LONG_EVERY = 20  # for so many generated pages there is a long flat one
SEED = 20240501
CUT = 1.5  # the cost of dropping a part of what is kept
OPEN = 0.7  # the cost of leaving a node open

# Attribute tokens by meaning: fixed values.
TOKENS = {
    "content": "article articlebody content entry post story body text main copy prose page-content blog single maincontent".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pagination pager tabs submenu".split(),
    "footer": "footer foot copyright legal colophon bottom".split(),
    "header": "header masthead topbar logo branding site-header banner hero top".split(),
    "side": "sidebar aside widget related recommended rail recirc more teaser popular trending secondary complementary".split(),
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion adsense dfp adslot outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall disclaimer message toast notification".split(),
    "comment": "comment comments reply replies disqus respond discussion commentlist reader feedback responses".split(),
    "share": "share sharing social follow like tweet facebook buttons tools print".split(),
    "form": "form search login register field input contact".split(),
    "meta": "meta byline author date time tags tag category published caption credit".split(),
    "hidden": "hidden invisible sr-only visually-hidden screen-reader-text".split(),
}
_MEANING = {t: i for i, words in enumerate(TOKENS.values()) for t in words}
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")
KINDS = ("p", "h", "list", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "figure", "quote", "#")
_KIND = {t: i for i, ts in enumerate(("p", "h1 h2 h3 h4 h5 h6", "ul ol li dl dt dd menu dir", "div center", "section", "article", "main", "nav", "header hgroup", "footer", "aside", "form fieldset button legend", "table tbody thead tfoot tr td th caption", "figure figcaption", "blockquote pre address details summary", "#")) for t in ts.split()}
_MARKS = re.compile(r"[.!?,;:…]")
_N = len(TOKENS)


def meanings(names: str) -> list[int]:
    """Which meanings the tokens of a class, id or role have."""
    if not names:
        return []
    words = _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
    whole = names.lower().split()
    return sorted({_MEANING[w] for w in [*words, *whole] if w in _MEANING})


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """All nodes with text, parents first, and their features."""
    order: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(reversed(node.children))
    stats: dict[int, list[float]] = {}
    place = 0.0
    start: dict[int, float] = {}
    for node in order:
        start[id(node)] = place
        place += len(node.text)
    total = max(1.0, place)
    for node in reversed(order):  # text, linked, marks, nodes, runs, longest, paragraphs, headings, items, controls, images
        if node.tag == "#":
            s = [len(node.text), node.linked, len(_MARKS.findall(node.text)), 1, 1, len(node.text), 0, 0, 0, 0, 0]
        else:
            s = [0.0, 0, 0, 1, 0, 0, node.tag == "p", node.tag[0] == "h" and node.tag[1:].isdigit(), node.tag in ("li", "dd"), node.controls, node.images]
            for child in node.children:
                c = stats[id(child)]
                longest = max(s[5], c[5])
                s = [a + b for a, b in zip(s, c, strict=True)]
                s[5] = longest
        stats[id(node)] = s
    # Each parent's children are counted once: their places and how many there are of each element.
    spot: dict[int, int] = {}
    kin: dict[int, Counter[str]] = {}
    for node in order:
        kin[id(node)] = Counter(child.tag for child in node.children)
        for i, child in enumerate(node.children):
            spot[id(child)] = i
    rows, nodes = [], []
    above: dict[int, tuple[list[int], int]] = {}  # meanings of the ancestors and their element kinds
    log = math.log1p
    for node in order:
        s = stats[id(node)]
        parent = node.parent
        kind = _KIND.get(node.tag, 3)
        mine = meanings(node.names or node.inside)
        up, kinds = above[id(parent)] if parent is not None else ([0] * _N, 0)
        if node.tag != "#":
            below = up
            if mine:
                below = up[:]
                for m in mine:
                    below[m] += 1
            above[id(node)] = (below, kinds | 1 << kind)
        if not s[0]:
            continue
        length = s[0]
        siblings = parent.children if parent is not None else [node]
        i = spot[id(node)] if parent is not None else 0
        before = stats[id(siblings[i - 1])] if i else None
        after = stats[id(siblings[i + 1])] if i + 1 < len(siblings) else None
        ps = stats[id(parent)] if parent is not None else s
        same = kin[id(parent)][node.tag] if parent is not None else 1
        base = [
            log(length), s[1] / length, s[2] / length * 20, log(s[3]), length / s[3], log(length / s[4]), log(s[5]), log(s[6]), log(s[7]), log(s[8]), s[8] / s[3], log(s[9]), log(s[10]),
            node.depth, i / max(1, len(siblings)), log(len(siblings)), same / len(siblings), start[id(node)] / total, (start[id(node)] + length) / total, length / total, length / ps[0] if ps[0] else 1.0,
            log(before[0]) if before else -1, before[1] / before[0] if before and before[0] else -1, log(after[0]) if after else -1, after[1] / after[0] if after and after[0] else -1, ps[1] / ps[0] if ps[0] else 0, log(ps[0] / max(1, ps[4])), kind, _KIND.get(parent.tag, 3) if parent is not None else -1,
        ]
        upper = parent.parent if parent is not None else None
        if upper is None:
            base += [-1.0] * 7
        else:  # where the parent stands among its own siblings
            gs, among, j = stats[id(upper)], upper.children, spot[id(parent)]
            last, next_ = stats[id(among[j - 1])] if j else None, stats[id(among[j + 1])] if j + 1 < len(among) else None
            base += [log(gs[0]), gs[1] / gs[0], log(len(among)), kin[id(upper)][parent.tag] / len(among), j / len(among), log(last[0]) if last else -1, log(next_[0]) if next_ else -1]
        own = [0.0] * _N
        for m in mine:
            own[m] = 1.0
        flags = [float(kinds >> k & 1) for k in (2, 5, 6, 7, 8, 9, 10, 11, 12, 13)]
        rows.append(base + own + up + flags)
        nodes.append(node)
    return nodes, np.array(rows, np.float32).reshape(len(rows), -1)


def decode(nodes: list[Node], p: np.ndarray) -> list[str]:
    """The kept runs' texts, one per block; see the module's text."""
    p = np.clip(p, 1e-3, 1 - 1e-3)
    keep_cost, drop_cost = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    at = {id(n): i for i, n in enumerate(nodes)}
    kept, dropped, free = [0.0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes)
    children = [[at[id(c)] for c in n.children if id(c) in at] for n in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        below = children[i]
        weight = 1.0 + (0.5 * math.log1p(len(nodes[i].text)) / 3 if not below else 0.0)
        kept[i] = weight * keep_cost[i] + sum(min(kept[c], dropped[c] + CUT) for c in below)
        dropped[i] = weight * drop_cost[i] + sum(dropped[c] for c in below)
        free[i] = OPEN + sum(min(kept[c], dropped[c], free[c]) for c in below) if below else math.inf
    state = [""] * len(nodes)
    out: list[str] = []
    for i, node in enumerate(nodes):
        above = state[at[id(node.parent)]] if node.parent is not None and id(node.parent) in at else "open"
        if above == "drop":
            state[i] = "drop"
        elif above == "keep":
            state[i] = "keep" if kept[i] <= dropped[i] + CUT else "drop"
        else:
            best = min(kept[i], dropped[i], free[i])
            state[i] = "keep" if kept[i] == best else "drop" if dropped[i] == best else "open"
        if node.tag == "#" and state[i] == "keep":
            out.append(node.text)
    return out


class Generator:
    """Random pages with known main text, for training and for tests of held-out pages."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = "the an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
        self.vocabulary = ["".join(self.r.choices(parts, k=self.r.choice((1, 1, 2, 2, 3, 4)))) for _ in range(3000)]

    def words(self, low: int, high: int, stop: float = 0.1) -> str:
        """Some words as prose, or without marks where ``stop`` is 0."""
        out = []
        for w in self.r.choices(self.vocabulary, k=self.r.randint(low, high)):
            x = self.r.random()
            out.append(w + ("." if x < stop * 0.6 else "," if x < stop else ""))
        text = " ".join(out)
        return text[:1].upper() + text[1:] + ("." if stop and not text.endswith(".") else "")

    def names(self, *meaning: str) -> str:
        """Sometimes a class or id with a token of that meaning, sometimes a neutral one, sometimes none."""
        x = self.r.random()
        if x < 0.2:
            return ""
        neutral = self.r.choice(("box", "row", "col-8", "wrap", "container", "block", "module", "c12", "grid", "inner", "section-2"))
        token = self.r.choice(TOKENS[self.r.choice(meaning)]) if meaning and x < 0.85 else neutral
        token += self.r.choice(("", "", "", "-1", "-wrap", "-box", " " + neutral))
        return f' {self.r.choice(("class", "class", "class", "id"))}="{token}"'

    def told(self, meaning: str) -> str:
        """A class or id with a token of that meaning: of boilerplate that nothing else tells from main text."""
        token = self.r.choice(TOKENS[meaning]) + self.r.choice(("", "", "", "-1", "-wrap", "-box", " row", " c12"))
        return f' {self.r.choice(("class", "class", "class", "id"))}="{token}"'

    def neutral(self) -> str:
        """No name at all, or one that says nothing."""
        r = self.r
        if r.random() < 0.35:
            return ""
        name = r.choice(("box", "row", "col-8", "wrap", "container", "block", "module", "c", "grid", "inner", "section-", "x", "s", "css-", "layer", "pane", "d", "el-", "g"))
        return f' {r.choice(("class", "class", "id"))}="{name}{r.choice(("", r.randint(1, 99)))}"'

    def element(self, semantic: str, body: str, *meaning: str) -> str:
        """The semantic element, or a div that must be told by its name."""
        if self.r.random() < 0.5:
            return f"<{semantic}{self.names(*meaning) if self.r.random() < 0.5 else ''}>{body}</{semantic}>"
        return f"<div{self.names(*meaning) or ' class="' + self.r.choice(TOKENS[meaning[0]]) + '"'}>{body}</div>"

    def links(self, low: int, high: int) -> str:
        some = [f'<a href="/{i}">{self.words(1, 3, 0)}</a>' for i in range(self.r.randint(low, high))]
        style = self.r.random()
        return "<ul>" + "".join(f"<li>{a}</li>" for a in some) + "</ul>" if style < 0.7 else " | ".join(some) if style < 0.85 else "".join(f"<div>{a}</div>" for a in some)

    def junk(self, kind: str) -> str:
        """One piece of boilerplate."""
        r = self.r
        if kind == "menu":
            return self.element("nav", self.links(3, 9), "menu")
        if kind == "header":
            return self.element("header", r.choice((f"<a href='/'>{self.words(1, 3, 0)}</a>", f"<div class='logo'>{self.words(1, 2, 0)}</div>", f"<h2>{self.words(1, 4, 0)}</h2>")) + (self.links(2, 6) if r.random() < 0.6 else f"<p>{self.words(3, 9, 0)}</p>"), "header")
        if kind == "footer":
            return self.element("footer", r.choice(("&copy; ", "", "<p>", "<div>")) + self.words(3, 30) + (self.links(2, 7) if r.random() < 0.5 else ""), "footer")
        if kind == "side":
            return self.element("aside", f"<h3>{self.words(1, 4, 0)}</h3>" + (self.links(3, 8) if r.random() < 0.7 else "".join(f"<p>{self.words(5, 25)}</p>" for _ in range(r.randint(1, 3)))), "side")
        if kind == "advert":
            return f"<div{self.told('advert') if r.random() < 0.6 else ' class="ad"'}>{r.choice(('', '', '<p>', '<a href=/x>'))}{self.words(3, 25)}</div>"
        if kind == "notice":
            return f"<{r.choice(('div', 'section', 'aside'))}{self.told('notice')}><p>{self.words(5, 30)}</p>{r.choice(('<button>OK</button>', '', '<a href=/p>More</a>'))}</div>"
        if kind == "form":
            return self.element("form", f"<label>{self.words(1, 4, 0)}</label><input type=text name=q>" + r.choice(("<button>Go</button>", "<p>" + self.words(2, 12) + "</p>", "<textarea>x</textarea>")), "form", "notice")
        if kind == "share":
            return f"<div{self.names('share') or ' class=share'}>{self.links(2, 5)}</div>"
        one = r.choice(("<li class='comment'>{}</li>", "<div class='comment'>{}</div>", "<article class='comment'>{}</article>", "<div class='reply'>{}</div>", "<p>{}</p>"))
        said = "".join(one.format((f"<b>{self.words(1, 2, 0)}</b> " if r.random() < 0.5 else "") + (f"<p>{self.words(4, 60)}</p>" if r.random() < 0.6 else self.words(4, 60))) for _ in range(r.randint(1, 6)))
        title = f"<h{r.choice('234')}>{self.words(1, 3, 0)}</h3>" if r.random() < 0.6 else ""
        return f"<{(t := r.choice(('section', 'div', 'div')))}{self.told('comment')}>{title}{said}</{t}>"

    def page(self, long: bool = False) -> tuple[str, list[str]]:
        """A page and its main blocks; a long one has all of many blocks, and pieces of boilerplate between and after them, under one parent."""
        r = self.r
        main: list[str] = []

        def block(tag: str, text: str, shown: str | None = None, close: bool = True) -> str:
            main.append(" ".join(text.split()))
            return f"<{tag}>{shown or text}" + (f"</{tag.split()[0]}>" if close else "")

        unit = r.choice(("p", "p", "p", "p", "p", "p", "div", "div", "div", "section", "li", "td", "pre"))  # what the page's paragraphs are
        linked = r.choice((0.0, 0.1, 0.1, 0.5, 1.0))  # the share of paragraphs with links

        def one() -> str:
            text = self.words(*r.choice(((2, 8), (8, 20), (10, 40), (15, 60), (30, 120), (60, 200))[unit in ("li", "td") :]))
            words = text.split(" ")
            if r.random() < 0.2:
                k = r.randrange(len(words))
                words[k] = r.choice(("<b>{}</b>", "<em>{}</em>", "<b>{}", "{}<br>")).format(words[k])
            if len(words) > 8 and r.random() < linked:
                for k in r.sample(range(len(words)), min(len(words), r.choice((1, 1, 2, 3, 5)))):
                    words[k] = f"<a href='/{k}'>{words[k]}</a>"
            return block(unit, text, " ".join(words), unit != "p" or r.random() > 0.15)

        def paragraph() -> str:
            if unit == "li":
                return "<ul>" + "".join(one() for _ in range(r.choice((1, 2, 4)))) + "</ul>"
            if unit == "td":
                return "<table>" + "".join(f"<tr>{one()}</tr>" for _ in range(r.choice((1, 2, 4)))) + "</table>"
            return one()

        inner = [block("h1", self.words(1 if long or r.random() < 0.4 else 3, 5 if long else 12, r.choice((0, 0, 0.03))))] if r.random() < 0.9 else []
        plain = r.choice((0.78, 1, 1))  # some pages are nothing but paragraphs
        for _ in range(r.randint(50, 200) if long else r.choice((1, 1, 2, 2, 3, 3, 4, 5, 6, 9, 14, 25))):
            x = r.random() * plain
            if x < 0.78:
                inner.append(paragraph())
            elif x < 0.86:
                inner.append(block(r.choice(("h2", "h3")), self.words(2, 8, r.choice((0, 0, 0.02)))))
            elif x < 0.92:
                inner.append("<ul>" + "".join(block("li", self.words(2, 20), None, r.random() > 0.3) for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.95:
                inner.append("<blockquote>" + paragraph() + "</blockquote>")
            else:
                inner.append("<table><tr>" + "".join(block("td", self.words(1, 4, 0)) for _ in range(r.randint(2, 4))) + "</tr></table>")
            if r.random() < 0.1 and plain == 1:
                inner.append(self.junk(r.choice(("advert", "share", "side", "notice", "form"))))
        body = "".join(inner)
        if long and r.random() < 0.5:  # comments as siblings of the main blocks
            comment = r.choice(("<li class='comment'>{}</li>", "<div class='comment'>{}</div>", "<article class='comment'>{}</article>", "<div class='reply'>{}</div>"))
            body += "".join(comment.format(self.words(4, 60)) for _ in range(r.randint(5, 80)))
        elif r.random() < 0.15:
            body += self.junk("comment")
        x = r.random()
        if r.random() < 0.1:  # no container at all
            pass
        elif r.random() < 0.45:  # nothing but its content tells the container
            for _ in range(r.choice((1, 1, 2, 3))):
                body = f"<{(t := r.choice(('div', 'div', 'div', 'section', 'main')))}{self.neutral()}>{body}</{t}>"
        elif x < 0.55:
            body = f"<article{self.names('content') if r.random() < 0.4 else ''}>{body}</article>"
        elif x < 0.7:
            body = f"<main><div{self.names('content')}>{body}</div></main>"
        else:
            body = f"<div{self.names('content') or ' id=content'}>{body}</div>"
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            body = f"<div{self.names()}>{body}</div>"
        often = {"menu": 0.8, "advert": 0.35}
        lead = [self.junk(k) for k in ("header", "menu", "advert", "notice", "form", "side", "share") if r.random() < often.get(k, 0.3)]
        often = {"footer": 0.8, "advert": 0.35}
        tail = [self.junk(k) for k in ("comment", "side", "advert", "share", "form", "menu", "footer", "notice") if r.random() < often.get(k, 0.25)]
        if r.random() < 0.6:
            r.shuffle(lead)
        title = self.words(2, 8, 0)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{''.join(lead)}{body}{''.join(tail)}</body></html>"
        return page, main


@cache
def train(pages: int = TRAIN_PAGES, seed: int = SEED) -> bytes:
    """Once per session, a pickled model trained on generated pages and, for every ``LONG_EVERY`` of them, a long flat one more; the same for the same arguments."""
    make, flat, xs, ys = Generator(seed), Generator(seed + 1), [], []
    for i in range(pages + pages // LONG_EVERY):
        page, main = make.page() if i < pages else flat.page(long=True)
        nodes, x = features(parse(page))
        known = set(main)
        share: dict[int, list[float]] = {}
        for node in nodes:
            if node.tag == "#":
                good, up = len(node.text) * (node.text in known), node
                while up is not None:
                    s = share.setdefault(id(up), [0.0, 0.0])
                    s[0], s[1], up = s[0] + good, s[1] + len(node.text), up.parent
        step = max(1, len(nodes) // LONG_NODES) if i >= pages else 1  # many nodes of few pages: a long page weighs like another
        xs.append(x[::step])
        ys.append([float(share[id(n)][0] > 0.5 * share[id(n)][1]) for n in nodes[::step]])
    return pickle.dumps(Boost().fit(np.concatenate(xs), np.concatenate(ys)))


def extract(pages: list[str | None], model: Boost) -> list[str]:
    """The main text of each page, blocks joined by an empty line."""
    every = [features(parse(p)) if p else ([], np.zeros((0, 0), np.float32)) for p in pages]
    full = [x for _, x in every if len(x)]
    p = model.predict(np.concatenate(full)) if full else np.zeros(0)
    out, at = [], 0
    for nodes, x in every:
        out.append("\n\n".join(decode(nodes, p[at : at + len(x)])) if len(x) else "")
        at += len(x)
    return out


def text_columns(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: bytes | None = None) -> DataFrame:
    """The columns in ``keep`` with ``text`` and ``n_chars`` (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in slices(batches):
            found = extract(batch.column(batch.num_columns - 1).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)
