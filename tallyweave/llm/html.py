"""Main text of web pages: gradient-boosted trees over DOM nodes and a hierarchical decoding.

Each page becomes a tree of elements, with its runs of text as leaves. A node is described by its place
(depth, order, siblings), its subtree (length and density of text, links), its tag, the attribute tokens of
itself and of its ancestors, and its siblings' statistics. Boosted regression trees give the probability that
a node holds main text. The decoding then finds, by dynamic programming over the tree, the most probable
labelling in which no node below a dropped one is kept. The trees are fitted here, once a session, on
``PAGES`` pages that a seeded generator makes in many layouts, so their parts are known; nothing is learned
from the pages extracted.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import map_arrow

# --- the tree ---------------------------------------------------------------------------------------------

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
SKIP = set("script style noscript template iframe svg math head title textarea select button option object canvas video audio".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt td th tr tbody thead tfoot".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_MARK = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Tags of a page whose quotes never close; after that many, tags end at the next ``>``, quoted or not.
UNCLOSED = 50
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|itemprop)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "up", "kids", "text", "hidden")

    def __init__(self, tag: str, up: Node | None, words: frozenset = frozenset(), text: str = "", hidden: bool = False):
        self.tag, self.up, self.words, self.text, self.hidden, self.kids = tag, up, words, text, hidden, []
        if up is not None:
            up.kids.append(self)


def _attributes(source: str) -> tuple[frozenset, bool]:
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(source):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            hidden = hidden or bool(_HIDDEN.search(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name != "aria-hidden":
            words.update(w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", entities.unescape(value)).lower()) if w)
    return frozenset(words), hidden


class _Tags:
    """The tags of a page in order, as (begin, end, closing, name, attributes); comments and declarations have no name.

    Reads a page once: a tag ends at the first ``>`` outside quotes or, if its quotes never close, at the first
    ``>``; without any the rest of the page is text.
    """

    def __init__(self, source: str):
        self.source, self.last, self.unclosed = source, source.rfind(">"), 0

    def next(self, place: int) -> tuple[int, int, bool, str, str] | None:
        source = self.source
        while (found := _MARK.search(source, place)) is not None:
            at, after = found.span()
            if found[1]:
                end = source.find("-->", after)
                return at, end + 3 if end >= 0 else len(source), False, "", ""
            if found[2]:
                end = source.find(">", after)
                return at, end + 1 if end >= 0 else len(source), False, "", ""
            if after > self.last:
                return None
            rest = _REST.match(source, after) if self.unclosed < UNCLOSED else None
            if rest is None:
                self.unclosed += 1
                end = source.find(">", after)
                return at, end + 1, bool(found[3]), found[4].lower(), source[after:end]
            return at, rest.end(), bool(found[3]), found[4].lower(), rest[1]
        return None


def parse(source: str) -> Node:
    """The tree of a page; text runs are nodes of tag ``#text``, split where a block element begins or ends.

    Inline elements leave no node but ``a`` runs: their text joins the run around it, marked as linked; the text
    of hidden ones is left out. Unclosed and misnested tags are closed as browsers do in the common cases; nothing
    makes it fail, and time grows with the length of the page.
    """
    root = Node("#root", None)
    at, links, run, linked, place, size = root, 0, [], 0, 0, len(source)
    open_: dict[str, int] = {}  # open elements by tag
    mute: list | None = None  # a hidden inline element: its tag, how many of it are open, and where
    tags, ends = _Tags(source), {}

    def flush() -> None:
        nonlocal run, linked
        text = _WHITE.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            leaf = Node("#text", at, text=text)
            leaf.words = frozenset((min(1.0, linked / max(1, sum(map(len, run)))),))
        run, linked = [], 0

    def close(node: Node) -> None:
        nonlocal at, mute
        flush()
        while at is not node:
            if mute and mute[2] is at:
                mute = None
            open_[at.tag] -= 1
            at = at.up
        if mute and mute[2] is at:
            mute = None
        open_[at.tag] -= 1
        at = node.up or root

    while place < size:
        found = tags.next(place)
        piece = source[place : found[0]] if found else source[place:]
        if piece and not mute:
            run.append(piece)
            linked += len(piece) * (links > 0)
        if not found:
            break
        _, place, closing, tag, rest = found
        if not tag:
            continue
        if tag in INLINE:
            if mute:
                if tag == mute[0]:
                    mute[1] += -1 if closing else 1
                    if not mute[1]:
                        mute = None
                continue
            if not closing and tag not in VOID and rest and _attributes(rest)[1]:
                mute = [tag, 1, at]
            elif tag == "a":
                links = 0 if closing else 1
            elif tag == "br" or tag == "img":
                run.append(" ")
            continue
        if closing:
            if open_.get(tag):
                node = at
                while node.tag != tag:
                    node = node.up
                close(node)
                links = 0
            continue
        flush()
        if tag in CLOSES_P and open_.get("p"):
            node = at
            while node is not root and node.tag not in ("p", "td", "th", "li", "button", "table", "div", "article", "section", "body"):
                node = node.up
            if node.tag == "p":
                close(node)
                links = 0
        if tag in SAME and any(open_.get(t) for t in SAME[tag]):
            node = at
            while node is not root and node.tag not in SAME[tag] and node.tag not in HOLDS[tag]:
                node = node.up
            if node.tag in SAME[tag]:
                close(node)
                if tag == "tr" and node.tag != "tr" and at.tag == "tr":
                    close(at)
                links = 0
        if tag in ("html", "body") and open_.get(tag):
            continue
        if tag == "body" and open_.get("head"):
            node = at
            while node.tag != "head":
                node = node.up
            close(node)
        words, hidden = _attributes(rest)
        node = Node(tag, at, words, hidden=hidden or bool(mute))
        if tag in VOID or rest.rstrip().endswith("/") and tag in ("svg", "math", "iframe"):
            continue
        if tag in RAW:
            if ends.get(tag, place) >= 0:
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, place)
                ends[tag] = -1 if end is None else 0
                place = end.end() if end else size
            else:
                place = size
            continue
        open_[tag] = open_.get(tag, 0) + 1
        at = node
    flush()
    return root


def _chain(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.up


# --- features ---------------------------------------------------------------------------------------------

# Attribute tokens by what they tell.
TOKENS = {
    "advert": "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promoted promotion doubleclick taboola outbrain",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar topbar tabs skip links toc",
    "side": "sidebar side aside rail widget widgets related recommended recommendations recirc more popular trending latest teaser",
    "frame": "header masthead head footer foot bottom top copyright colophon legal branding logo site",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert disclaimer newsletter subscribe subscription signup paywall",
    "share": "share sharing social follow like likes tweet facebook twitter print tags tag meta byline author",
    "reader": "comment comments reply replies respond disqus discussion thread commentlist feedback",
    "form": "form login search register input field",
    "main": "article content main post entry body story text page prose maincontent articlebody markdown blog single",
}
_GROUP = {w: g for g, ws in TOKENS.items() for w in ws.split()}
GROUPS = list(TOKENS)
TAGS = {
    "text": "#text", "p": "p", "heading": "h1 h2 h3 h4 h5 h6", "top": "h1", "item": "li dt dd", "list": "ul ol dl menu", "box": "div section center", "article": "article main",
    "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset", "table": "table tbody tr td th thead tfoot", "quote": "blockquote pre figure figcaption",
    "whole": "#root html body",
}
_TAG = {t: [k for k, ts in TAGS.items() if t in ts.split()] for t in {t for ts in TAGS.values() for t in ts.split()}}
ABOVE = ["nav", "header", "footer", "aside", "form", "article"]
NAMES = (
    [f"tag_{t}" for t in TAGS] + [f"own_{g}" for g in GROUPS] + [f"above_{g}" for g in GROUPS] + [f"in_{t}" for t in ABOVE]
    + ["depth", "order", "place", "siblings", "chars", "share", "density", "linked", "words", "ends", "symbols", "hidden", "like_siblings", "sibling_chars", "sibling_linked", "before", "after", "kids"]
)
_COLUMN = {n: i for i, n in enumerate(NAMES)}


_TAG_BITS = {t: sum(1 << list(TAGS).index(k) for k in ks) for t, ks in _TAG.items()}
_GROUP_BIT = {w: 1 << GROUPS.index(g) for w, g in _GROUP.items()}
_ABOVE_BIT = {t: 1 << ABOVE.index(k) for k in ABOVE for t in TAGS[k].split()}
_BITS = len(TAGS), len(GROUPS), len(GROUPS), len(ABOVE)
_LOGS = [_COLUMN[c] for c in ("siblings", "chars", "words", "sibling_chars", "kids")]


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """The nodes in page order (parents before children) and a row of features each."""
    nodes: list[Node] = []
    up: list[int] = []
    stack = [(root, -1)]
    while stack:
        node, above = stack.pop()
        if node.tag in SKIP or node.hidden and node.tag not in ("html", "body"):
            continue
        stack.extend((k, len(nodes)) for k in reversed(node.kids))
        nodes.append(node)
        up.append(above)
    n = len(nodes)
    chars, linked, tags, count, ends, symbols, kids, first = ([0.0] * n for _ in range(8))
    tag, own, over, inside, depth = ([0] * n for _ in range(5))
    group: dict[int, list[int]] = {}
    seen = 0.0
    for i, x in enumerate(nodes):
        p, t = up[i], x.tag
        group.setdefault(p, []).append(i)
        tag[i], first[i] = _TAG_BITS.get(t, 0), seen
        if p >= 0:
            over[i], inside[i], depth[i] = over[p] | own[p], inside[p] | _ABOVE_BIT.get(nodes[p].tag, 0), depth[p] + 1
        if t == "#text":
            s = x.text
            k = chars[i] = len(s)
            seen += k
            linked[i], count[i] = k * next(iter(x.words), 0.0), s.count(" ") + 1
            ends[i] = s.count(".") + s.count("!") + s.count("?") + s.count(",")
            symbols[i] = s.count("|") + s.count("»") + s.count("›") + s.count("©") + s.count("•") + s.count("·") + s.count("/")
        else:
            tags[i] = 1
            for w in x.words:
                own[i] |= _GROUP_BIT.get(w, 0)
    for i in range(n - 1, 0, -1):
        p = up[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        tags[p] += tags[i]
        count[p] += count[i]
        ends[p] += ends[i]
        symbols[p] += symbols[i]
        kids[p] += 1
    total = max(1.0, chars[0])
    numbers: list = [None] * n
    for members in group.values():
        k, same = len(members), {}
        for i in members:
            same[nodes[i].tag] = same.get(nodes[i].tag, 0) + 1
        s_chars = sum(chars[i] for i in members)
        s_linked = sum(linked[i] for i in members) / max(1.0, s_chars)
        for j, i in enumerate(members):
            c, w, x = chars[i], max(1, count[i]), nodes[i]
            numbers[i] = (
                depth[i], i / n, j / max(1, k - 1), k, c, c / total, c / (tags[i] + 1), linked[i] / max(1, c), count[i], ends[i] / w, symbols[i] / w, x.hidden,
                same[x.tag] / k, s_chars / k, s_linked, first[i] / total, 1 - (first[i] + c) / total, kids[i],
            )
    flags = [(np.array(v)[:, None] >> np.arange(k)) & 1 for v, k in zip((tag, own, over, inside), _BITS)]
    out = np.concatenate([*flags, np.array(numbers, float)], 1)
    out[:, _LOGS] = np.log1p(out[:, _LOGS])
    return nodes, out


# --- boosted trees ----------------------------------------------------------------------------------------


class BoostedTrees:
    """Gradient boosting of binned regression trees for a logistic loss; a tree of depth D has 2^D leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 2.0):
        self.depth, self.rate = depth, rate
        self.cuts = [np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) for v in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        score, self.trees = np.full(len(y), self.start), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
            for level in range(depth):
                first, n = (1 << level) - 1, 1 << level
                gain, which, where = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1)
                for f in range(x.shape[1]):
                    k = len(self.cuts[f]) + 1
                    if k < 2:
                        continue
                    cell = at * k + binned[:, f]
                    gs, hs = (np.bincount(cell, v, n * k).reshape(n, k).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    got = (gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge))[:, :-1]
                    best = got.argmax(1)
                    better = got[np.arange(n), best] > gain + 1e-9
                    gain[better], which[better], where[better] = got[np.arange(n), best][better], f, best[better]
                for j in range(n):
                    if where[j] >= 0:
                        feature[first + j], cut[first + j] = which[j], self.cuts[which[j]][where[j]]
                node = first + at
                at = 2 * at + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = rate * np.bincount(at, g, 1 << depth) / (np.bincount(at, h, 1 << depth) + ridge)
            score = score + leaf[at]
            self.trees.append((feature, cut, leaf))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows."""
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[row, feature[node]] > cut[node])
            out += leaf[at]
        return out


# --- decoding ---------------------------------------------------------------------------------------------


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The most probable labels in which only nodes below kept ones are kept; ``odds`` are log odds of keeping."""
    number = {id(x): i for i, x in enumerate(nodes)}
    up = [number.get(id(x.up), -1) for x in nodes]
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    kept, dropped = keep.tolist(), drop.tolist()  # best of the subtree with the node kept; with all of it dropped
    for i in range(len(nodes) - 1, 0, -1):
        dropped[up[i]] += dropped[i]
        kept[up[i]] += max(kept[i], dropped[i])
    out = [kept[0] > dropped[0]] + [False] * (len(nodes) - 1)
    for i in range(1, len(nodes)):
        out[i] = out[up[i]] and kept[i] > dropped[i]
    return out


def main_texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """Main texts of pages; the nodes of all are scored at once."""
    made = [features(parse(x or "")) for x in sources]
    if not made:
        return []
    odds = np.split(model.score(np.concatenate([x for _, x in made])), np.cumsum([len(n) for n, _ in made])[:-1])
    out = []
    for (nodes, _), own in zip(made, odds):
        labels = decode(nodes, own)
        out.append("\n\n".join(node.text for node, good in zip(nodes, labels) if good and node.tag == "#text"))
    return out


# --- training pages ---------------------------------------------------------------------------------------

PAGES, SEED = 500, 11
#: Pages whose nodes are scored together.
TOGETHER = 128
_MAIN = "\ue000"  # begins each main text of a training page; taken out before features are made
_SYLLABLES = "an be co da el fi go hu in jo ka le mi no or pa qui ra se ti un ve wo ya zu th er ing tion est ou eau ch ge ver é ñ ü ß the of de la und".split()
_PLAIN = "wrap wrapper container row col inner outer box block c1 c2 grid layout panel unit left right section group holder x1 view area".split()


class _Maker:
    """A page in a random layout, as HTML, its main texts marked."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def text(self, least: int, most: int, main: bool = False) -> str:
        n = int(math.exp(self.r.uniform(math.log(least), math.log(most + 1))))
        words, style = [], self.r.random()
        for i in range(max(1, n)):
            w = self.word()
            if style < 0.04:
                w = w.upper() + "!!"
            elif style < 0.1:
                w += self.r.choice(("&amp;&amp;", "%%%", "***", "$$$", " |"))
            elif self.r.random() < 0.12 or i == n - 1:
                w += self.r.choice(".,.")
            words.append(w.capitalize() if i == 0 else w)
        return (_MAIN if main else "") + " ".join(words)

    def name(self, group: str | None) -> str:
        """Attributes for an element; of a group of tokens, or plain."""
        if group is None:
            return self.r.choice(("", "", f' class="{self.r.choice(_PLAIN)}"', f' class="{self.r.choice(_PLAIN)} {self.r.choice(_PLAIN)}"', f' id="{self.r.choice(_PLAIN)}-{self.r.randrange(99)}"'))
        token = self.r.choice(TOKENS[group].split())
        token = self.r.choice((token, token, f"{self.r.choice(_PLAIN)}-{token}", f"{token}-{self.r.choice(_PLAIN)}", f"{token}_{self.r.randrange(9)}"))
        return f' {self.r.choice(("class", "class", "id"))}="{token}"'

    def el(self, tag: str, inside: str, group: str | None = None, plain: bool = False) -> str:
        return f"<{tag}{'' if plain else self.name(group)}>{inside}</{tag}>"

    def links(self, least: int, most: int) -> str:
        items = [f'<a href="/{self.word()}">{self.text(1, 4)}</a>' for _ in range(self.r.randint(least, most))]
        way = self.r.random()
        if way < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(items) if way < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def maybe(self, p: float, make) -> str:  # noqa: ANN001
        return make() if self.r.random() < p else ""

    def advert(self) -> str:
        inside = self.r.choice((self.text(3, 30), f"<p>{self.text(3, 30)}</p>", f'<a href="/x">{self.text(2, 12)}</a>', f"<span>{self.text(1, 3)}</span> {self.text(3, 20)}"))
        return self.el(self.r.choice(("div", "div", "aside", "section")), inside, "advert")

    def notice(self) -> str:
        return self.el(self.r.choice(("div", "section", "aside")), self.r.choice((self.text(6, 40), f"<p>{self.text(6, 40)}</p><button>{self.text(1, 2)}</button>")), "notice")

    def form(self) -> str:
        inside = f"<label>{self.text(1, 4)}</label><input type=text>" + self.maybe(0.5, lambda: f"<p>{self.text(4, 20)}</p>") + f"<button>{self.text(1, 2)}</button>"
        return self.el("form", inside, self.r.choice(("form", "notice", None)))

    def menu(self) -> str:
        return self.el("nav", self.links(2, 9), self.r.choice((None, "menu"))) if self.r.random() < 0.7 else self.el(self.r.choice(("div", "ul")), self.links(2, 9), "menu")

    def side(self) -> str:
        inside = "".join(self.r.choice((lambda: f"<h3>{self.text(1, 4)}</h3>" + self.links(2, 7), lambda: f"<p>{self.text(4, 40)}</p>", self.advert, self.form))() for _ in range(self.r.randint(1, 4)))
        return self.el("aside", inside, self.r.choice((None, "side"))) if self.r.random() < 0.6 else self.el(self.r.choice(("div", "section")), inside, "side")

    def reader(self) -> str:
        one = lambda: self.el(self.r.choice(("div", "li", "article")), f"<b>{self.word()}</b>" + "".join(f"<p>{self.text(3, 60)}</p>" for _ in range(self.r.randint(1, 2))), self.r.choice(("reader", None)))
        inside = f"<h3>{self.text(1, 3)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 6))) + self.maybe(0.4, self.form)
        return self.el(self.r.choice(("section", "div", "div", "ol")), inside, "reader")

    def extra(self) -> str:
        return self.r.choice(
            (
                lambda: self.el("div", self.links(2, 5), "share"),
                lambda: self.el("div", f"<h3>{self.text(1, 3)}</h3>" + self.links(2, 6), "side"),
                self.advert,
                self.form,
                self.notice,
            )
        )()

    def body(self) -> str:
        """The article's own blocks."""
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<h1>{self.text(1, 14, True)}</h1>"
            by = self.el(r.choice(("div", "p", "span")), self.text(2, 8), "share")
            out.append(r.choice((title, title, title, title + by, f"<header>{title}</header>")))
        for i in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            p = self.text(1, r.choice((6, 40, 150)), True)
            out.append(
                r.choice(
                    (
                        lambda: f"<p>{p}</p>",
                        lambda: f"<p>{p}</p>",
                        lambda: f"<p>{p}</p>",
                        lambda: f"<p><b>{p}<br>",
                        lambda: f"<p>{p}",
                        lambda: f"<h2>{self.text(1, 8, True)}</h2><p>{p} <a href=/y>{self.text(1, 3)}</a> {self.text(1, 9)}</p>",
                        lambda: "<ul>" + "".join(f"<li>{self.text(1, 20, True)}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
                        lambda: f"<blockquote>{r.choice((p, f'<p>{p}</p>'))}</blockquote>",
                        lambda: self.el("div", p, None),
                        lambda: "<table>" + "".join(f"<tr><td>{self.text(1, 4, True)}</td><td>{self.text(1, 4, True)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>",
                        lambda: f"<pre>{p}</pre>",
                    )
                )()
            )
            if r.random() < 0.08:
                out.append(self.extra())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        inside = self.body()
        way = r.random()
        if way < 0.6:
            whole = self.el("article", inside, r.choice((None, None, "main")))
        elif way < 0.9:
            whole = self.el(r.choice(("div", "section", "main")), inside, "main")
        else:
            whole = self.el("main", inside, None)
        tail = self.maybe(0.25, self.reader)
        whole = whole[: whole.rfind("</")] + tail + whole[whole.rfind("</") :] if r.random() < 0.3 else whole + tail
        whole += "".join(self.maybe(0.12, self.extra) for _ in range(2))
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            whole = self.el(r.choice(("div", "div", "main", "section")), whole, r.choice((None, None, "main")))
        side = self.maybe(0.3, self.side)
        whole = side + whole if r.random() < 0.4 else whole + side
        if r.random() < 0.3:
            whole = self.el("div", whole, None)
        top = [self.maybe(0.15, self.notice), self.maybe(0.6, self.menu), self.maybe(0.35, self.advert), self.maybe(0.1, self.form)]
        head = self.el("header", r.choice((self.text(1, 5), f"<h1>{self.text(1, 4)}</h1>", f'<a href="/">{self.text(1, 3)}</a>')) + self.maybe(0.6, self.menu), r.choice((None, "frame")))
        top.append(self.maybe(0.4, lambda: head if r.random() < 0.7 else self.el("div", self.text(1, 6), "frame")))
        r.shuffle(top)
        foot = r.choice((self.text(2, 14), f"<p>&copy; {self.text(1, 14)}</p>", self.links(2, 6), self.links(2, 5) + f"<p>{self.text(2, 20)}</p>"))
        foot = self.maybe(0.85, lambda: self.el("footer", foot, r.choice((None, "frame"))) if r.random() < 0.7 else self.el("div", foot, "frame"))
        ending = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>t</title><script>1</script></head><body{self.name(None)}>{''.join(top)}<!-- x -->{whole}{self.maybe(0.2, self.advert)}{foot}{self.maybe(0.1, self.notice)}{ending}"


def labelled(seed: int) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """Nodes, features and labels (main text in the subtree) of a training page."""
    root = parse(_Maker(seed).page())
    marked, stack = set(), [root]
    while stack:
        node = stack.pop()
        if _MAIN in node.text:
            node.text = node.text.replace(_MAIN, "")
            marked.update(id(x) for x in _chain(node))
        stack.extend(node.kids)
    nodes, x = features(root)
    return nodes, x, np.array([id(n) in marked for n in nodes], float)


@cache
def fitted(pages: int = PAGES, seed: int = SEED) -> BoostedTrees:
    """The trees, fitted on ``pages`` generated pages."""
    made = [labelled(seed * 1_000_003 + i) for i in range(pages)]
    return BoostedTrees(np.concatenate([x for _, x, _ in made]), np.concatenate([y for _, _, y in made]))


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page: the ``keep`` columns, text and n_chars (code points), a row for each row.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
    by two newlines in page order; a page without main text, null or empty, gives the empty text. Whole pages of
    any length; malformed markup never fails. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fitted())
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sources, texts = batch.column(len(keep)), []
            for at in range(0, len(sources), TOGETHER):
                texts += main_texts(sources[at : at + TOGETHER].to_pylist(), model)
            made = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keep, "text", "n_chars"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "text string, n_chars long"
    return map_arrow(pages.select(*keep, F.col(html_col)), run, schema)
