"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the hierarchy.

A page is parsed into a tree (implied ends, void elements, raw text of scripts and styles, unclosed
tags, stray quotes and a cut-off end are handled; the root stands for an implied body). Every element that
makes a block, or names itself, gets features of its subtree density (text, link text, tags, sentence signs),
its place relative to the densest container of prose, its attribute tokens and its ancestors' (hashed, and
by what they say), its depth and its place and likeness among its siblings. Gradient-boosted trees give the
probability that the element belongs to the article. Inline mark-up without names goes with what it stands in.

Decoding gives each element one of three states, outside, article, removed, that can only move forward from
an ancestor to a descendant; the assignment with the highest total log probability is found by one pass up
and one down, so a removed menu can't hold a kept paragraph and an article's paragraph can't stand in a
removed block. Elements that are no article by their kind (menus, forms, footers, labels, hidden ones, page
headers, ...) force removal on everything below them, and an item of a list is article only if the list is. If nothing is kept though blocks of prose stand outside such
elements, the article's score is raised by doubling steps until something is.

The trees are trained on pages made from a rule (`html_pages`), families of layouts with names, nesting
and mark-up drawn at random. Training is a fixed cost; pages are read whole.

Defined results: null or empty html, and pages without prose outside of removed elements, give an empty
text; a page without any tag keeps its plain text as one block; a quote opens a value right after `=` only,
elsewhere it is an ordinary sign; a value that is not closed takes the rest of the page; very long and very
deep pages are read whole, without recursion; repeated rows and ties (the state further out) give equal results;
extra columns are ignored; an empty table gives an empty table; a null page_id stays null.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table
from .html_pages import ROOT, labelled_pages

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style noscript template form nav footer aside button select textarea iframe svg object math input option label dialog menu title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html dd dt li td th tr tbody thead tfoot".split())
#: an element that ends open ones of these kinds, up to one of the limits
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])))*+)(>|\Z)""", re.S)
ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*[^\s>]*))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: what an attribute says of an element that is no article
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar tooltip".split())
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    attrs: str = ""
    #: text pieces and the numbers of child elements, in order
    parts: list = field(default_factory=list)
    #: no article by its kind, nor anything in it
    never: bool = False
    #: inline mark-up that goes with what it stands in
    inline: bool = False


@functools.lru_cache(maxsize=20_000)
def _values(attrs: str) -> tuple[tuple[str, str], ...]:
    """Names and values of class, id, role and the like."""
    return tuple((m[1].lower(), m[2].strip("\"'").lower()) for m in ATTR.finditer(attrs) if m[2] and m[1].lower() in ("class", "id", "role", "itemprop", "aria-label"))


def kinds(nodes: list[Node]) -> None:
    """Marks elements that are never article, and inline ones without names."""
    in_article = [False] * len(nodes)
    for i, node in enumerate(nodes):
        if not i:
            continue
        up = nodes[node.parent]
        in_article[i] = in_article[node.parent] or node.tag in ("article", "main")
        named = _values(node.attrs) if node.attrs else ()
        kind = node.tag in NEVER or node.tag == "header" and not in_article[i]
        node.never = up.never or kind or any(k == "role" and v in ROLES for k, v in named) or bool(node.attrs and HIDDEN.search(node.attrs))
        node.inline = node.tag in INLINE and (not named or up.inline)


def parse(page: str) -> list[Node]:
    """Elements in page order; number 0 is the root. Text inside raw elements is dropped."""
    nodes = [Node("body", -1, 0)]
    stack = [0]
    at, n = 0, len(page)

    def close(kinds, limits) -> None:
        for i in range(len(stack) - 1, 0, -1):
            t = nodes[stack[i]].tag
            if t in kinds:
                # formatting left open inside goes with it
                del stack[i:]
                return
            if t in limits:
                return

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            nodes[stack[-1]].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        if not m[4]:  # cut off inside a tag
            break
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not any(nodes[i].tag == "p" for i in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                t = nodes[stack[i]].tag
                if t == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and t in BLOCK:  # an inline end does not end blocks
                    break
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if rule := ENDS.get(tag):
            close(*rule)
        number = len(nodes)
        node = Node(tag, stack[-1], len(stack), m[3])
        nodes.append(node)
        nodes[stack[-1]].parts.append(number)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            stack.append(number)
            continue
        stack.append(number)
    else:
        if at < n:
            rest = page[at:]
            cut = re.search(r"</?[a-zA-Z!][^<]*\Z|<\Z|</\Z", rest)
            nodes[stack[-1]].parts.append(rest[: cut.start()] if cut else rest)
    kinds(nodes)
    return nodes


# ---- features

SAYS = {
    "good": frozenset("article content post story entry body main text prose blog news page maincontent markdown".split()),
    "menu": frozenset("nav menu navbar navigation breadcrumb breadcrumbs tabs toc pagination pager links sitemap topnav".split()),
    "edge": frozenset("header footer masthead banner foot head top bottom copyright legal branding colophon".split()),
    "side": frozenset("sidebar side aside widget rail related recommended popular trending more secondary".split()),
    "ad": frozenset("ad ads advert advertisement sponsor sponsored promo promoted adsense dfp outbrain taboola".split()),
    "talk": frozenset("comment comments commentlist discussion disqus reply replies respond response responses reader talkback".split()),
    "ask": frozenset("form subscribe newsletter signup login search share social poll cookie consent notice alert modal popup gdpr announcement".split()),
}
GROUPS = {t: i for i, ts in enumerate(("", "p", "h1", "h2 h3 h4 h5 h6", "li", "ul ol", "td th", "tr tbody thead tfoot", "table", "pre code", "blockquote", "dl dt dd", "figure figcaption", "div", "section", "article main", "body html", "header", "center font details summary address")) for t in ts.split()}
BUCKETS = 8
NAMES = (
    "group", "depth", "chars", "own", "words", "links", "link_share", "tags", "density", "stops", "commas", "paragraphs", "place", "siblings", "same_siblings", "sib_share", "page_share", "before",
    "prose", "prose_share", "direct", "direct_share", "best", "to_best", "sib_prose", "next_prose", "prev_prose", "up_direct", "prose_before", "has_article", "in_article", "holds_article", "headings", "before_h1",
    *(f"own_{k}" for k in SAYS), *(f"up_{k}" for k in SAYS), *(f"hash{i}" for i in range(BUCKETS)),
)
MAIN = ("article", "main")
#: signs that end sentences and that part them, in several scripts
STOPS, COMMAS = ".!?。！？…।؟", ",，、،"
ENDS_SENTENCE = re.compile(f"[{STOPS}]")


def _count(text: str, signs: str) -> int:
    return sum(map(text.count, signs[:3] if text.isascii() else signs))


def _is_prose(size: int, stops: int, words: int, linked: int) -> bool:
    """Whether a block's own text reads as prose: a sentence sign or some words, and mostly no link."""
    return size >= 15 and (stops > 0 or words >= 6) and 2 * linked < size


@functools.lru_cache(maxsize=20_000)
def _said(attrs: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """What class, id and role tokens say, by kind; and their hash buckets."""
    words = [w for _, v in _values(attrs) for w in TOKEN.findall(v)]
    bits = [0] * BUCKETS
    for w in words:
        bits[sum(ord(c) * (i + 7) for i, c in enumerate(w)) % BUCKETS] += 1
    return tuple(sum(w in kind for w in words) for kind in SAYS.values()), tuple(bits)


def node_features(nodes: list[Node]) -> np.ndarray:
    """A row for each element; inline mark-up without names counts in what it stands in, its own rows are not used."""
    n = len(nodes)
    own, own_links, own_stops, own_words, own_bytes = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    chars, words, links, link_chars, tags, stops, commas, paras, heads = ([0] * n for _ in range(9))
    owner, linked = list(range(n)), [False] * n
    for i, node in enumerate(nodes):
        if i:
            linked[i] = linked[node.parent] or node.tag == "a"
            if node.inline:
                owner[i] = owner[node.parent]
        if node.tag in RAW:
            continue
        o = owner[i]
        for p in node.parts:
            if p.__class__ is str:
                t = p.strip()
                if not t:
                    continue
                s, dots, gaps = len(t), _count(t, STOPS), t.count(" ") + 1
                size = s if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
                own[o] += s
                own_bytes[o] += size
                own_stops[o] += dots
                own_words[o] += gaps
                chars[i] += s
                words[i] += gaps
                stops[i] += dots
                commas[i] += _count(t, COMMAS)
                if linked[i]:
                    own_links[o] += size
                    link_chars[i] += s
        links[i] = node.tag == "a"
        paras[i] = node.tag == "p"
        heads[i] = node.tag in ("h1", "h2", "h3")
    # prose: own text of such blocks outside of what is never article
    prose = [own[i] if not nodes[i].never and _is_prose(own_bytes[i], own_stops[i], own_words[i], own_links[i]) else 0 for i in range(n)]
    direct = prose[:]  # of an element and of its children that are paragraphs or the like
    below = prose[:]
    articles = [node.tag in MAIN and not node.never for node in nodes]
    holds = [0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        words[p] += words[i]
        links[p] += links[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        stops[p] += stops[i]
        commas[p] += commas[i]
        paras[p] += paras[i]
        heads[p] += heads[i]
        below[p] += below[i]
        holds[p] += holds[i] + articles[i]
        direct[p] += prose[i]
    order = sorted(range(n), key=lambda i: (-direct[i], i))
    best = order[0] if n and direct[order[0]] else -1
    relation = [0] * n  # to the container with the most direct prose: 1 above, 2 itself, 3 inside, 4 beside
    if best >= 0:
        relation[best], j = 2, best
        while j:
            j = nodes[j].parent
            relation[j] = 1
        for i in range(best + 1, n):
            if relation[nodes[i].parent] in (2, 3):
                relation[i] = 3
        for i in range(1, n):
            if not relation[i] and nodes[i].parent == nodes[best].parent and best:
                relation[i] = 4
    rows = np.zeros((n, len(NAMES)), np.float32)
    total, all_prose, most = max(chars[0], 1), max(below[0], 1), max(direct[best], 1) if best >= 0 else 1
    first_h1 = next((i for i in range(n) if nodes[i].tag == "h1" and not nodes[i].never), -1)
    zero = (0,) * len(SAYS)
    up, inside = [zero] * n, [0] * n
    place, kin, same, prev_prose, next_prose = [0] * n, [1] * n, [1] * n, [0] * n, [0] * n
    for node in nodes:
        kids = [p for p in node.parts if p.__class__ is int and not nodes[p].inline]
        if not kids:
            continue
        seen: dict[str, int] = {}
        for j, k in enumerate(kids):
            seen[nodes[k].tag] = seen.get(nodes[k].tag, 0) + 1
            place[k], kin[k] = j, len(kids)
            if j:
                prev_prose[k], next_prose[kids[j - 1]] = below[kids[j - 1]], below[k]
        for k in kids:
            same[k] = seen[nodes[k].tag]
    seen_chars, seen_prose = 0, 0
    for i, node in enumerate(nodes):
        said, bits = _said(node.attrs) if node.attrs else (zero, (0,) * BUCKETS)
        p = max(node.parent, 0)
        if i:
            if nodes[p].attrs:
                up[i] = tuple(map(int.__add__, up[p], _said(nodes[p].attrs)[0]))
            else:
                up[i] = up[p]
            inside[i] = inside[p] + articles[p]
        if not node.inline:
            c = chars[i]
            rows[i] = (
                GROUPS.get(node.tag, 0), min(node.depth, 40), min(c, 1e6), min(own[i], 1e6), min(words[i], 1e6), links[i], link_chars[i] / max(c, 1), tags[i], c / (tags[i] + 1), stops[i], commas[i], paras[i], place[i], kin[i], same[i], c / max(chars[p], 1), c / total, seen_chars / total,
                prose[i], below[i] / all_prose, direct[i], direct[i] / most, relation[i], below[i] / max(direct[best], 1) if best >= 0 else 0, below[p] - below[i], next_prose[i], prev_prose[i], direct[p] / most, seen_prose / all_prose, holds[0], inside[i], holds[i], heads[i], i < first_h1,
                *said, *up[i], *bits,
            )
        seen_chars += own[i]
        seen_prose += prose[i]
    return rows


def prose_outside(nodes: list[Node]) -> bool:
    """Whether a block of prose, or any text of an article or main element, stands outside of elements that are never article."""
    text: dict[int, str] = {}
    link: dict[int, int] = {}
    owner, linked, inside = list(range(len(nodes))), [False] * len(nodes), [False] * len(nodes)
    for i, node in enumerate(nodes):
        if i:
            linked[i] = linked[node.parent] or node.tag == "a"
            inside[i] = inside[node.parent] or node.tag in MAIN
            if node.inline:
                owner[i] = owner[node.parent]
        if node.never or node.tag in RAW:
            continue
        for p in node.parts:
            if p.__class__ is str and (t := p.strip()):
                if inside[i] and not linked[i]:
                    return True
                text[owner[i]] = text.get(owner[i], "") + " " + t
                link[owner[i]] = link.get(owner[i], 0) + len(t.encode("utf-8", "surrogatepass")) * linked[i]
    return any(_is_prose(len(t.encode("utf-8", "surrogatepass")), len(ENDS_SENTENCE.findall(t)), t.count(" "), link[i]) for i, t in text.items())


# ---- gradient-boosted trees


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of every inner node, value of every leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = self.feature.shape[1].bit_length()
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, leaf: float = 3.0) -> Trees:
    """Logistic loss, Newton leaves, splits over quantile bins; a level's histograms are made at once."""
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    width = bins + 1
    flat = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) + np.arange(m) * width
    usable = np.arange(width)[None, :] < np.array([len(e) for e in edges])[:, None]
    mean = (y * weight).sum() / weight.sum()
    prior = float(np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    score = np.full(n, prior)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p) * weight, p * (1 - p) * weight
        at = np.zeros(n, np.int64)
        for d in range(depth):
            first, many = (1 << d) - 1, 1 << d
            key = (flat + ((at - first) * (m * width))[:, None]).ravel()
            gs, hs = (np.bincount(key, np.repeat(v, m), many * m * width).reshape(many, m, width).cumsum(axis=2) for v in (g, h))
            G, H = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + leaf) + (G - gs) ** 2 / (H - hs + leaf) - G**2 / (H + leaf)
            gain[(hs < 1) | (H - hs < 1) | ~usable] = 0
            top = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(top[k]), width)
                if gain[k, j, b] > 1e-6:
                    feature[t, first + k], threshold[t, first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[t][at]] > threshold[t][at])
        value[t] = rate * np.bincount(at - inner, g, leaves) / (np.bincount(at - inner, h, leaves) + leaf)
        score = score + value[t][at - inner]
    return Trees(feature, threshold, value, prior)


def unlabelled(nodes: list[Node]) -> tuple[list[Node], np.ndarray]:
    """Labelled elements without the attribute keep, and which had it."""
    keep = np.array([bool(KEEP.search(n.attrs)) for n in nodes])
    bare = [Node(n.tag, n.parent, n.depth, KEEP.sub("", n.attrs), n.parts) for n in nodes]
    kinds(bare)
    return bare, keep


KEEP = re.compile(r" keep(?=[\s>/]|$)")


def fit(pages: list[str]) -> Trees:
    """Trees from pages whose article elements carry the attribute keep; an element weighs by its text, as in decoding."""
    xs, ys, ws = [], [], []
    for page in pages:
        nodes, keep = unlabelled(parse(page))
        keep[0] = page.startswith(ROOT)
        used = np.array([not n.inline and not n.never for n in nodes])
        own = np.array([_own(nodes, i) for i in range(len(nodes))])
        xs.append(node_features(nodes)[used])
        ys.append(keep[used].astype(float))
        ws.append((0.5 + np.minimum(own, 200) / 100)[used])
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


@functools.lru_cache(maxsize=1)
def default_trees() -> Trees:
    return fit(labelled_pages(90, 11))


# ---- decoding

OUTSIDE, ARTICLE, REMOVED = 0, 1, 2
#: parts of a whole, which are article only if the whole is
ITEMS = frozenset("li dt dd caption figcaption legend summary".split())


def _own(nodes: list[Node], i: int) -> int:
    """Characters of an element's own text and of the inline mark-up in it that goes with it."""
    out, todo = 0, [i]
    while todo:
        for p in nodes[todo.pop()].parts:
            if p.__class__ is str:
                out += 0 if p.isspace() else len(p)
            elif nodes[p].inline:
                todo.append(p)
    return out


def decode(nodes: list[Node], score: np.ndarray) -> list[int]:
    """The states with the highest total log probability that only move forward along every path.

    An element weighs by its own text (and a little in itself), so the choice follows what would be
    kept or lost. Elements that are never article are removed with all that is in them; inline mark-up
    that goes with its parent has no weight of its own.
    """
    n = len(nodes)
    yes, no = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    best = [None] * n
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if node.never:
            best[i] = [0.0, -1e9, 0.0]
            continue
        if node.inline:
            s = [0.0, 0.0, 0.0]
        else:
            w = 1.0 + min(_own(nodes, i), 400) / 40
            s = [w * no[i], w * yes[i], w * no[i]]
        for p in node.parts:
            if p.__class__ is int:
                b = best[p]
                s[OUTSIDE] += b[OUTSIDE] if nodes[p].tag in ITEMS else max(b[OUTSIDE], b[ARTICLE])
                s[ARTICLE] += max(b[ARTICLE], b[REMOVED])
                s[REMOVED] += b[REMOVED]
        best[i] = s
    state = [OUTSIDE] * n
    for i in range(n):
        up, b = state[nodes[i].parent] if i else OUTSIDE, best[i]
        if up == REMOVED or nodes[i].never:
            state[i] = REMOVED
        elif up == ARTICLE:
            state[i] = ARTICLE if b[ARTICLE] >= b[REMOVED] else REMOVED
        else:
            state[i] = ARTICLE if b[ARTICLE] > b[OUTSIDE] and nodes[i].tag not in ITEMS else OUTSIDE
    return state


def text_of(nodes: list[Node], state: list[int]) -> str:
    """Blocks of kept text in page order, white space inside them as one space."""
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        t = SPACE.sub(" ", html.unescape("".join(run))).strip()
        run.clear()
        if t:
            blocks.append(t)

    todo: list = [(0, 0)]
    while todo:
        i, at = todo.pop()
        node = nodes[i]
        is_block = node.tag in BLOCK
        if at == 0 and is_block:
            flush()
        kept = state[i] == ARTICLE
        for j in range(at, len(node.parts)):
            p = node.parts[j]
            if p.__class__ is str:
                if kept and node.tag not in RAW:
                    run.append(p)
            else:
                if nodes[p].tag == "br":
                    run.append(" ")
                    continue
                todo.append((i, j + 1))
                todo.append((p, 0))
                break
        else:
            if is_block:
                flush()
    flush()
    return "\n".join(blocks)


def extract(pages: list[str], trees: Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    score = trees.score(np.concatenate([node_features(n) for n in parsed]))
    out, at = [], 0
    for nodes in parsed:
        if len(nodes) == 1:
            out.append(SPACE.sub(" ", html.unescape("".join(nodes[0].parts))).strip())
        else:
            own, raised = score[at : at + len(nodes)], 1.0
            text = text_of(nodes, decode(nodes, own))
            if not text and prose_outside(nodes):
                while not text and raised < 1e4:
                    text, raised = text_of(nodes, decode(nodes, own + raised)), 2 * raised
            out.append(text)
        at += len(nodes)
    return out


def extract_main_text(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # a few thousand numbers

    def factory():
        def run(batch):
            texts = extract([x or "" for x in batch.column(2).to_pylist()], shared.value)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return run

    cols = [pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")]
    return map_batches(pages, cols, factory, "page_id long, url string, text string, n_chars long", rows=64)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), default_trees())
