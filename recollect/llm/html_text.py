"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the text between block-level tags. What a block shows itself (length,
links, punctuation, tag, place) goes through a linear classifier; its log-odds, clipped, and a
modest cost for going against the cue of the container around it are its capacities to the two
terminals. Smoothness edges join neighbours, stronger the closer they are in the document tree,
and siblings, strongest text blocks of one tag; next to nothing joins blocks of two containers.
The maximum flow's cut separates content from boilerplate; content blocks are joined in page
order. So a short paragraph that looks like a menu is held by those around it, and a wrong cue
is outvoted by two siblings that agree.

Cues come from tags and from whole names of class, id and role; a part of a name only hints, and
what a hint counts is measured on the sample. Neither the page's own elements nor a form or a hint
around most of a page's text say anything of it.

The classifier is fitted on the blocks of a sample of pages whose containers say what they are;
it never sees the containers, so it also tells blocks of pages without them.

Defined cases: null html counts as empty and gives an empty text; pages without tags are one
block; unclosed and crossed tags close with their parents; repeated rows are extracted one by
one; an empty table gives an empty result; extra columns play no part; where both labellings
cost the same, a block is boilerplate. Nothing is capped, pages of any length and depth are
read whole. Tags without an end stop at the next tag, quotes without one too, so reading is linear.
"""

from __future__ import annotations

import re
from html import unescape
from math import ceil, log
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

MAX_PAGES, MAX_BLOCKS = 2_000, 16_000
#: Costs: of a container's cue, of the classifier against and for content at most, of cutting
#: between neighbours of one container (and by their closeness) and of two, between siblings of
#: one container, between sibling text blocks of one tag.
CUE, AGAINST, FOR = 2.0, 3.0, 1.5
#: What a part of a name counts of a whole one where the sample says nothing of it.
HINT = 0.75
ADJACENT, NEAR, APART, SIBLING, ALIKE = 0.5, 0.4, 0.1, 0.6, 1.2
TEXT_TAGS = frozenset("p li dd dt td th h2 h3 h4 h5 h6 blockquote pre".split())

# Fixed values of HTML: what ends a block, what never holds text for readers, what has no end tag.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title".split())
HIDDEN_TAGS = frozenset("head title script style noscript template svg math iframe object canvas select button textarea datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTRS = r"(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+"
#: Comments and raw elements to their end, tags, declarations, and tags cut off by the next one or by
#: the end; every alternative stops at the next < outside quotes or takes what it has read.
RAW = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRS})>|<[!?/][^<>]*>|<[a-zA-Z/!?][^<>]*(?:>|(?=<)|\Z)", re.S | re.I)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Words of class, id and role that name boilerplate, page headers apart.
AWAY = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot colophon contentinfo sidebar side aside rail complementary comment comments reply replies respond disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay dialog share sharing social follow subscribe subscription newsletter signup login search form related recommended recommendations trending popular widget widgets pager pagination toolbar skip copyright legal disclaimer".split())
HEADER = frozenset("header masthead topbar".split())
CONTENT = frozenset("article content main post entry story articlebody maincontent".split())
SPLIT = re.compile(r"[^a-z0-9]+")


def attributes(text: str) -> dict[str, str]:
    """Names, lower-cased, and values of a tag's attributes, the first of equal names."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(attrs.get("style", "")))


def _cue(tag: str, attrs: dict[str, str], inside: bool) -> float:
    """Above 0 for a container of content, below for one of boilerplate, 0 for neither: 1 where the tag
    or a whole name of class, id or role says it, ``HINT`` where a part of a name does (what
    ``site-footer`` means, ``category-legal`` need not). The page itself is no container."""
    if tag in ("body", "html"):
        return 0
    if tag in ("nav", "footer", "aside", "menu", "dialog"):
        return -1
    if tag == "form":
        return -HINT
    names = " ".join(attrs.get(a, "") for a in ("class", "id", "role")).lower().split()
    whole = set(names)
    if whole & AWAY or (whole & HEADER and not inside):
        return -1
    if tag in ("article", "main") or whole & CONTENT:
        return 1
    if tag == "header":
        return 0 if inside else -1
    parts = {w for n in names for w in SPLIT.split(n)}
    if parts & AWAY or (parts & HEADER and not inside):
        return -HINT
    return HINT if parts & CONTENT else 0


class Block(NamedTuple):
    """A block's text, its container's cue and number, its parent block's number, its depth, the
    depth it shares with the block before, the share of its text in links, its tag."""
    text: str
    cue: float
    holder: int
    parent: int
    depth: int
    shared: int
    links: float
    tag: str


class _Open(NamedTuple):
    """An open element: tag; number, cue and container; hidden; in an article; its nearest block-level element's tag, number and parent."""
    tag: str
    cue: float
    holder: int
    hidden: bool
    inside: bool
    block: str
    number: int
    parent: int


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    if not html:
        return out
    stack = [_Open("", 0, 0, False, False, "", 0, 0)]
    count: dict[str, int] = {}
    texts: list[str] = []
    linked = total = 0
    in_link = serial = 0
    low = 1  # the least depth since the block before

    def flush():
        nonlocal linked, total, low
        if stack[-1].hidden:
            return  # what is open began outside and goes on behind
        if texts:
            text = " ".join(unescape("".join(texts)).split())
            texts.clear()
            top = stack[-1]
            if text:
                out.append(Block(text, top.cue, top.holder, top.parent, len(stack), min(low, len(stack)), linked / max(1, total), top.block))
                low = len(stack)
        linked = total = 0

    def add(s: str):
        nonlocal linked, total
        if not stack[-1].hidden:
            texts.append(s)
            n = len(s)
            total += n
            if in_link:
                linked += n

    def close(i: int):
        nonlocal low
        for s in stack[i:]:
            count[s.tag] -= 1
        del stack[i:]
        low = min(low, len(stack))

    at = 0
    for m in RAW.finditer(html):
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                in_link = 0
            if not count.get(tag):
                if tag == "p":
                    flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    ends = any(s.tag in BLOCK_TAGS for s in stack[i:])
                    if ends:
                        flush()
                    was = stack[-1].hidden
                    close(i)
                    if ends and was:
                        flush()  # a hidden block parts what stands around it
                    break
                if tag not in BLOCK_TAGS and stack[i].tag in BLOCK_TAGS:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            else:
                add(" ") if tag == "br" else None
            continue
        if tag in BLOCK_TAGS:
            flush()
            in_link = 0
            # A block in a paragraph or a list item beside another ends the open one.
            shut = ("p",) if tag not in ("li", "dt", "dd", "tr", "td", "th") else {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}[tag]
            stop = ("ul", "ol", "menu", "dl", "table", "article", "section", "main", "body") if shut != ("p",) else ("article", "section", "main", "div", "td", "th", "li", "body", "nav", "aside", "footer", "header", "form", "blockquote")
            for i in range(len(stack) - 1, 0, -1) if any(count.get(t) for t in shut) else ():
                if stack[i].tag in shut:
                    close(i)
                    break
                if stack[i].tag in stop:
                    break
        if tag == "a":
            in_link = 1
        if m[4].rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        serial += 1
        up = stack[-1]
        attrs = attributes(m[4]) if m[4] else {}
        cue = _cue(tag, attrs, up.cue > 0 or up.inside) if attrs or tag in BLOCK_TAGS else 0
        count[tag] = count.get(tag, 0) + 1
        own = (tag, serial, up.number) if tag in BLOCK_TAGS else (up.block, up.number, up.parent)
        stack.append(_Open(tag, cue or up.cue, serial if cue else up.holder, up.hidden or tag in HIDDEN_TAGS or hidden(attrs), up.inside or tag in ("article", "main"), *own))
    if at < len(html):
        add(html[at:])
    flush()
    return unwrapped(out)


def unwrapped(bs: list[Block]) -> list[Block]:
    """The blocks without the hints of containers that hold most of the page's text: they wrap it."""
    chars: dict[int, int] = {}
    for b in bs:
        if b.cue == -HINT:
            chars[b.holder] = chars.get(b.holder, 0) + len(b.text)
    most = sum(len(b.text) for b in bs) / 2
    around = {h for h, n in chars.items() if n > most}
    return [b._replace(cue=0) if b.holder in around else b for b in bs] if around else bs


def features(bs: list[Block]) -> np.ndarray:
    """What the classifier sees of each block: nothing of its containers."""
    n = len(bs)
    x = np.zeros((n, 9))
    for i, b in enumerate(bs):
        words = b.text.count(" ") + 1
        x[i] = (1, log(1 + words), log(1 + len(b.text)) / 2, b.links, (b.text.count(".") + b.text.count(",")) / words,
                b.tag in ("h1", "h2", "h3"), b.tag in ("li", "td", "th", "dt"), "©" in b.text or "@" in b.text, abs(2 * (i + 0.5) / n - 1))
    return x


#: Weights where the pages offer nothing to learn from (long text with few links is content).
FALLBACK = np.array([-2.0, 1.0, 0.2, -4.0, 0.5, 1.0, -1.0, -2.0, -1.0])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on blocks, both classes weighing alike."""
    if len(set(y.tolist())) < 2:
        return FALLBACK
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    scale = 1 / (0.25 * (weight[:, None] * x * x).sum(0) + 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.3 * scale * (x.T @ (weight * (p - y)) + 1e-3 * w)
    return w


def cut(cost: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for blocks on the source side of a minimum cut.

    cost[i] > 0 is the capacity from the source (lost if i is labelled boilerplate), < 0 to the
    sink. Dinic's algorithm: levels by breadth-first search, then a blocking flow.
    """
    n = len(cost)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    near: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a, b, c, back):
        near[a].append(len(to))
        to.append(b)
        cap.append(c)
        near[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(cost.tolist()):
        if c > 0:
            edge(source, i, c, 0.0)
        elif c < 0:
            edge(i, sink, -c, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for u in queue:
            for e in near[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([level[i] >= 0 for i in range(n)], bool)
        next_edge = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[full] ^ 1]
                del path[full:]
            while next_edge[u] < len(near[u]):
                e = near[u][next_edge[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                next_edge[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                next_edge[u] += 1
                continue
            path.append(e)
            u = to[e]


class Model(NamedTuple):
    """The classifier's weights, and what a hint counts."""
    weights: np.ndarray
    hint: float = HINT


DEFAULT = Model(FALLBACK)


def capacities(bs: list[Block], model: Model) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Each block's cost (above 0 for content) and the smoothness edges."""
    said = np.array([b.cue for b in bs])
    said = np.where(np.abs(said) == HINT, np.sign(said) * model.hint, said)
    cost = np.clip(features(bs) @ model.weights, -AGAINST, FOR) + CUE * said
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            a = bs[i - 1]
            edges.append((i - 1, i, ADJACENT + NEAR * b.shared / max(a.depth, b.depth) if a.holder == b.holder else APART))
        if b.parent in last:
            a = bs[last[b.parent]]
            edges.append((last[b.parent], i, (SIBLING if a.holder == b.holder else 0.0) + (ALIKE if a.tag == b.tag and a.tag in TEXT_TAGS else 0.0)))
        last[b.parent] = i
    return cost, edges


def label(bs: list[Block], model: Model) -> np.ndarray:
    """Whether each block is content."""
    return cut(*capacities(bs, model))


def main_text(html: str | None, model: Model) -> str:
    bs = blocks(html)
    return "\n".join(b.text for b, keep in zip(bs, label(bs, model), strict=True) if keep) if bs else ""


def drawn(bs: list[Block]) -> list[int]:
    """One block of each container that says what it is, by the checksum of its text."""
    first: dict[int, tuple[int, int]] = {}
    for i, b in enumerate(bs):
        if b.cue:
            first[b.holder] = min(first.get(b.holder, (1 << 32, 0)), (crc32(b.text.encode("utf-8", "surrogatepass")), i))
    return [i for _, i in first.values()]


def learn(pages: DataFrame, max_pages: int = MAX_PAGES, max_blocks: int = MAX_BLOCKS) -> Model:
    """The block classifier, from one block of each telling container of about max_pages pages by
    hash, equal blocks once and max_blocks at most. Containers that only hint are not learned from:
    how often the classifier agrees with them says what a hint counts."""
    every = max(1, ceil(pages.count() / max_pages))

    def look(batches):
        for pdf in batches:
            for html in pdf.html:
                bs = blocks(html)
                if pick := drawn(bs):
                    yield pd.DataFrame({"x": list(features(bs)[pick]), "y": [float(bs[i].cue) for i in pick]})

    sample = pages.select("html").filter(F.pmod(F.xxhash64("html"), F.lit(every)) == 0)
    rows = sample.mapInPandas(look, "x array<double>, y double").distinct()
    got = rows.orderBy(F.xxhash64("x", "y"), "y").limit(max_blocks).collect()
    if not got:
        return DEFAULT
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    sure = np.abs(y) == 1
    weights = fit(x[sure], (y[sure] > 0).astype(float)) if sure.any() else FALLBACK
    if sure.all():
        return Model(weights)
    agreed = ((x[~sure] @ weights > 0) == (y[~sure] > 0)).mean()
    return Model(weights, float(np.clip(2 * agreed - 1, 0.0, 1.0)))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    model = learn(pages)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, model) for h in html])

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
