"""Main text of web pages by minimum cut.

A tolerant scanner turns a page into text blocks with statistics and hints
from the elements around them. A logistic classifier gives each block a cost
for being called content and one for boilerplate; these are the capacities of
its edges to the two terminals. Neighbours in page order and blocks of one
parent are tied by edges that cost something to cut, so a short paragraph
between long ones stays with them. The maximum flow then is the cheapest
labelling, and the source side is the text.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, id_out, raw, sized

#: Quantifiers never give back, so a page costs its length; a tag that the end of the page cuts off ends there.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?|[^<]++|<""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label|name)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Kinds of elements (fixed values: HTML names).
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "xmp"}
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "audio", "video", "select", "option", "textarea", "button", "head", "title", "noembed", "input", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that begin and end a block; any other, also an unknown one, is part of the line.
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "listing", "main", "menu", "nav", "ol", "optgroup", "p", "plaintext", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "xmp"}
FENCES = {"article", "main", "section", "div", "body", "html", "td", "th", "table", "ul", "ol", "dl", "aside", "nav", "header", "footer", "form", "blockquote", "figure", "fieldset"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": set()}
BAD_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
GOOD_TAGS = {"article", "main"}
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|sidebar|side|footer|foot|masthead|topbar|toolbar|breadcrumbs?|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|share|sharing|social|related|recommend\w*|subscribe|subscription|newsletter|signup|login|search\w*|pagination|pager|copyright|legal|disclaimer|widget|tags?|skip\w*|form|outbrain|taboola|complementary|navigation|contentinfo|dialog)(?:[\s_-]|$)", re.I)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|reply|replies|disqus\w*|discussion|reviews|reader-comments?|responses)(?:[\s_-]|$)", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|post|story|main|body|text|prose|blog)(?:[\s_-]|$)", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|head|banner|masthead)(?:[\s_-]|$)", re.I)

FEATURES = ["bias", "long", "words", "links", "stops", "heading", "item", "bad_tag", "bad_name", "comment", "header", "good_name", "in_article"]
#: What the weights are before any page is seen, and the precision with which they are held.
PRIOR = np.array([0.6, 1.2, 0.5, -3.0, 1.0, 0.6, -0.6, -9.0, -7.0, -12.0, -6.0, 2.0, 5.0])
HELD = np.array([1e3, 1, 1, 1, 1, 4, 4, 40, 40, 40, 40, 4, 1e9])


@dataclass
class Block:
    text: str
    parent: int  # number of the innermost block element
    depth: int
    fence: int  # number of the innermost element that hints at boilerplate, 0 for none
    x: tuple[float, ...]


@dataclass(slots=True)
class _Open:
    tag: str
    number: int
    flags: tuple[bool, bool, bool, bool, bool, bool]  # bad tag, bad name, comment, header, good name, article
    fence: int
    dropped: bool


_NONE = (False,) * 6


def _entered(tag: str, attrs: str, up: _Open, number: int) -> _Open:
    bad, name, comment, header, good, article = up.flags
    fence = up.fence
    own = ""
    if attrs and "=" in attrs:
        own = " ".join(v.strip("\"'") for _, v in _ATTR.findall(attrs))
    hint = False
    if tag in GOOD_TAGS:
        article, bad, name = True, False, False
    if tag in BAD_TAGS:
        bad = hint = True
    if tag == "header" and not article and not good:
        header = hint = True
    if own and tag not in ("html", "body"):
        if _COMMENT.search(own):
            comment = hint = True
        elif tag not in GOOD_TAGS and _GOOD.search(own) and not _BAD.search(own):
            good = True
        elif tag not in GOOD_TAGS and _BAD.search(own):
            name = hint = True
        elif not article and not good and _HEADER.search(own):
            header = hint = True
    if hint:  # what is nearer counts: an advert inside an article is not the article
        article = good = False
    flags = (bad, name, comment, header, good, article)
    return _Open(tag, number, flags if flags != up.flags else up.flags, number if hint else fence, up.dropped or tag in DROPPED)


class _Stack:
    """Open elements, with the places of each tag, of fences and of blocks, so that nothing is searched for."""

    def __init__(self):
        self.open = [_Open("", 0, _NONE, 0, False)]
        self.of: dict[str, list[int]] = {}
        self.fences: list[int] = []
        self.blocks = [0]

    def push(self, e: _Open) -> None:
        at = len(self.open)
        self.open.append(e)
        self.of.setdefault(e.tag, []).append(at)
        if e.tag in FENCES:
            self.fences.append(at)
        if e.tag in BLOCKS:
            self.blocks.append(at)

    def last(self, tag: str) -> int:
        places = self.of.get(tag)
        return places[-1] if places else 0

    def cut(self, at: int) -> None:
        for e in self.open[at:]:
            self.of[e.tag].pop()
        del self.open[at:]
        for places in (self.fences, self.blocks):
            while places and places[-1] >= at:
                places.pop()


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles and controls are not text."""
    stack = _Stack()
    out: list[Block] = []
    held: list[str] = []
    linked = count = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                top = stack.open[stack.blocks[-1]]
                out.append(Block(text, top.number, len(stack.open), top.fence, _features(text, linked, top)))
        linked = 0

    def leave(at: int) -> None:
        if stack.blocks[-1] >= at:
            flush()
        stack.cut(at)

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                if not stack.open[-1].dropped:
                    text = html.unescape(m[0])
                    held.append(text)
                    if stack.last("a"):
                        linked += len(text.strip())
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if m[1]:
            at = stack.last(tag)
            if at and not (not block and stack.fences and stack.fences[-1] > at):
                leave(at)
            elif block:
                flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if block or tag == "option":
            flush()
            ends = CLOSES.get(tag, ())
            while True:
                at = max(stack.last("p"), *map(stack.last, ends), 0) if block else 0
                if not at or stack.fences and stack.fences[-1] > at:
                    break
                leave(at)
                if stack.open[-1].tag not in ends:
                    break
            if (at := stack.last("head")) and (tag == "body" or tag in FENCES):
                stack.cut(at)
        count += 1
        if m[3].endswith("/") and tag == "svg":
            continue
        stack.push(_entered(tag, m[3], stack.open[-1], count))
    flush()
    return out


def _features(text: str, linked: int, top: _Open) -> tuple[float, ...]:
    bad, name, comment, header, good, article = top.flags
    n = len(text)
    stops = text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", "…"))
    return (
        1.0, min(n, 400) / 200 - 0.5, min(text.count(" ") + 1, 40) / 20 - 0.5, min(1.0, linked / n), min(2, stops) / 2,
        float(top.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(top.tag in ("li", "td", "th", "dt", "dd", "option")),
        float(bad), float(name), float(comment), float(header), float(good), float(article),
    )


def max_flow_labels(gain: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Content (True) or not for each node, of least total cost.

    ``gain``: cost of calling a node boilerplate less that of calling it
    content. ``edges``: cost of giving two nodes different labels. A node
    whose own gain outweighs all its edges has the label of its gain in every
    optimum, so it is settled and folded into its neighbours; the flow runs
    over what is left.
    """
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    g, label = list(gain), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(g[i]) >= sum(near[i].values()):
            label[i] = g[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                g[j] += c if label[i] else -c
                todo.append(j)
            near[i].clear()
    for i in range(n):
        if label[i] is None:  # what is left falls apart into pieces that no edge joins
            piece, line = {i}, [i]
            while line:
                for j in near[line.pop()]:
                    if j not in piece:
                        piece.add(j)
                        line.append(j)
            source = _source_side(sorted(piece), g, near)
            for j in piece:
                label[j] = j in source
    return label


def _source_side(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side of the minimum cut: flow along shortest paths, all of one length at a time."""
    source, sink, least = -1, -2, 1e-9
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    cap[source], cap[sink] = {}, {}
    for i in nodes:
        if gain[i] > 0:
            cap[source][i], cap[i][source] = gain[i], 0.0
        elif gain[i] < 0:
            cap[i][sink], cap[sink][i] = -gain[i], 0.0
    while True:
        level, line = {source: 0}, deque([source])
        while line:
            i = line.popleft()
            for j, c in cap[i].items():
                if c > least and j not in level:
                    level[j] = level[i] + 1
                    line.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        edges = {i: iter(cap[i]) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                push = min(cap[x][y] for x, y in zip(path, path[1:]))  # noqa: B905
                cutoff = len(path)
                for k in range(len(path) - 2, -1, -1):
                    x, y = path[k], path[k + 1]
                    cap[x][y] -= push
                    cap[y][x] = cap[y].get(x, 0.0) + push
                    if cap[x][y] <= least:
                        cutoff = k + 1
                del path[cutoff:]
                edges[path[-1]] = iter(list(cap[path[-1]]))
                continue
            for j in edges[i]:
                if cap[i][j] > least and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level[i] = -1


def main_text(page: str, weights: np.ndarray = PRIOR, tie: float = 1.5) -> str:
    """Blocks on the content side of the minimum cut, joined by line breaks."""
    found = blocks(page)
    if not found:
        return ""
    gain = (np.array([b.x for b in found]) @ weights).tolist()  # log odds are the difference of the two costs
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        for j, most in ((i - 1, tie), (last.get(b.parent, -1), tie / 2)):
            if j >= 0 and found[j].fence == b.fence:
                edges[j, i] = edges.get((j, i), 0.0) + most / (1 + abs(b.depth - found[j].depth))
        last[b.parent] = i
    return "\n".join(b.text for b, keep in zip(found, max_flow_labels(gain, edges), strict=True) if keep)


def fit(pages: list[str]) -> np.ndarray:
    """Weights by Newton steps from the prior, on pages that mark their own article.

    Inside or outside the marked element is the label; the feature that says
    so is left out while fitting and keeps its prior weight.
    """
    x, y = [], []
    for page in pages:
        own = blocks(page)
        if any(b.x[-1] for b in own):
            x += [b.x for b in own]
            y += [b.x[-1] and not (b.x[7] or b.x[8] or b.x[9]) for b in own]
    if not x:
        return PRIOR
    a, t = np.array(x), np.array(y, float)
    a[:, -1] = 0.0
    w = PRIOR.copy()
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - t) + HELD * (w - PRIOR)
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(HELD), grad)
    w[7:11] = np.minimum(w[7:11], PRIOR[7:11])  # a sample without them must not make menus or comments content
    return w


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_rows: int = 300) -> np.ndarray:
    """``fit`` on about ``train_rows`` pages, spread by a hash of the identifier; null pages teach nothing."""
    every = max(1, pages.select(id_col).count() // train_rows)
    rows = pages.where(F.col(html_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(every)) == 0)).select(id_col, html_col).limit(2 * train_rows).collect()
    return fit([r[1] for r in sorted(rows, key=lambda r: (r[0] is None, r[0]))])


def extract(pages: DataFrame, weights: np.ndarray = PRIOR, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of each page.

    A null or empty page has an empty text. White space inside a block becomes
    one space, character references are decoded, blocks are joined by a line
    break. The whole page is read, in time that grows with its length however
    its tags are nested or cut off; where two labellings cost the same, what
    is not needed on the content side is boilerplate. Pages are independent:
    nothing is shuffled, repeated rows give equal rows, rows without an id are
    read like others; other columns are ignored; an empty table gives no rows.
    """
    held = np.asarray(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "html", rows=256):
            texts = [main_text(t.decode("utf-8", "replace"), held) for t in raw(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    out = rows.mapInArrow(step, "id long, url string, text string, n_chars long")
    return out.select(id_out("id", "page_id"), "url", "text", "n_chars")
