"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into text blocks. Each block becomes a node: the costs that a small fixed classifier
(DOM place, class names, link density, length) charges for calling it boilerplate or content are its
capacities to the two terminals; blocks that follow one another, and blocks that share a container,
are joined by smoothness edges. The maximum flow separates content from boilerplate.

Defined results: null and empty html, and pages without text, give an empty text. Blocks on the fence
(a tie of the cut) are boilerplate. Unclosed, stray and badly nested tags are repaired as browsers
do in the simple cases. Rows are treated one by one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

# Element and class names by role.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("script style head template noscript iframe object svg math canvas audio video select textarea".split())
RAW_TAGS = frozenset("script style textarea iframe noscript title xmp".split())
FORMAT_TAGS = frozenset("b i u s em strong small big sub sup font tt code kbd var samp mark q cite dfn ins del strike bdi bdo".split())
BOILER_TAGS = frozenset("nav footer aside form menu button dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar toolbar alert".split())
BOILER_WORDS = frozenset("ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus feedback footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar trending widget".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: The smoothness of neighbours, of neighbours in one container, and of the next block of a container.
ADJACENT, SAME_PARENT, PROXIMITY = 20, 30, 15

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]", re.S)
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLASS_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    boiler: bool
    article: bool
    links: float


@dataclass
class _Frame:
    tag: str
    block: bool
    number: int
    boiler: bool
    article: bool
    dropped: bool


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    frames: list[_Frame] = field(default_factory=lambda: [_Frame("", True, 0, False, False, False)])
    count: int = 0
    in_link: bool = False

    def text(self, raw: str) -> None:
        if raw and not self.frames[-1].dropped:
            self.pieces.append(raw)
            if self.in_link:
                self.linked += len(raw)

    def end_block(self) -> None:
        if not self.pieces:
            return
        text = " ".join(unescape("".join(self.pieces)).split())
        if text:
            own = self.frames[-1]
            box = next(f for f in reversed(self.frames) if f.block)
            above = next((f.number for f in reversed(self.frames) if f.block and f is not box), 0)
            self.blocks.append(Block(text, box.tag, above, own.boiler, own.article, min(1.0, self.linked / len(text))))
        self.pieces, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK_TAGS
        if tag == "body" or block and self.frames[-1].tag == "head":
            self.close_within("head", ())
        if block:
            self.end_block()
            if tag == "li":
                self.close_within("li", ("ul", "ol", "menu", "dir"))
            elif tag in ("td", "th"):
                self.close_within("td", ("tr", "table")) or self.close_within("th", ("tr", "table"))
            elif tag == "tr":
                self.close_within("tr", ("table",))
            elif tag in ("dt", "dd"):
                self.close_within("dt", ("dl",)) or self.close_within("dd", ("dl",))
            self.close_within("p", ("article", "aside", "td", "th", "div", "section", "main", "body", "li", "blockquote"))
        if tag in VOID_TAGS or tag in FORMAT_TAGS:
            return
        top = self.frames[-1]
        self.count += 1
        boiler, article = top.boiler, top.article or tag in ("article", "main")
        if tag not in ("html", "body"):
            boiler = boiler or tag in BOILER_TAGS or tag == "header" and not top.article
        dropped = top.dropped or tag in DROPPED_TAGS
        if attributes.strip():
            words: set[str] = set()
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    words.update(_CLASS_WORD.findall(value))
                elif name == "role":
                    boiler = boiler or value.strip() in BOILER_ROLES and tag not in ("html", "body", "article", "main")
                    article = article or value.strip() in ("main", "article")
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
                    dropped = dropped or tag not in ("html", "body")
            if tag not in ("html", "body", "article", "main") and words & BOILER_WORDS and not words & CONTENT_WORDS:
                boiler = boiler or not (tag in ("h1", "header") and top.article)
        self.frames.append(_Frame(tag, block, self.count, boiler, article, dropped))

    def close_within(self, tag: str, fences: tuple[str, ...]) -> bool:
        """Close the innermost open `tag` unless a fence lies above it."""
        for i in range(len(self.frames) - 1, 0, -1):
            if self.frames[i].tag == tag:
                del self.frames[i:]
                return True
            if self.frames[i].tag in fences:
                return False
        return False

    def close(self, tag: str) -> None:
        block = tag in BLOCK_TAGS
        if block:
            self.end_block()
        for i in range(len(self.frames) - 1, 0, -1):
            if self.frames[i].tag == tag:
                del self.frames[i:]
                return
            if self.frames[i].block and not block:
                return


def _tag_end(html: str, at: int, last: int) -> int:
    """Place of the bracket that closes a tag: the first one outside quotes. A quote counts only if its partner lies
    before the page's last bracket, so that broken quotes never hide the end; there is one, since `at` <= `last`."""
    while html[at := _STOP.search(html, at).start()] != ">":
        partner = html.find(html[at], at + 1, last)
        at = (partner if partner >= 0 else at) + 1
    return at


def next_token(html: str, at: int, last: int) -> tuple[int, int, str, str, bool] | None:
    """(start, end, tag, attributes, closing) of the next tag, comment or declaration; the tag of the latter two is empty.
    `last` is the page's last bracket. No character is read twice, whatever is broken."""
    while m := _OPEN.search(html, at):
        start, at = m.start(), m.end()
        if m[2] is None and m[0].startswith("<!--"):
            return start, at, "", "", False
        if start < last:
            end = _tag_end(html, at, last) if m[2] else html.find(">", at)
            return start, end + 1, (m[2] or "").lower(), html[at:end] if m[2] else "", bool(m[1])
        if (at := html.find("<!--", start + 1)) < 0:  # nothing closes it, so it is text, as are all behind it but comments
            return None
    return None


def blocks_of(html: str) -> list[Block]:
    """Text blocks of a page in order; scripts, styles, comments and hidden parts are gone."""
    page, at, last = _Page(), 0, html.rfind(">")
    while token := next_token(html, at, last):
        start, end, tag, attributes, closing = token
        page.text(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            page.in_link = not closing
        if tag == "br":
            page.text(" ")
        elif closing:
            page.close(tag)
        elif tag in RAW_TAGS:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            at = end.start() if end else len(html)
            page.open(tag, attributes)
            page.frames[-1].dropped = True
        elif not attributes.rstrip().endswith("/") or tag in BLOCK_TAGS:
            page.open(tag, attributes)
    page.text(html[at:])
    page.end_block()
    return page.blocks


def costs(block: Block) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content), in hundredths."""
    keep, drop = 0.0, 0.0
    if block.boiler:
        drop += 800
    if block.article:
        keep += 400
    words = block.text.count(" ") + 1
    keep += 30 * log2(1 + words) * (1 - block.links)
    drop += 150 if not block.article else 0
    drop += 200 * block.links
    if block.tag in ("h1", "h2", "h3", "p", "blockquote", "pre"):
        keep += 60
    if not block.article and block.text.startswith(("©", "(c)", "Copyright")):
        drop += 300
    return int(keep), int(drop)


def content_side(keep: list[int], drop: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut between the content terminal (capacities `keep`) and the other (`drop`): the content side.

    What can flow straight through a node is sent first; Dinic's phases move the rest over the edges.
    """
    n = len(keep)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        graph[a].append(len(head))
        head.append(b)
        room.append(there)
        graph[b].append(len(head))
        head.append(a)
        room.append(back)

    for v in range(n):
        straight = min(keep[v], drop[v])
        if keep[v] > straight:
            join(source, v, keep[v] - straight, 0)
        elif drop[v] > straight:
            join(v, sink, drop[v] - straight, 0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if room[e] and level[head[e]] < 0:
                    level[head[e]] = level[v] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [level[v] >= 0 for v in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(room[e] for e in path)
                for k in range(len(path) - 1, -1, -1):
                    room[path[k]] -= flow
                    room[path[k] ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if not room[e])
                v = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[v] < len(graph[v]):
                e = graph[v][at[v]]
                if room[e] and level[head[e]] == level[v] + 1:
                    path.append(e)
                    v = head[e]
                    break
                at[v] += 1
            else:
                if v == source:
                    break
                e = path.pop()
                v = head[e ^ 1]
                at[v] += 1


def main_text(html: str | None) -> str:
    """Content blocks of a page, joined by line ends."""
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    priced = [costs(b) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SAME_PARENT if blocks[i - 1].parent == b.parent else ADJACENT))
        if last.get(b.parent, i - 1) < i - 1:
            edges.append((last[b.parent], i, PROXIMITY))
        last[b.parent] = i
    side = content_side([k for k, _ in priced], [d for _, d in priced], edges)
    return "\n".join(b.text for b, s in zip(blocks, side) if s)


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of `keep` with the main text of every row."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(html).alias("html"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join([*[f"{n} {rows.schema[n].dataType.simpleString()}" for n in names], "text string"])
    return rows.mapInArrow(task, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], F.col("text"))
