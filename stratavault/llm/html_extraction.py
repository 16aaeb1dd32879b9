"""Main text of web pages by minimum-cut labelling of their blocks.

A page is split into text blocks at block-level elements.  Blocks and the
elements that hold them are the nodes of a graph.

* A classifier looks at a block's own text (length, sentence marks, share of
  links, heading or list item); its bounded log-odds are the block's costs of
  both labels, its terminal capacities.
* An element's name, role and class words are its terminal capacities: names
  that say what an element is for (``article``, ``nav``) bind, class words
  weigh as much as some paragraphs, and most elements have none.
* Smoothness edges join neighbouring blocks, each block with its element (more
  so where that element or one around it is marked) and each element with the
  one around it.

The minimum cut labels the nodes, and the blocks on the content side are the
text: short paragraphs follow their article, long ones in a footer follow the
footer, and a wrongly named wrapper is outvoted by the paragraphs in it.

Class words count as the whole word or as the last or first part of a compound;
``has-sidebar``, ``no-sidebar`` or ``category-legal`` say nothing about the
element itself.  Positive marks below an element that can't hold the article
(comments, navigation, adverts) don't count.

Scripts, styles, comments, templates, forms' controls and the head never hold
content.  Character references are decoded after the split.  ``<br>`` counts as
white space.  White space of any kind inside a block becomes one space.

Defined results: null or empty html and pages without content give an empty
text; an unfinished tag at the end is dropped; end tags without a start are
ignored; rows with a null key and repeated rows each get a row; extra columns
aren't looked at.  Time grows in proportion to a page's length.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .max_flow import min_cut
from .words import pieces

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|template|textarea|select|iframe|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)

_BLOCK = frozenset(
    "address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol p pre section summary svg table tbody td tfoot th thead tr ul caption button option label".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the key closes while they are open.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose open children a start tag does reach; all others stop it.
_OPEN = frozenset("p li dt dd tr tbody thead tfoot option".split())
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_NEVER = frozenset("head button option".split())

#: Weight of a mark that decides, of a class word, and of a hint, in paragraphs' costs (of 2.2 at most).
_SURE, _STRONG, _HINT = 1e4, 25.0, 4.0
_CONTENT_NAMES = frozenset("article main".split())
_OTHER_NAMES = frozenset("nav footer aside header menu dialog".split())
_HINT_NAMES = {"form": -8.0, "fieldset": -_HINT, "address": -_HINT, "noscript": -_HINT, "object": -1.0, "canvas": -1.0, "svg": -_HINT, "label": -_HINT, "legend": -_HINT}
_GOOD = frozenset("article content post entry story main body text prose".split())
#: What an element with such a class word holds isn't the article, nor is anything below it.
_NEVER_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsors sponsored promo promoted promotion comment comments commentlist disqus replies respond reply discussion "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager trending popular".split()
)
#: Places on a page, which may also name the layout around the article.
_PLACES = frozenset("nav navbar navigation menu sidebar sidenav header masthead banner footer foot copyright notice alert widget widgets toolbar search skip tags legal disclaimer".split())
#: First parts after which a compound names a state or a topic.
_STATES = frozenset("has no with without is not category cat tag topic type format theme layout".split())
_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|alert\w*|dialog|menu\w*", re.IGNORECASE)
_SENTENCE = re.compile(r"[.!?;:,](?:\s|$)")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


class _Node:
    """An element: its own mark, the strength of the marks it stands under (0 to
    2), whether they rule the article out, and the elements around it."""

    __slots__ = ("name", "up", "mark", "grip", "barred", "dead", "place")

    def __init__(self, name: str, up: _Node | None, mark: float, barred: bool, dead: bool):
        self.name, self.up, self.mark, self.dead = name, up, mark, dead
        self.barred = barred or up is not None and up.barred
        own = 2 if abs(mark) >= _STRONG else 1 if mark else 0
        self.grip = own if mark or up is None else up.grip
        self.place = -1


class Block:
    """A text block: its text, its element and how much of it is links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: _Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def class_mark(value: str, article: bool = False) -> tuple[float, bool]:
    """What class, id or label words say: a weight, and whether the article is
    ruled out below.  On an ``article`` element compounds don't speak against it."""
    good, worst, barred = 0.0, 0.0, False
    for word in value.split():
        parts = [x.lower() for x in _PARTS.findall(word)]
        if not parts or parts[0] in _STATES and len(parts) > 1:
            continue
        first, last, whole = parts[0], parts[-1], "".join(parts)
        alone = whole in _NEVER_ARTICLE or whole in _PLACES
        if article and not alone and first not in ("comment", "comments"):
            continue
        if whole in _NEVER_ARTICLE or first in _NEVER_ARTICLE or last in _NEVER_ARTICLE:
            worst, barred = -_SURE, True
        elif last in _PLACES or whole in _PLACES:
            if not (last == "header" and first in _GOOD | {"page", "section"} and len(parts) > 1):
                worst = min(worst, -_STRONG)
        elif first in _PLACES:
            worst = min(worst, -_HINT)
        elif first in _GOOD or last in _GOOD:
            good = _HINT
    return worst or good, barred


def _start(name: str, attrs: str, up: _Node, in_article: bool) -> _Node:
    mark, barred, dead = _HINT_NAMES.get(name, 0.0), False, up.dead or name in _NEVER
    if name in _CONTENT_NAMES:
        mark = _SURE
    elif name in _OTHER_NAMES and not (name == "header" and in_article):
        mark, barred = -_SURE, name != "header"
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), html_lib.unescape((m[2] or "").strip("\"'"))
            if key in ("class", "id", "aria-label"):
                if name not in ("body", "html"):
                    weight, rules_out = class_mark(value, name in _CONTENT_NAMES)
                    if weight < 0:
                        mark, barred = min(mark, weight) if mark < 0 else weight, barred or rules_out
                    elif mark >= 0:
                        mark = max(mark, weight)
            elif key == "role" and _ROLE.fullmatch(value):
                mark, barred = -_SURE, True
            elif (key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value.lower() == "articlebody") and mark > -_SURE:
                mark = _SURE
            elif key == "hidden" and not m[2] or key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                dead = True
    if mark > 0 and up.barred:
        mark = 0.0
    return _Node(name, up, mark, barred, dead)


def split_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    node = _Node("", None, 0.0, False, False)
    open_: Counter[str] = Counter()
    blocks: list[Block] = []
    text: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal text, linked
        if text:
            words = " ".join(html_lib.unescape("".join(text)).split())
            if words and not node.dead:
                blocks.append(Block(words, node, linked))
        text, linked = [], 0

    def leave(stop: _Node) -> _Node:
        """Close all elements below ``stop``."""
        at = node
        while at is not stop:
            open_[at.name] -= 1
            at = at.up
        return stop

    for m in _TOKEN.finditer(page):
        if (piece := m["text"]) is not None:
            text.append(piece)
            if links:
                linked += len(piece)
            continue
        name = m["name"]
        if name is None or m.end() == len(page) and page[-1] != ">":
            continue  # comments, raw elements, an unfinished tag
        name = name.lower()
        if name == "br":
            text.append(" ")
        if name == "a":
            links = 0 if m["end"] else 1
        if name not in _BLOCK:
            continue
        close()
        if m["end"]:
            if open_[name] > 0:
                at = node
                while at.name != name:
                    at = at.up
                node = leave(at.up)
            links = 0
            continue
        if name in _CLOSE_P and node.name == "p":
            node = leave(node.up)
        for shut in _CLOSES.get(name, ()):
            at = node
            while at.name != shut and at.name in _OPEN:
                at = at.up
            if at.name == shut:
                node = leave(at.up)
        if name not in _VOID:
            node = _start(name, m["attrs"] or "", node, open_["article"] > 0)
            open_[name] += 1
            if (m["attrs"] or "").endswith("/") and name in ("svg", "object", "canvas"):
                node = leave(node.up)
    close()
    return blocks


def score(block: Block) -> float:
    """Log-odds that a block's own text is content, within 2.2 of even."""
    n = len(block.text)
    value = -1.2 + min(3.4, 0.9 * math.log1p(n / 25) + 0.25 * min(len(_SENTENCE.findall(block.text)), 6))
    value -= 3.0 * min(1.0, block.linked / n)
    if block.node.name in _HEADINGS:
        value += 0.4
    elif block.node.name in ("li", "td", "th", "dt", "svg", "canvas"):
        value -= 0.3
    if re.match(r"(?:©|\(c\)|copyright\b)", block.text, re.IGNORECASE):
        value -= 3.0
    return max(-2.2, min(2.2, value))


#: A block's edge to its element by the strength of the marks around it; the
#: strongest outweighs a block's own costs and its neighbours.
_HOLD = (0.8, 1.2, 3.2)
_BESIDE, _NEXT = 0.4, 0.15
#: The first of these where the root is marked: less than what a link costs.
_LOOSE = 1.6


def graph(blocks: list[Block], root: float = 0.0) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """Capacities to source and sink of all nodes, blocks first, and the edges.

    Of the elements, those that hold blocks or bear a mark are nodes, and the
    root, whose own mark is ``root``.  Nodes keep their places, so blocks make one graph."""
    value = [score(b) for b in blocks]
    edges: list[tuple[int, int, float]] = []
    made: list[_Node] = []

    def place(node: _Node) -> int:
        if node.place < 0:
            node.place = len(value)
            value.append(node.mark if node.up is not None else root)
            made.append(node)
        return node.place

    seen = 0
    hold, tie = (_HOLD, (0.8, 2.0, _SURE)) if not root else ((_LOOSE, *_HOLD[1:]), (2.0, 2.0, _SURE))
    for i, block in enumerate(blocks):
        edges.append((i, place(block.node), hold[block.node.grip]))
        if i:
            edges.append((i - 1, i, _BESIDE if block.node.up is blocks[i - 1].node.up else _NEXT))
    while seen < len(made):
        node = made[seen]
        seen += 1
        up, passed = node.up, []
        while up is not None and up.up is not None and not up.mark and up.place < 0:
            passed.append(up)
            up = up.up
        if up is not None:
            at = place(up)
            for x in passed:
                x.place = at  # plain elements on the way are one with the next node
            edges.append((node.place, at, 0.5 if node.mark else tie[node.grip]))
    return [max(0.0, v) for v in value], [max(0.0, -v) for v in value], edges


def label(blocks: list[Block], root: float = 0.0) -> list[bool]:
    """Content or not, by the minimum cut."""
    source, sink, edges = graph(blocks, root)
    return min_cut(source, sink, edges)[: len(blocks)]


def extract(page: str | None) -> str:
    """The main text of a page, one line a block.

    Where the cut leaves nothing, the page is cut again with its root marked as
    content: then short texts count that no other mark or link speaks against."""
    if not page:
        return ""
    blocks = split_blocks(page)
    kept = label(blocks)
    if blocks and not any(kept):
        blocks = split_blocks(page)
        kept = label(blocks, _SURE)
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract_text(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` of ``pages`` and the main text of each row."""
    inner = pages.select(*[F.col(c) for c in keep], F.col(html).alias("__html"))
    fields = inner.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = batch.column(len(fields))
            for a, b in pieces(page, 1 << 22):
                out = pa.array([extract(x) for x in page.slice(a, b - a).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(fields))), out], names=[*(f.name for f in fields), "text"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return inner.mapInArrow(run, f"{kinds}text string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
