"""Operator 5, HTML extraction by minimum cut.

A page becomes a list of blocks (texts between block-level tags) under a tree of
elements. A linear classifier looks at each block alone (length, links, end of
sentence, own tag) and at what elements say of themselves (article or main;
boilerplate tags, roles and class names). Its log-odds, as fixed-point numbers, are
the capacities of blocks and elements to the terminals. Smoothness edges tie
neighbours in page order, less the further apart they lie in the tree, and, as
proximity in the DOM, each block to its element and each element to its parent. Being
boilerplate inside content costs more than content beside boilerplate, and a parent's
menus share one tie, so that the number of menus doesn't sink an article. The
minimum cut, found by max-flow (Dinic's level graphs), separates content from
boilerplate: a short line inside an article stays, one between menus goes.

What stands in an element that declares itself boilerplate gets one fixed, high
cost whatever its length, so that long comments don't outvote their container. A
class name doesn't count on an element that holds all the page's articles.

The weights below are fixed parameters; there are no labelled pages to fit on.
A page is read once from left to right; its time grows with its length, not with
what is left open or unquoted in it.

Defined cases: a head ends where a tag or text of the body comes; a button,
select, object or drawing without an end tag is silent up to the next block;
null or empty html gives an empty text; markup that isn't closed,
stray end tags, upper-case tags and unknown entities are taken as they come; a
quote that hides all further ``>`` ends the reading of quotes; a ``<`` after the
last ``>`` is text; scripts, styles, comments and the head never make blocks; very
long pages are read whole; ties in the cut go to boilerplate; repeated rows give
equal results; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import map_batches, type_of

# Names of HTML elements by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head script style noscript template iframe svg math object canvas audio video select textarea button".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TABLE_OR_LIST_PARTS = frozenset("li dt dd tr td th".split())
HEAD_METADATA = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
MAY_STAY_OPEN = SKIPPED - RAW - {"head"}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre li dd td".split())
HINTS = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|captcha|comments?|consent|cookies?|copyright|disclaimer|disqus|footer|gdpr|hidden|legal|login|masthead|menu|modal|navbar|nav|navigation|newsletter|notice|pager|pagination|popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|tags?|toolbar|widget"
)
ARTICLE_HINTS = re.compile(r"comments?|replies|reply|related|promo\w*|advert\w*|sponsor\w*")
LAYOUT = frozenset(
    "a alert area article articles b bar block bottom body box btn button c center class col column container content copy count cta d div field fixed float footer form global group head header "
    "holder icon icons id inner input item items l label large layout left level link links list lists main me message mobile module msg nav navigation new on outer page pages panel placeholder post posts primary r right row "
    "secondary section site slot small sticky sub text thread tile title top tree ul unit up us view wrap wrapper x".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

#: Log-odds of the classifier: of blocks, then of elements; ``boilerplate`` replaces all else, an article is as good as certain to be one, and on pages without one elements go by the words of their own paragraphs.
WEIGHTS = {
    "bias": -1.6, "log_words": 0.55, "sentence": 0.6, "paragraph": 0.4, "heading": 0.3, "list_item": -0.4, "links": -3.5, "outside_article": -2.5,
    "article": 1e6, "boilerplate": -6.0, "own_words": 1.0,
}
#: Capacities of ties: neighbours in page order (halved for every second step between them in the tree), what content pays outside a content element, and what boilerplate blocks and elements pay inside one.
#: Articles stand for themselves, and an element that declares itself boilerplate has no tie to its parent.
ADJACENT, LOOSE_TIE, BLOCK_TIE, ELEMENT_TIE = 0.5, 0.5, 2.0, 2.0
#: Capacities are whole numbers of this fraction, so that cuts are exact.
UNIT = 1 / 256

_ATTRIBUTE = re.compile(r"[^\s=/]+")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"\S*")
_NAME = re.compile(r"/?[a-zA-Z][^\s/><]*")
_QUOTE_OR_END = re.compile(r"[>\"']")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    element: int


@dataclass
class Page:
    """Blocks in page order and the tree of elements; element 0 is the page itself, parents come before children."""

    blocks: list[Block] = field(default_factory=list)
    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    hint: list[str] = field(default_factory=lambda: [""])  # "sure" by tag, "name" by attribute


class _Tags:
    """Tags of a page from left to right, as (start, end, name, closes, attributes), in linear time."""

    def __init__(self, html: str) -> None:
        self.html, self.quotes = html, True
        self.unclosed: set[str] = set()

    def end_of(self, at: int) -> int:
        """Place of the ``>`` that ends the tag at ``at``, or -1."""
        place, ended = at, set()
        while self.quotes:
            m = _QUOTE_OR_END.search(self.html, place)
            if not m:
                self.quotes = False
                break
            place = m.end()
            if m[0] == ">":
                return m.start()
            if m[0] not in ended:
                close = self.html.find(m[0], place)
                if close < 0:
                    ended.add(m[0])
                else:
                    place = close + 1
        return self.html.find(">", at)

    def after_raw(self, tag: str, at: int) -> int:
        """Place after the end tag of the raw element that starts before ``at``, or -1."""
        if tag in self.unclosed:
            return -1
        m = re.compile(f"</{tag}", re.I).search(self.html, at)
        close = self.html.find(">", m.end()) if m else -1
        if close < 0:
            self.unclosed.add(tag)
        return close + 1 if close >= 0 else -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        html = self.html
        while (lt := html.find("<", at)) >= 0:
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                return lt, close + 3 if close >= 0 else len(html), "", False, ""
            if html.startswith(("<!", "<?"), lt):
                close = html.find(">", lt)
                return (lt, close + 1, "", False, "") if close >= 0 else None
            m = _NAME.match(html, lt + 1)
            if m:
                close = self.end_of(m.end())
                if close < 0:
                    return None
                name = m[0].lstrip("/").lower()
                return lt, close + 1, name, m[0][0] == "/", html[m.end() : close]
            at = lt + 1
        return None


def attributes_of(raw: str) -> Iterator[tuple[str, str]]:
    """``(name, value)`` of each attribute, in lower case, read once from left to right; an unclosed quote takes the rest."""
    at = 0
    while m := _ATTRIBUTE.search(raw, at):
        at, value = m.end(), ""
        if equals := _EQUALS.match(raw, at):
            at = equals.end()
            quote = raw[at : at + 1]
            if quote and quote in "\"'":
                close = raw.find(quote, at + 1)
                close = len(raw) if close < 0 else close
                value, at = raw[at + 1 : close], close + 1
            else:
                bare = _BARE.match(raw, at)
                value, at = bare[0], bare.end()
        yield m[0].lower(), value.lower()


def names_boilerplate(name: str, hints: re.Pattern) -> bool:
    """Whether a class or id is made of hints and words of layout alone, so ``related-posts`` but not ``related-work``."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    if parts and parts[0] in ("has", "with", "no", "without"):
        return False
    found = [bool(hints.fullmatch(x)) for x in parts]
    return any(found) and all(f or x in LAYOUT for f, x in zip(found, parts, strict=True))


def _own_hint(tag: str, attributes: str) -> str:
    if tag in BOILERPLATE_TAGS:
        return "sure"
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    for name, value in attributes_of(attributes):
        if name in ("class", "id") and tag not in ("body", "html") and any(names_boilerplate(x, ARTICLE_HINTS if tag in ("article", "main") else HINTS) for x in value.split()):
            return "name"
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "sure"
    return ""


def _closed_starts(html: str) -> set[int]:
    """Where the start tags of MAY_STAY_OPEN lie that have an end tag of their own; a button or select doesn't hold another."""
    found: set[int] = set()
    waiting: dict[str, list[int]] = {}
    tags, at = _Tags(html), 0
    while t := tags.next(at):
        start, at, tag, closes, attributes = t
        if tag in RAW and not closes:
            at = max(at, tags.after_raw(tag, at))
        elif tag in MAY_STAY_OPEN:
            if closes:
                if waiting.get(tag):
                    found.add(waiting[tag].pop())
            elif not attributes.endswith("/"):
                if tag in ("button", "select"):
                    waiting[tag] = []
                waiting.setdefault(tag, []).append(start)
    return found


class _Stack:
    """Open elements as (tag, element, nearest block-level element, skipped), with the depths of each tag and of those that bound implied ends."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self.depths: dict[str, list[int]] = {}
        self.scopes = [0]
        self.outside_html = 0

    def push(self, tag: str, element: int, skipped: bool) -> None:
        self.depths.setdefault(tag, []).append(len(self.open))
        self.outside_html += tag != "html"
        if tag not in INLINE and tag != "p":
            self.scopes.append(len(self.open))
        self.open.append((tag, element, self.open[-1][2] if tag in INLINE else element, skipped))

    def cut(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop()[0]
            self.depths[tag].pop()
            if self.scopes[-1] == len(self.open):
                self.scopes.pop()
            self.outside_html -= tag != "html"

    def depth_of(self, tag: str) -> int:
        """Depth of the innermost open element of a tag, or 0."""
        return self.depths[tag][-1] if self.depths.get(tag) else 0


def read_page(html: str) -> Page:
    page, stack, tags = Page(), _Stack(), _Tags(html)
    pieces: list[str] = []
    linked = 0
    closed: set[int] | None = None
    head = 0  # depth of the open head, or 0
    loose = 0  # depth of the outermost silent element without an end tag, or 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html_lib.unescape("".join(pieces))).strip()
            if text:
                page.blocks.append(Block(text, text.count(" ") + 1, linked, stack.open[-1][2]))
        pieces.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if stack.open[-1][0] == "head" and text.strip():  # only a body holds text
            stack.cut(len(stack.open) - 1)
        if text and not stack.open[-1][3]:
            pieces.append(text)
            if stack.depths.get("a"):
                linked += len(text.split())

    at = 0
    while at < len(html):
        t = tags.next(at)
        put(html[at : t[0] if t else None])
        if not t:
            break
        start, at, tag, closes, attributes = t
        if not tag:
            continue
        inline = tag in INLINE
        if closes:
            depth = stack.depth_of(tag)
            if depth:
                if not inline:
                    flush()
                stack.cut(depth)
            continue
        loose = loose if loose < len(stack.open) else 0
        if tag == "head" and stack.outside_html or tag == "html" and stack.depth_of("html"):
            continue
        head = head if head < len(stack.open) else 0
        if head and tag not in HEAD_METADATA:
            stack.cut(head)
            head = 0
        if loose and (tag in CLOSED_BY_BLOCK or tag in TABLE_OR_LIST_PARTS):
            stack.cut(loose)
            loose = 0
        if tag == "br":
            put("\n")
            continue
        if not inline:
            flush()
        if tag in VOID or attributes.endswith("/") and not inline:
            continue
        if tag in CLOSED_BY_BLOCK or tag in TABLE_OR_LIST_PARTS or tag == "option":
            shut = {"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {"tr", "td", "th"} if tag == "tr" else {"p"}
            within = stack.scopes[-1]  # innermost element that is neither inline nor a paragraph
            if "p" in shut and stack.depth_of("p") > within:
                stack.cut(stack.depth_of("p"))
            elif stack.open[within][0] in shut:
                stack.cut(within)
        if tag in RAW and (after := tags.after_raw(tag, at)) >= 0:
            at = after
            continue
        skipped = stack.open[-1][3]
        if tag in MAY_STAY_OPEN and not loose and not skipped:
            closed = _closed_starts(html) if closed is None else closed
            loose = 0 if start in closed else len(stack.open)
        if tag == "head":
            head = head or len(stack.open)
        page.tag.append(tag)
        page.parent.append(stack.open[-1][1])
        page.hint.append(_own_hint(tag, attributes))
        stack.push(tag, len(page.tag) - 1, skipped or tag in SKIPPED)
    flush()
    return page


def evidence(page: Page) -> tuple[list[float], list[float], list[bool], list[bool]]:
    """Log-odds of being content: of the blocks by themselves, and of the elements; which elements are declared boilerplate; which are in articles."""
    n = len(page.tag)
    articles = [int(t in ("article", "main") and not h) for t, h in zip(page.tag, page.hint, strict=True)]
    held = list(articles)
    for e in range(n - 1, 0, -1):
        held[page.parent[e]] += held[e]
    bad, inside = [False] * n, [False] * n
    for e in range(1, n):
        up, tag = page.parent[e], page.tag[e]
        wraps = held[0] > 0 and held[e] - articles[e] == held[0]  # a class name of a wrapper says little
        bad[e] = bad[up] or page.hint[e] == "sure" or page.hint[e] == "name" and not wraps or tag == "header" and not inside[up]
        inside[e] = inside[up] or articles[e] > 0 and not bad[e]
    some = any(inside)
    of_element = [WEIGHTS["boilerplate"] if bad[e] else WEIGHTS["article"] if inside[e] and articles[e] else 0.0 for e in range(n)]
    of_block, own = [], [0] * n
    for b in page.blocks:
        tag = page.tag[b.element]
        if bad[b.element]:
            of_block.append(WEIGHTS["boilerplate"])
            continue
        score = WEIGHTS["bias"] + WEIGHTS["log_words"] * math.log1p(b.words) + WEIGHTS["links"] * min(1.0, b.linked / b.words)
        score += WEIGHTS["sentence"] * (b.text[-1] in ".!?…»”\"" and b.words > 3)
        score += WEIGHTS["paragraph"] * (tag in ("p", "blockquote", "pre")) + WEIGHTS["heading"] * (tag in HEADINGS) + WEIGHTS["list_item"] * (tag in ("li", "td", "th"))
        of_block.append(score + WEIGHTS["outside_article"] * (some and not inside[b.element]))
        if score > 0:  # an element is judged by the paragraphs that it holds itself
            own[page.parent[b.element] if tag in PARAGRAPHS else b.element] += b.words
    if not some:
        of_element = [x or WEIGHTS["own_words"] * math.log1p(w / 10) for x, w in zip(of_element, own, strict=True)]
    return of_block, of_element, bad, inside


def ties(page: Page, bad: list[bool], inside: list[bool]) -> tuple[list[int], list[tuple[int, int, float, float]]]:
    """``(elements, edges)``: the elements above blocks, numbered after the blocks, and all smoothness edges.

    An edge is (a, b, cost if only a is content, cost if only b is content).
    """
    n = len(page.blocks)
    number: dict[int, int] = {}
    depth = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        depth[e] = depth[page.parent[e]] + 1
    words, linked, menus, blocks = ([0] * len(page.tag) for _ in range(4))
    for b in page.blocks:
        blocks[b.element] += 1
        words[b.element] += b.words
        linked[b.element] += b.linked
    for e in range(len(page.tag) - 1, 0, -1):
        blocks[page.parent[e]] += blocks[e]
        words[page.parent[e]] += words[e]
        linked[page.parent[e]] += linked[e]
        menus[page.parent[e]] += 2 * linked[e] > words[e]
    edges = []

    def tie(e: int) -> None:
        """An element and its parent; menus share one tie, so that their number doesn't sink what stands beside them."""
        up = page.parent[e]
        if page.tag[e] not in ("article", "main") and (bad[up] or not bad[e]):
            share = 1 / menus[up] if 2 * linked[e] > words[e] else blocks[e] if inside[up] else 1  # an article's lists hold by each line
            edges.append((number[e], number[up], LOOSE_TIE, ELEMENT_TIE * share))

    for i, b in enumerate(page.blocks):
        e = b.element
        if e not in number:
            number[e] = n + len(number)
            while e and page.parent[e] not in number:
                up = page.parent[e]
                number[up] = n + len(number)
                tie(e)
                e = up
            if e:
                tie(e)
        edges.append((i, number[b.element], LOOSE_TIE, BLOCK_TIE))
        if i:
            x, y, steps = page.blocks[i - 1].element, b.element, 0
            while x != y and ADJACENT / 2 ** (steps / 2) >= UNIT / 2:  # beyond, the tie is rounded to nothing
                x, y = (page.parent[x], y) if depth[x] >= depth[y] else (x, page.parent[y])
                steps += 1
            beside = ADJACENT / 2 ** (steps / 2)
            edges.append((i - 1, i, beside, beside))
    return list(number), edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float, float]]) -> list[bool]:
    """Labels of least total cost: log-loss of each node, and the capacity of each cut edge."""
    n = len(odds)
    gain = [round(x / UNIT) for x in odds]  # cost of boilerplate less cost of content is the log-odds itself
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, forth, back in edges:
        near[a][b] = near[a].get(b, 0) + round(forth / UNIT)
        near[b][a] = near[b].get(a, 0) + round(back / UNIT)
    side = max_flow_side(gain, near)
    return [i in side for i in range(n)]


def max_flow_side(gain: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (Dinic's algorithm over level graphs)."""
    n = len(gain)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((forth, back))

    for v in range(n):
        if gain[v] > 0:
            arc(s, v, gain[v], 0)
        elif gain[v] < 0:
            arc(v, t, -gain[v], 0)
        for w, c in near[v].items():
            if v < w and (c or near[w][v]):
                arc(v, w, c, near[w][v])
    while True:
        level = [-1] * len(out)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for x in out[a]:
                if cap[x] and level[to[x]] < 0:
                    level[to[x]] = level[a] + 1
                    queue.append(to[x])
        if level[t] < 0:
            return {v for v in range(n) if level[v] >= 0}
        tried = [0] * len(out)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[x] for x in path)
                for k, x in enumerate(path):
                    cap[x] -= flow
                    cap[x ^ 1] += flow
                first = next(k for k, x in enumerate(path) if not cap[x])
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while tried[a] < len(out[a]):
                x = out[a][tried[a]]
                if cap[x] and level[to[x]] == level[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                tried[a] += 1
                continue
            path.append(x)
            a = to[x]


def label_blocks(page: Page) -> tuple[list[bool], list[bool]]:
    """Of each block, whether the cut and whether its own log-odds call it content."""
    of_block, of_element, bad, inside = evidence(page)
    elements, edges = ties(page, bad, inside)
    cut = minimum_cut(of_block + [of_element[e] for e in elements], edges)
    return cut[: len(of_block)], [x > 0 for x in of_block]


def main_text(html: str | None) -> str:
    page = read_page(html or "")
    keep, _ = label_blocks(page)
    return " ".join(b.text for b, k in zip(page.blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield {id_col: b.column(0), url_col: b.column(1), "text": text, "n_chars": [len(t) for t in text]}

    return map_batches(pages.select(F.col(id_col), url_col, html_col), run, f"`{id_col}` {type_of(pages, id_col)}, `{url_col}` string, text string, n_chars long")
