"""Main text of web pages by minimum-cut labelling.

A page becomes a row of blocks. A linear classifier gives each block the log-odds of being content,
from its words, its links and punctuation, and what its elements and their names suggest; the two
losses of that estimate are the capacities of its edges to the terminals. Neighbours in the page,
and blocks of one parent, are joined by edges that cost more the closer they are in the tree. The
minimum cut separates content from boilerplate. The weights are set by hand, as pages carry no
labels. What a name or a form suggests of all that is below it counts only if it does not hold the
page's main prose: a wrapper named for the sidebar beside the article is no sidebar.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, text_of, texts_of

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas audio video select datalist textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
MATHML = frozenset("math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre".split())
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav aside footer form dialog menu head header".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())

# Words of class names and ids: what is seldom anything but boilerplate, what often is, what says nothing, what speaks for content.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense promo promoted promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices popup modal "
    "newsletter subscribe subscription signup sidebar sidenav menu navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus "
    "replies responses more pagination pager".split()
)
DOUBTFUL_WORDS = frozenset("alert banner copyright disclaimer login nav notification overlay reactions recommendations recommended related reply respond search share sharing skip social trending widget widgets".split())
NEUTRAL_WORDS = frozenset("area bar block box container group header holder inner item items js left links list main outer page right row section site slot text thread title top unit view wrap wrapper".split())
GOOD_WORDS = frozenset("article post entry story content body articlebody".split())

#: Log-odds of being content.
PRIOR = 0.6
ARTICLE, OUTSIDE, FAIR = 4.0, -6.0, 2.0
BAD_TAG, BAD_NAME, DOUBTFUL = -12.0, -9.0, -4.0
LINKS, SIGN, ALONE, SENTENCE, KIND, MOST_WORDS = -4.0, -5.0, -1.8, 0.5, 0.5, 2.2
#: What it costs to part two neighbours of one parent, and two blocks of one parent with others between them.
CLOSE, SIBLING = 0.7, 0.3

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A line of rights, as in a page's foot, without a sign.
RIGHTS = re.compile(r"^\W*(?:\(c\)|copyright)\b.{0,40}\b(?:19|20)\d\d\b|^.{0,200}\ball rights reserved\b", re.I)
#: A block of so many characters is prose without punctuation too; an element holds the page's main prose if it has more than this share.
LONG, MOST, MUCH = 80, 0.5, 800
PLAIN = frozenset("div section center".split())
STOP = re.compile(r"[.!?…:;。！？][\"'”’)\]]*$|[,，、] ?\S")


class Element:
    """An element on the way to a block: its parent and depth, what it suggests by itself, and with those above.

    ``own`` is its share of the log-odds, ``fair`` and ``marked`` whether it speaks for content by name or by
    tag; ``lift`` says whether prose may overturn ``own``: "any" prose, that of one "article", or none.
    """

    __slots__ = ("depth", "evidence", "fair", "good", "lift", "marked", "number", "own", "tag", "up")

    def __init__(self, tag: str, number: int, up: Element | None, own: float = 0.0, fair: bool = False, marked: bool = False, lift: str | None = None):
        self.tag, self.number, self.up, self.own, self.fair, self.marked, self.lift = tag, number, up, own, fair, marked, lift
        self.depth = up.depth + 1 if up else 0
        self.evidence, self.good = 0.0, False


ROOT = Element("", 0, None)


class Block:
    """A block of text; ``alone``: short, unlike its neighbours, on a page of much prose that marks no article."""

    __slots__ = ("alone", "linked", "text", "within")

    def __init__(self, text: str, within: Element, linked: int):
        self.text, self.within, self.linked, self.alone = text, within, linked, False


def name_evidence(value: str) -> tuple[float, bool, bool]:
    """What a class name or id suggests, whether it has a word that speaks for content, and whether all it says is boilerplate.

    Each name counts by the share of its words that mean boilerplate, the worst name for all.
    """
    worst, fair, pure = 0.0, False, False
    for name in value.split():
        words = [w for w in NAME.findall(CAMEL.sub("-", name).lower()) if w not in NEUTRAL_WORDS]
        if words:
            says = sum(BAD_NAME if w in BAD_WORDS else DOUBTFUL if w in DOUBTFUL_WORDS else 0.0 for w in words) / len(words)
            if says < worst:
                worst, pure = says, all(w in BAD_WORDS or w in DOUBTFUL_WORDS for w in words)
            fair = fair or not GOOD_WORDS.isdisjoint(words)
    return worst, fair, pure


def entered(tag: str, attributes: str, number: int, up: Element) -> Element:
    """An element below ``up``, with what it suggests by itself."""
    own, fair, role, lift = (BAD_TAG if tag in BAD_TAGS else 0.0), False, "", ("any" if tag == "form" else None)
    for m in ATTRIBUTE.finditer(attributes or ""):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        says, why = 0.0, None
        if key == "role":
            role = value.lower()
            says, why = (BAD_TAG if role in BAD_ROLES else 0.0), ("any" if role == "form" else None)
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            says = DOUBTFUL
        elif key in ("class", "id", "itemprop") and tag not in ("html", "body", "article", "main"):
            says, speaks, pure = name_evidence(value)
            fair, why = fair or speaks, "article" if pure else "any"
        if says < own:
            own, lift = says, why
    return Element(tag, number, up, own, fair, tag in GOOD_TAGS or role in GOOD_TAGS, lift)


def judge(elements: list[Element], blocks: list[Block]) -> None:
    """Evidence of all elements, in page order, from their own and that of those above.

    An element that holds most of the page's prose loses what its name, or being a form, says against
    it, unless an article stands outside of it; one with nothing but boilerplate in its name only
    if a single article or main below it holds that prose. Inside boilerplate an article is a teaser and speaks for nothing.
    """
    prose, whole, marks = [0] * (len(elements) + 1), [0] * (len(elements) + 1), [0] * (len(elements) + 1)
    for b in blocks:
        if len(b.text) >= LONG or STOP.search(b.text):
            prose[b.within.number] += len(b.text) - b.linked
    for e in reversed(elements):
        up = e.up.number
        prose[up] += prose[e.number]
        marks[up] += marks[e.number] + e.marked
        whole[up] = max(whole[up], whole[e.number], prose[e.number] if e.marked else 0)
    least = MOST * prose[0]
    for e in elements:
        i, own = e.number, e.own
        if own < 0 and e.lift and prose[i] > least and marks[i] + e.marked == marks[0] and (e.lift == "any" or whole[i] > least):
            own = 0.0
        e.evidence, e.good = e.up.evidence, e.up.good
        if e.marked:
            if e.evidence > DOUBTFUL and not e.good:
                e.evidence, e.good = e.evidence + ARTICLE, True
        elif e.fair and own == 0.0 and e.evidence == 0.0:
            e.evidence = FAIR
        e.evidence += own
    if marks[0] or prose[0] < MUCH:
        return
    for i, b in enumerate(blocks):
        like = (x for x in blocks[max(0, i - 1) : i + 2] if x is not b)
        if len(b.text) < LONG and b.within.tag in PLAIN:
            b.alone = not any(x.within.tag == b.within.tag and x.within.up is b.within.up for x in like)


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. White space in a block is one space; entities are decoded."""
    out: list[Block] = []
    stack: list[Element] = []
    elements: list[Element] = []
    absent: set[str] = set()  # names that no closing tag ahead has
    depth_of = Counter()
    pieces: list[str] = []
    number = linked = links = 0
    at, end = 0, len(page)

    def close():
        nonlocal linked, links
        if pieces:
            raw = "".join(pieces)
            pieces.clear()
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, stack[-1] if stack else ROOT, min(linked, len(text))))
        linked = links = 0

    def cut(i: int):
        for e in stack[i:]:
            depth_of[e.tag] -= 1
        del stack[i:]

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            piece = page[at:lt]
            pieces.append(piece)
            if links:
                linked += len(piece)
            at = lt
            if at >= end:
                break
        m = TAG.match(page, at)
        if not m:
            pieces.append("<")
            at += 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6]
        if name in RAW:
            if not closing and not (attributes and attributes.endswith("/") and name == "svg"):
                stop = None if name in absent else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if not stop:
                    absent.add(name)
                at = stop.end() if stop else (end if name in ("script", "style", "title", "textarea") else at)
            pieces.append(" ")
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in ("annotation", "annotation-xml"):  # the source of a formula, which no reader sees
            stop = -1 if closing or name in absent else page.find(f"</{name}", at)
            if stop >= 0:
                at = stop
            elif not closing:
                absent.add(name)
            continue
        if name in INLINE or name in MATHML:
            if name == "a":
                links = 0 if closing else 1
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        close()
        if closing:
            if depth_of[name]:
                i = len(stack) - 1
                while stack[i].tag != name:
                    i -= 1
                cut(i)
            continue
        if name in ("html", "body"):
            cut(1 if name == "body" and stack and stack[0].tag == "html" else 0)
        if stack and stack[-1].tag == "head":
            cut(len(stack) - 1)
        if name in CLOSES_P and stack and stack[-1].tag == "p":
            cut(len(stack) - 1)
        if name in HEADINGS and stack and stack[-1].tag in HEADINGS:
            cut(len(stack) - 1)
        for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if stack[i].tag in SAME.get(name, ()):
                cut(i)
                break
            if stack[i].tag in ("ul", "ol", "dl", "table", "div", "select"):
                break
        number += 1
        stack.append(entered(name, attributes, number, stack[-1] if stack else ROOT))
        elements.append(stack[-1])
        depth_of[name] += 1
    close()
    judge(elements, out)
    return out


def log_odds(block: Block, has_article: bool) -> float:
    """The classifier: log-odds of the block being content."""
    e, text = block.within, block.text
    x = PRIOR + e.evidence
    if e.good and e.tag in HEADINGS and e.up.tag in ("header", "hgroup"):
        x -= BAD_TAG  # the heading of the article
    if has_article and not e.good:
        x += OUTSIDE
    x += min(MOST_WORDS, 0.5 * math.log2(1 + text.count(" ") / 10))
    x += LINKS * block.linked / len(text)
    if STOP.search(text):
        x += SENTENCE
    if block.alone:
        x += ALONE
    if e.tag in HEADINGS or e.tag in PROSE:
        x += KIND
    if "©" in text[:40] or RIGHTS.search(text[:300]):
        x += SIGN
    return x


def costs(x: float) -> tuple[float, float]:
    """(cost of content, cost of boilerplate): the logistic losses at log-odds x."""
    return math.log1p(math.exp(-abs(x))) + max(0.0, -x), math.log1p(math.exp(-abs(x))) + max(0.0, x)


def closeness(a: Element, b: Element) -> float:
    """The share of two elements' ways from the root that is common, up to their parents."""
    a, b = a.up or a, b.up or b
    most = max(a.depth, b.depth)
    while a.depth > b.depth:
        a = a.up
    while b.depth > a.depth:
        b = b.up
    while a is not b and a.up:
        a, b = a.up, b.up
    return (1 + a.depth) / (1 + most) if a is b else 0.0


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between a block and the one before it of the same parent."""
    edges = [(i, i + 1, CLOSE * closeness(blocks[i].within, blocks[i + 1].within)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = (b.within.up or b.within).number
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def minimum_cut(first: list[float], second: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the side where ``first`` is paid; the labelling of least total cost.

    Nodes whose own preference outweighs all their edges are settled first and charge their
    neighbours, which is exact; what is left falls into small parts, each solved by augmenting paths.
    """
    n = len(first)
    pull = [s - f for f, s in zip(first, second, strict=True)]  # positive: the first label is cheaper
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(pull[i]) < sum(near[i].values()) or (pull[i] == 0 and near[i]):
            continue
        label[i] = pull[i] > 0
        for j, w in near[i].items():
            pull[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    for start in range(n):
        if label[start] is not None:
            continue
        part, ahead = [start], deque([start])
        seen = {start}
        while ahead:
            for j in near[ahead.popleft()]:
                if j not in seen:
                    seen.add(j)
                    part.append(j)
                    ahead.append(j)
        left = {i: max(0.0, pull[i]) for i in part}  # from the terminal of the first label
        right = {i: max(0.0, -pull[i]) for i in part}
        while True:
            back: dict[int, int | None] = {i: None for i in part if left[i] > 1e-12}
            ahead, goal = deque(back), None
            while ahead:
                i = ahead.popleft()
                if right[i] > 1e-12:
                    goal = i
                    break
                for j, w in near[i].items():
                    if w > 1e-12 and j not in back:
                        back[j] = i
                        ahead.append(j)
            if goal is None:
                break
            way, i = [goal], goal
            while back[i] is not None:
                i = back[i]
                way.append(i)
            flow = min(left[i], right[goal], *(near[way[k + 1]][way[k]] for k in range(len(way) - 1)))
            left[i] -= flow
            right[goal] -= flow
            for k in range(len(way) - 1):
                near[way[k + 1]][way[k]] -= flow
                near[way[k]][way[k + 1]] += flow
        for i in part:
            label[i] = i in back
    return [bool(x) for x in label]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    marked = any(b.within.good for b in blocks)
    price = [costs(log_odds(b, marked)) for b in blocks]
    keep = minimum_cut([c for c, _ in price], [b for _, b in price], smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def _extract(batches):
    for batch in batches:
        texts = [main_text(text_of(raw)) for raw in texts_of(batch, "html")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column_of(batch, "page_id"), pa.int64()), batch.column(batch.schema.get_field_index("url")).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; others ignored).

    Null or empty html, and pages without content, give an empty text. Bytes that are not UTF-8 are
    read as U+FFFD. Repeated rows each return a row; null ids and addresses stay null.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
