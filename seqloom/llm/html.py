"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. A classifier's cost of calling a block content or boilerplate is its
capacity to the two terminals; neighbouring blocks, and consecutive blocks of one parent (but not an advert
with the paragraphs around it), are tied by smoothness edges. The minimum cut, found by maximum flow, labels all blocks of a page together.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Smoothness of neighbouring blocks, and of consecutive blocks under one parent and the same hints.
ADJACENT, SIBLINGS = 0.4, 0.8

# Element names of the HTML standard, by what they do to the text.
SKIPPED = frozenset("head script style template noscript svg iframe object canvas audio video select datalist textarea button title".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same group closes if they are still open.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot", "p"},
}
#: An opening block element ends an open paragraph.
BARRIERS = frozenset("ul ol dl table tr div article section aside nav form body td th main".split())

# The classifier: log-odds of content that ancestors and the text itself add.
BOILERPLATE = {"nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0}
CONTENT = {"article": 6.0, "main": 4.0}
OWN = {"p": 1.5, "h1": 1.5, "h2": 1.0, "h3": 1.0, "h4": 1.0, "pre": 1.5, "blockquote": 1.5, "li": -0.5, "td": 0.0}
#: Words of class, id and role that name boilerplate.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|notice|alert|popup|modal|"
    r"nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|header|masthead|comments?|commentlist|disqus|replies|reply|respond|"
    r"share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|"
    r"widget|copyright|complementary|navigation|contentinfo)(?=$|[\s_-])",
    re.I,
)
HINT_WEIGHT = -12.0
#: Class names that only speak of such parts, like ``has-sidebar`` or ``no-header``.
ABOUT = re.compile(r"(?<![^\s])(?:has|no|not|with|without|hide|show|is)[_-]\S+", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=$|[\s=])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:[!?][^>]*)>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class _Open:
    """An open element: what it and those around it add to a block's score, and the hints among them."""

    __slots__ = ("name", "score", "link", "number", "skipped", "hints", "owner", "parent", "in_article", "around", "held")

    def __init__(self, name, score, link, number, skipped, hints, above):
        self.name, self.score, self.link, self.number, self.skipped = name, score, link, number, skipped
        #: Numbers of the elements that name boilerplate, from the page's root down to this one.
        self.hints = hints
        #: The block element that text in here belongs to, and the number of the element around that.
        self.owner = self if above is None or name in BLOCKS else above.owner
        self.parent = 0 if above is None else above.number if self.owner is self else above.parent
        self.in_article = name in CONTENT or (above is not None and above.in_article)
        #: The content element around a block, this one included, and the characters it holds itself.
        self.around = self if name in CONTENT else above.around if above is not None else None
        self.held = 0


def _hinted(name: str, attributes: str) -> bool:
    if name in ("body", "html", "article", "main"):
        return False
    return any(HINTS.search(ABOUT.sub(" ", " ".join(names))) for names in _NAMES.findall(attributes))


def _score_of(name: str, attributes: str, in_article: bool) -> float:
    score = BOILERPLATE.get(name, 0.0) + CONTENT.get(name, 0.0)
    if name == "header" and not in_article:
        score -= 12.0
    if attributes and HIDDEN.search(attributes):
        score += HINT_WEIGHT
    return score


def blocks_of(html: str) -> list[tuple[str, float, tuple]]:
    """The page's blocks in order: text, log-odds of content, and the parent element with the hints they are under.

    A hint speaks for all that is inside its element. Only if that holds the page's main element, the
    ``main`` or else the ``article`` with the most text, does it speak of the layout and count for nothing.
    """
    found: list[tuple[str, float, int, tuple[int, ...]]] = []
    stack = [_Open("", 0.0, False, 0, False, (), None)]
    opened_names: Counter[str] = Counter()
    content: list[_Open] = []
    parts: list[str] = []
    linked, opened, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            owner = top.owner
            share = linked / max(1, len(text))
            score = owner.score + OWN.get(owner.name, 0.0) + (-3.0 if share > 0.6 else 0.5) + min(2.0, len(text) / 100)
            found.append((text, score, owner.parent, owner.hints))
            if owner.around is not None and owner.hints == owner.around.hints:
                owner.around.held += len(text)
        parts.clear()
        linked = 0

    def close(depth: int) -> None:
        opened_names.subtract(e.name for e in stack[depth:])
        del stack[depth:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1].skipped:
            text = unescape(raw)
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    end = len(html)
    while at < end:
        match = _TAG.search(html, at)
        if match is None:
            add(html[at:])
            break
        add(html[at : match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        if match[1] or match[4]:  # a closing tag closes what is open inside, if its element is open
            if name in BLOCKS and not stack[-1].skipped:
                flush()
            if opened_names[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        attributes = match[3] or match[6] or ""
        if name in VOID:
            if name == "hr" and not stack[-1].skipped:
                flush()
            elif not stack[-1].skipped:
                parts.append(" ")
            continue
        if name in BLOCKS and not stack[-1].skipped:
            flush()
            closes = CLOSES.get(name, {"p"} if name in BARRIERS or name in BLOCKS else ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closes:
                    close(i)
                elif stack[i].name in BARRIERS and stack[i].name not in closes:
                    break
        top = stack[-1]
        if name in RAW:
            ending = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = ending.end() if ending else end
            continue
        if attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        opened += 1
        # a button in running text is text, any other is a part of a form
        skipped = name in SKIPPED and not (name == "button" and opened_names["p"] > 0)
        element = _Open(
            name,
            top.score + _score_of(name, attributes, top.in_article),
            top.link or name == "a",
            opened,
            top.skipped or skipped,
            (*top.hints, opened) if attributes and _hinted(name, attributes) else top.hints,
            top,
        )
        stack.append(element)
        opened_names[name] += 1
        if name in CONTENT:
            content.append(element)
    flush()
    layout: set[int] = set()
    for name in CONTENT:
        elements = [e for e in content if e.name == name and e.held]
        if elements:
            layout.update(max(elements, key=lambda e: e.held).hints)
    return [
        (text, score + HINT_WEIGHT * sum(h not in layout for h in hints), (parent, hints))
        for text, score, parent, hints in found
    ]


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks lie on the content side of the minimum cut.

    Terminal capacities are the positive and negative scores. Flow is pushed along shortest augmenting
    paths from blocks with content capacity left to blocks with boilerplate capacity left. What a
    search without success has reached leads nowhere in later ones either and is not entered again.
    """
    n = len(scores)
    supply, demand = [max(s, 0.0) for s in scores], [max(-s, 0.0) for s in scores]
    neighbours: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, weight in edges:
        neighbours[a][b] = neighbours[a].get(b, 0.0) + weight
        neighbours[b][a] = neighbours[b].get(a, 0.0) + weight
    tiny = 1e-9
    active = deque(i for i in range(n) if supply[i] > tiny)
    spent = [False] * n
    while active:
        source = active[0]
        if spent[source]:
            active.popleft()
            continue
        came, queue, sink = {source: source}, deque([source]), -1
        while queue:
            i = queue.popleft()
            if demand[i] > tiny:
                sink = i
                break
            for j, room in neighbours[i].items():
                if room > tiny and j not in came and not spent[j]:
                    came[j] = i
                    queue.append(j)
        if sink < 0:
            for i in came:
                spent[i] = True
            continue
        flow, j = min(supply[source], demand[sink]), sink
        while j != source:
            flow = min(flow, neighbours[came[j]][j])
            j = came[j]
        j = sink
        while j != source:
            i = came[j]
            neighbours[i][j] -= flow
            neighbours[j][i] += flow
            j = i
        supply[source] -= flow
        demand[sink] -= flow
        if supply[source] <= tiny:
            active.popleft()
    side = [s > tiny for s in supply]
    queue = deque(i for i in range(n) if side[i])
    while queue:
        i = queue.popleft()
        for j, room in neighbours[i].items():
            if room > tiny and not side[j]:
                side[j] = True
                queue.append(j)
    return side


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    edges, last_of = [], {}
    for i, (_, _, parent) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if parent in last_of:
            edges.append((last_of[parent], i, SIBLINGS))
        last_of[parent] = i
    content = min_cut([score for _, score, _ in blocks], edges)
    return "\n".join(text for (text, _, _), kept in zip(blocks, content) if kept)


@F.arrow_udf(StringType())
def _extract(pages: pa.Array) -> pa.Array:
    out = []
    for page in pages:  # one page at a time: a batch may hold very long ones
        out.append(main_text(page.as_py() or ""))
    return pa.array(out, pa.string())


def extract(html: Column) -> Column:
    """The main text of each page: its content blocks, white space inside a block one space, joined by ``\\n``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and comments are
    left out; character references are decoded. Unclosed and unknown tags are tolerated. A null,
    empty or text-free page gives an empty text.
    """
    return _extract(html)
