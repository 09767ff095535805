"""Main text of web pages by minimum-cut labelling of text blocks.

A page is cut into blocks of text at block-level tags. A linear classifier gives each block a log-odds of being content:
from its text, and from what the element around it is called (tag, and words in class, id and role). That is the capacity
from the source (content) or to the sink (boilerplate); a name alone costs 2 before anything is fitted, no more than good
prose gains. Smoothness edges join neighbouring blocks, the weaker the farther apart they are in the tree, and blocks of the
same parent element, so an odd block follows its surroundings. An element that is called an article is a node of its own,
with a capacity, and an edge to each of its blocks: short lines and headings, which the classifier by itself would drop, stay
with the article. The minimum cut of that graph labels the blocks. Only scripts, styles, fallback content and what is hidden
is left out before.

What elements are called is evidence, not a verdict: where a page has no article outside of elements that are called
boilerplate, the share of its prose that such an element holds speaks against the name (``alone``).

Costs start from ``PRIOR`` and are fitted by co-training on a bounded sample of pages (``max_pages`` pages and ``max_bytes``
bytes, in hash order), some rounds of two steps. The weights of the text learn from the labels of the whole graph, by a
logistic regression on the text alone with a penalty centred on the prior. The cost of each name learns from a cut that
knows neither names nor articles: from the share of the name's text, page by page, that this leaves with the content, with
``strength`` pages of the prior, within ``NAME_RANGE``: prose can't tell a reader's comment from an article, so it takes
nothing from the cost of a name. The penalty is high, as a classifier that learns all that the cut says leaves it nothing to
say on pages of another kind. Without pages the prior stands.

Defined cases: null html is empty and has an empty text; broken markup never fails (unclosed tags end with the page, a tag
cut off by its end is dropped), and takes time in proportion to the page; white space is what str.split() takes for it;
repeated rows give repeated results; an empty table gives an empty result; other columns pass through, one named ``text``
is replaced.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: HTML element names -------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg annotation annotation-xml select datalist audio video canvas object".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that hold no article text, and those that hold the article.
NOT_TEXT = frozenset("nav footer aside form button menu dialog search fieldset head".split())
ARTICLE = frozenset("article main".split())
#: Elements that never stand around an article.
NEVER = frozenset("nav footer menu button search head".split())
# --- Words in class, id and role that name a part of a page ----------------------------------------------------------
NAMES = {
    "off": "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar sidenav topbar toolbar masthead banner contentinfo complementary search pagination pager cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe signup login ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted comment comments commentlist reply replies respond disqus discussion related recommended share sharing social widget widgets skip tagcloud copyright disclaimer paywall".split(),
    "on": "article content main body post entry story text maincontent articlebody postcontent entrycontent".split(),
}
OFF, ON = frozenset(NAMES["off"]), frozenset(NAMES["on"])
#: Of those, the words that are believed of an article or main element itself.
NO_ARTICLE = frozenset("ad ads comment comments related replies reply promo promoted sponsored".split())
#: Before a word they say that a page has, or hasn't, such a part elsewhere.
MODIFIERS = frozenset("has have no not with without hide hidden".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z|[^<]+|<""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(\bhidden\b)""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

TEXT = ("bias", "length", "links", "sentence", "paragraph", "heading", "item", "cell", "short", "upper")
#: What an element is called, by word: the tags and names of boilerplate.
CALLED = tuple(sorted(OFF | NOT_TEXT | {"header"}))
FEATURES = (*TEXT, "outer_off", "alone", *CALLED)
COLUMN = {c: len(TEXT) + 2 + i for i, c in enumerate(CALLED)}
#: Log-odds of content where nothing has been fitted, and between what the cost of a name may be fitted.
PRIOR = np.array([-0.9, 0.45, -5.0, 0.8, 0.8, 0.8, 0.0, -0.2, -0.3, -0.3, -2.0, 2.0, *[-2.0] * len(CALLED)])
NAME_RANGE = (-4.0, -2.0)
#: Capacity of an element that is an article by its tag or its name, and of the edge between it and each of its blocks.
HOME_TAG, HOME_NAME, TIE = 2.0, 1.5, 1.0
#: Smoothness: of blocks of one element that follow each other (divided by one more than the steps between their elements
#: in the tree, where they are others), and of blocks of one parent. Only a part of it where an element begins or ends that
#: is called boilerplate.
ADJACENT, SIBLING, BORDER = 2.4, 0.5, 0.25
#: The nearest element around a block that says what it is.
OFF_TAG, OFF_NAME, NOTHING, ON_NAME, ON_TAG = -2, -1, 0, 1, 2


class Block:
    __slots__ = ("called", "element", "home", "kind", "link", "outer", "parent", "region", "tag", "text")

    def __init__(self, text: str, link: int, tag: str = "", element: int = 0, parent: int = 0, kind: int = NOTHING, outer: bool = False, region: int = -1, home: int = -1, called: tuple[str, ...] = ()):
        self.text, self.link, self.tag, self.element, self.parent, self.kind, self.outer, self.region, self.home, self.called = text, link, tag, element, parent, kind, outer, region, home, called


class Open:
    """An open element: its name, what is known of the text in it, and its nearest block-level element (number, tag, the number of that one's parent)."""

    __slots__ = ("called", "element", "hidden", "home", "kind", "name", "outer", "parent", "region", "tag")

    def __init__(self, name: str, above: Open | None):
        self.name = name
        self.element, self.tag, self.parent = (above.element, above.tag, above.parent) if above else (0, "", 0)
        self.kind, self.outer, self.region, self.hidden = (above.kind, above.outer, above.region, above.hidden) if above else (NOTHING, False, -1, False)
        self.home, self.called = (above.home, above.called) if above else (-1, ())


def _names(attrs: str) -> tuple[set[str], bool]:
    """The words in class, id and role, but for those behind a modifier; whether the element is hidden."""
    words: set[str] = set()
    for m in ATTR.finditer(attrs):
        if m[5]:
            return words, True
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                before = ""
                for w in map(str.lower, PART.findall(token)):
                    if before not in MODIFIERS:
                        words.add(w)
                    before = w
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.lower() == "true" or name == "hidden":
            return words, True
    return words, False


def _judge(at: Open, attrs: str, in_article: bool, number: int) -> None:
    """What an element's tag and attributes say of the text in it."""
    name = at.name
    words, hidden = _names(attrs) if attrs and name not in ("a", "html", "body") else (set(), False)
    at.hidden |= hidden
    off = words & (NO_ARTICLE if name in ARTICLE else OFF)
    if off and name not in NEVER:
        at.kind, at.region, at.called = OFF_NAME, number, tuple(sorted(off))
    elif name in NOT_TEXT or name == "header" and not in_article:
        at.kind, at.region, at.called = OFF_TAG, -1 if name in NEVER else number, (name,)
    elif name in ARTICLE:
        at.outer |= at.kind < 0
        at.kind, at.home, at.called = ON_TAG, number, ()
    elif words & ON and at.kind == NOTHING:
        at.kind, at.home = ON_NAME, number


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The page's blocks, and the parent of each block-level element by number (of a lower number)."""
    out: list[Block] = []
    stack = [Open("", None)]
    open_names: Counter[str] = Counter()
    parents = [0]
    buffer: list[str] = []
    links, at, end = 0, 0, len(page)

    def flush():
        nonlocal links
        if buffer:
            e = stack[-1]
            text = "" if e.hidden else " ".join(html_lib.unescape("".join(buffer)).split())
            if text:
                out.append(Block(text, links, e.tag, e.element, e.parent, e.kind, e.outer, e.region, e.home, e.called))
            buffer.clear()
        links = 0

    def close(depth: int):
        if any(e.name in BLOCK for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            open_names[e.name] -= 1
        del stack[depth:]

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            t = m[0]
            if t[0] != "<" or t == "<":
                buffer.append(t)
                if open_names["a"] > 0:
                    links += len(t.strip())
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if open_names[name] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if name in RAW:
            if attrs.endswith("/") and name == "svg":
                continue
            found = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = found.end() if found else end
            if name not in ("svg", "select", "annotation", "annotation-xml"):
                buffer.append(" ") if name in ("iframe", "video", "object", "textarea", "canvas", "audio") else None
            continue
        if name in BLOCK:
            # what a new block ends by itself: an open paragraph, and open siblings of its kind
            ends = CLOSES.get(name, frozenset()) | {"p"}
            if any(open_names[n] > 0 for n in ends):
                inside = SCOPE.get(name, ())
                for i in range(len(stack) - 1, 0, -1):
                    n = stack[i].name
                    if n in ends:
                        close(i)
                        break
                    if n in inside or n in BLOCK and name not in CLOSES or n in ("table", "article", "body"):
                        break
            flush()
        new = Open(name, stack[-1])
        if name in BLOCK:
            new.element, new.tag, new.parent = len(parents), name, new.element
            parents.append(new.parent)
        _judge(new, attrs, open_names["article"] > 0 or open_names["main"] > 0, new.element)
        stack.append(new)
        open_names[name] += 1
    flush()
    return out, parents


def features(block: Block, alone: float = 0.0) -> list[float]:
    n = len(block.text)
    letters = sum(map(str.isupper, block.text))
    out = [
        1.0, min(np.log1p(n), 7.0) - 3.0, min(1.0, block.link / n), float(block.text[-1] in ".!?…。\"'”»:"), float(block.tag in ("p", "blockquote", "pre")),
        float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(block.tag in ("li", "dt", "dd")), float(block.tag in ("td", "th", "caption")), float(n < 20), float(letters > 0.6 * n),
        float(block.outer), alone, *[0.0] * len(CALLED),
    ]
    for c in block.called:  # several words share one cost
        out[COLUMN[c]] = 1 / len(block.called)
    return out


def page_features(blocks: list[Block]) -> np.ndarray:
    """The features of a page's blocks. ``alone``: where nothing outside of elements called boilerplate is in an article (or
    the like), the share of the page's text without links that the element around the block holds, from 0.8 on."""
    size = [max(0, len(b.text) - b.link) for b in blocks]
    total, held = sum(size), Counter()
    for b, n in zip(blocks, size):
        held[b.region] += n
    free = any(n and b.kind > 0 and b.region < 0 for b, n in zip(blocks, size))
    share = {r: n / total for r, n in held.items() if r >= 0 and not free and 10 * n >= 8 * total > 0}
    return np.array([features(b, share.get(b.region, 0.0)) for b in blocks])


def _across(a: Block, b: Block) -> float:
    return BORDER if a.region != b.region or (a.kind < 0) != (b.kind < 0) else 1.0


def edges_of(blocks: list[Block], parents: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness edges: of each block to the next, by their distance in the tree, and to the next of the same parent."""
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            x, y, steps = blocks[i - 1].element, b.element, 0
            while x != y:  # a parent has a lower number; all walks together pass each element twice
                x, y, steps = (parents[x], y, steps + 1) if x > y else (x, parents[y], steps + 1)
            edges.append((i - 1, i, ADJACENT / (1 + steps) * _across(blocks[i - 1], b)))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING * _across(blocks[last[b.parent]], b)))
        last[b.parent] = i
    return edges


def homes_of(blocks: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The elements that are called articles, as nodes behind those of the blocks: their gains, and edges to their blocks."""
    number: dict[int, int] = {}
    gains, edges = [], []
    for i, b in enumerate(blocks):
        if b.kind > 0:
            if b.home not in number:
                number[b.home] = len(blocks) + len(gains)
                gains.append(HOME_TAG if b.kind == ON_TAG else HOME_NAME)
            edges.append((i, number[b.home], TIE))
    return gains, edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: content) of least cost: -gain where a node with gain > 0 is off or one below 0 is on, plus cut edges.

    A node whose own gain outweighs all its edges has its label in some optimum; such nodes are taken out first, their
    edges becoming gains of the others. Maximum flow settles the rest.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                gain[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, on in zip(left, _flow([gain[i] for i in left], [{left.index(j): w for j, w in near[i].items()} for i in left] if len(left) < 64 else _renumbered(left, near))):
            label[i] = on
    return label


def _renumbered(left: list[int], near: list[dict[int, float]]) -> list[dict[int, float]]:
    place = {i: k for k, i in enumerate(left)}
    return [{place[j]: w for j, w in near[i].items()} for i in left]


def _flow(gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Shortest augmenting paths with levels; true: still reachable from the source."""
    n, tiny = len(gain), 1e-9
    source, sink = n, n + 1
    left: list[dict[int, float]] = [dict(x) for x in near] + [{}, {}]
    for i, g in enumerate(gain):
        if g > 0:
            left[source][i], left[i][source] = g, 0.0
        elif g < 0:
            left[i][sink] = -g
            left[sink][i] = 0.0
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in left[u].items():
                if c > tiny and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        ways = [iter(list(x)) for x in left]
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(left[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    left[a][b] -= push
                    left[b][a] = left[b].get(a, 0.0) + push
                cut = next(k for k in range(len(path) - 1) if left[path[k]][path[k + 1]] <= tiny)
                del path[cut + 1 :]
                continue
            for v in ways[u]:
                if left[u][v] > tiny and level[v] == level[u] + 1:
                    path.append(v)
                    break
            else:
                level[u] = -2
                path.pop()


def _labels(blocks: list[Block], gain: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    gains, ties = homes_of(blocks)
    return minimum_cut(gain.tolist() + gains, edges + ties)[: len(blocks)]


def label(page: str | None, weights: np.ndarray) -> tuple[list[Block], np.ndarray, list[bool]]:
    """A page's blocks, their features, and which of them the minimum cut leaves with the content."""
    blocks, parents = blocks_of(page or "")
    if not blocks:
        return [], np.zeros((0, len(FEATURES))), []
    x = page_features(blocks)
    return blocks, x, _labels(blocks, x @ weights, edges_of(blocks, parents))


def extract(page: str | None, weights: np.ndarray) -> str:
    blocks, _, on = label(page, weights)
    return " ".join(b.text for b, keep in zip(blocks, on) if keep)


def _fitted_text(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of the text: a logistic regression with a penalty on what differs from PRIOR, by Newton steps."""
    centre = PRIOR[: len(TEXT)]
    x, w = x[:, : len(TEXT)], centre.copy()
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) * (1000 / len(y)) + penalty * (w - centre)
        hess = (x * (p * (1 - p))[:, None]).T @ x * (1000 / len(y)) + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fitted_names(pages: list[tuple[list[Block], np.ndarray, list]], weights: np.ndarray, strength: float) -> np.ndarray:
    """Costs of the names, from cuts by the text alone: a page's share of a name's text that stays is the page's vote."""
    votes = np.zeros((2, len(CALLED)))
    for blocks, x, edges in pages:
        on = minimum_cut((x[:, : len(TEXT)] @ weights[: len(TEXT)]).tolist(), edges)
        size = np.array([len(b.text) for b in blocks])[:, None] * x[:, len(TEXT) + 2 :]
        total = size.sum(0)
        share = size[np.array(on, bool)].sum(0) / np.maximum(total, 1e-9)
        votes += np.where(total > 0, [share, 1 - share], 0.0)
    centre = PRIOR[len(TEXT) + 2 :]
    prior = strength / (1 + np.exp(-centre))
    return np.clip(np.log((votes[0] + prior) / (votes[1] + strength - prior)), *NAME_RANGE)


def fit_weights(pages: DataFrame, max_pages: int = 400, max_bytes: int = 1 << 23, penalty: float = 6000.0, strength: float = 20.0, rounds: int = 3) -> np.ndarray:
    """PRIOR, fitted by co-training on a sample of at most ``max_pages`` pages and ``max_bytes`` bytes."""
    hashed = pages.select("html", F.xxhash64("html").alias("h"), F.octet_length("html").alias("n")).filter("n > 0")
    # the least hashes first, as many as fit; then their pages: what tasks send does not grow with their number
    least = hashed.select("h", "n").groupBy("h").agg(F.max("n").alias("n")).orderBy("h").limit(max_pages)
    upto, last = 0, None
    for r in least.collect():  # two numbers for each of max_pages pages
        upto += r.n
        if upto > max_bytes:
            break
        last = r.h
    w = PRIOR.copy()
    if last is None:
        return w
    some = [r.html for r in hashed.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()]
    found = [(blocks, page_features(blocks), edges_of(blocks, parents)) for blocks, parents in map(blocks_of, some) if blocks]
    for _ in range(rounds if found else 0):
        y = np.concatenate([np.array(_labels(blocks, x @ w, edges), float) for blocks, x, edges in found])
        if 0 < y.sum() < len(y):
            w[: len(TEXT)] = _fitted_text(np.concatenate([x for _, x, _ in found]), y, penalty)
        w[len(TEXT) + 2 :] = _fitted_names(found, w, strength)
    return w


def extract_text(pages: DataFrame, weights: np.ndarray = PRIOR) -> DataFrame:
    """pages with a column ``text``: the main text of the column html."""
    weights = np.asarray(weights)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series([extract(h, weights) for h in x], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pages.withColumn("text", F.pandas_udf(run, "string")(F.col("html")))
