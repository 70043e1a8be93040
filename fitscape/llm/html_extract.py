"""Main text of web pages by a tree-structured graphical model.

Each element that forms a block, or bears a class, id or role, is a node with a hidden label: its own text is main text,
or it isn't. A node's potential comes from its tag, the key words of its attributes, the length of its text, the linked
share of its own and its subtree's text and the share of the page's text in its subtree; an edge's potential from the labels of parent and child, by the kind of parent. Sum-product messages up and down the tree
give each node's marginal. All potentials are counted on labelled pages. Text outside any block is a node of its own, so pages
without markup have one; an inline element with a marginal of its own (an advert in a paragraph) leaves its block by itself.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.llm.labelled_pages import LABELLED_PAGES
from fitscape.llm.shared import small_slices

# fixed values: elements of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("head title script style noscript template iframe svg math object select option button textarea canvas audio video datalist".split())
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li legend "
    "main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul search".split()
)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body table td th caption ul ol dl div article section main aside nav header footer form blockquote".split())
_ENDS_P = _BLOCK - frozenset("html body dd dt li td th tr tbody thead tfoot caption legend summary figcaption".split())
_KEYS = {
    "ad": "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion".split(),
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar tabs".split(),
    "edge": "header footer sidebar aside masthead imprint copyright widget".split(),
    "notice": "cookie cookies consent notice notices banner alert popup modal overlay gdpr".split(),
    "reader": "comment comments reply replies respond disqus discussion".split(),
    "form": "form search login signup subscribe newsletter".split(),
    "share": "share sharing social related recommended popular tags".split(),
    "text": "article content post entry main story text body".split(),
}
_KEY_OF = {word: key for key, words in _KEYS.items() for word in words}
_ROLES = {"navigation": "menu", "banner": "edge", "contentinfo": "edge", "complementary": "edge", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "main": "text", "article": "text"}

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|title|select|canvas|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<(?:[a-zA-Z/!?][^>]*)?\Z""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|main)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_LETTERS = re.compile(r"[a-z]+")
#: Elements whose loose text is a node of its own.
_FRAME = ("#page", "html", "body")


@dataclass
class Page:
    """Nodes in page order (0 is the page itself): tag, parent, key words, characters, linked characters; and blocks: lists of (node, source text)."""

    tags: list[str]
    parents: list[int]
    keys: list[tuple[str, ...]]
    size: list[int]
    linked: list[int]
    main: list[bool]
    above: list[tuple[str, ...]]  # key words of the elements around, but for those of text
    parts: list[list[tuple[int, str]]]

    @property
    def blocks(self) -> list[tuple[int, str]]:
        """The node and the text of each block; the node is that of the block's first part."""
        return [(parts[0][0], _plain(parts)) for parts in self.parts]


def _plain(parts: list[tuple[int, str]]) -> str:
    return " ".join(html.unescape("".join(x for _, x in parts)).split())


def _keys(attributes: str) -> tuple[tuple[str, ...], bool]:
    keys, main = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "main":
            main = True
        elif name.lower() == "role":
            keys.add(_ROLES.get(value, ""))
        else:
            keys.update(_KEY_OF.get(w, "") for w in _LETTERS.findall(value))
    return tuple(sorted(keys - {""})), main


def parse(source: str) -> Page:
    page = Page(["#page"], [-1], [()], [0], [0], [False], [()], [])
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements: tag, node that holds their text
    places: dict[str, list[int]] = defaultdict(lambda: [0])  # of the open elements of each tag, and of all blocks
    blocks = [0]
    parts: list[tuple[int, str]] = []
    loose: dict[int, bool] = {}  # whether a frame's loose text is labelled
    hidden = links = alone = 0

    def flush() -> None:
        nonlocal alone
        if parts:
            if any(not x.isspace() for _, x in parts):
                page.parts.append(parts.copy())
            parts.clear()
        alone = 0

    def add(tag: str, up: int, keys: tuple[str, ...], main: bool) -> int:
        page.tags.append(tag), page.parents.append(up), page.keys.append(keys)
        page.above.append(tuple(sorted({*page.above[up], *page.keys[up]} - {"text"})) if page.keys[up] else page.above[up])
        page.size.append(0), page.linked.append(0), page.main.append(main)
        return len(page.tags) - 1

    def say(raw: str) -> None:
        nonlocal alone
        if hidden or not raw:
            return
        node = stack[-1][1]
        if raw.isspace():
            parts.append((parts[-1][0], " ")) if parts else None
            return
        if page.tags[node] in _FRAME:
            alone = alone or add("#text", node, (), loose.get(node, False))
            node = alone
        page.size[node] += len(raw)
        page.linked[node] += len(raw) if links else 0
        parts.append((node, raw))

    def close(upto: int) -> None:
        nonlocal hidden, links
        while len(stack) > upto:
            tag, _ = stack.pop()
            places[tag].pop()
            if tag in _BLOCK:
                blocks.pop()
            hidden -= tag in _UNSEEN
            links -= tag == "a"

    at = 0
    for m in _MARKUP.finditer(source):
        say(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            k = places[tag][-1]
            if k and (tag in _BLOCK or k > blocks[-1]):
                if tag in _BLOCK:
                    flush()
                close(k)
            continue
        if tag in _BLOCK:
            flush()
        ends = _CLOSES.get(tag, ()) or (("p",) if tag in _ENDS_P else ())
        while ends:
            k = max(places[x][-1] for x in ends)
            if k <= max((places[x][-1] for x in _SCOPE if x not in ends), default=0):
                break
            close(k)
            if tag != "tr":
                break
        if tag in _VOID:
            if tag in ("br", "wbr", "hr", "img", "input"):
                parts.append((parts[-1][0], " ")) if parts and tag != "wbr" else None
            continue
        keys, main = _keys(m[4]) if m[4] else ((), False)
        node = stack[-1][1]
        if tag in _BLOCK or keys:
            node = add(tag, node, keys, main and tag not in _FRAME)
            loose[node] = main
        places[tag].append(len(stack))
        if tag in _BLOCK:
            blocks.append(len(stack))
        stack.append((tag, node))
        hidden += tag in _UNSEEN
        links += tag == "a"
    say(source[at:])
    flush()
    return page


def _share(part: int, whole: int) -> str:
    return "none" if not part else "few" if part <= 0.1 * whole else "some" if part <= 0.6 * whole else "most"


def _measures(page: Page) -> list[tuple[str, str, str, str]]:
    """For each node: length of its text, linked share of it, and of its subtree's; the subtree's share of the page."""
    size, linked = page.size.copy(), page.linked.copy()
    for i in range(len(size) - 1, 0, -1):
        size[page.parents[i]] += size[i]
        linked[page.parents[i]] += linked[i]
    return [
        ("none" if not n else "short" if n < 25 else "line" if n < 100 else "long", "none" if not n else "most" if a > 0.6 * n else "few", "none" if not m else "most" if b > 0.6 * m else "few", _share(m, size[0]))
        for n, a, m, b in zip(page.size, page.linked, size, linked, strict=True)
    ]


def _features(page: Page, i: int, measures: tuple[str, str, str, str]) -> list[str]:
    bare = ["bare:" + page.tags[i]] if page.tags[i] in ("article", "main") and not page.keys[i] else []
    place = ["under:" + _kind(page, page.parents[i]) + ":" + page.tags[i]] if i else []
    named = [f"{name}:{value}" for name, value in zip(("size", "links", "below", "share"), measures, strict=True)]
    return [*bare, *place, "tag:" + page.tags[i], *named, *("key:" + k for k in page.keys[i]), *("within:" + k for k in page.above[i])]


def _kind(page: Page, i: int) -> str:
    """Of a parent: the page's frame, an article that may hold other things, or any other element."""
    if page.tags[i] in _FRAME and not page.keys[i]:
        return "frame"
    return "article" if page.tags[i] in ("article", "main") or "text" in page.keys[i] else "inner"


@dataclass
class TreeModel:
    node: dict[str, tuple[float, float]]
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    prior: tuple[float, float]

    def _own(self, page: Page, i: int, measures: tuple[str, str, str, str] | None = None) -> tuple[float, float]:
        a, b = self.prior
        for f in _features(page, i, measures or _measures(page)[i]):
            x = self.node.get(f)
            if x:
                a, b = a * x[0], b * x[1]
        s = a + b
        return a / s, b / s

    def marginals(self, page: Page) -> list[float]:
        """Probability of main text for each node: messages from the leaves up, then from the page down."""
        n = len(page.tags)
        cache: dict[tuple, tuple[float, float]] = {}
        belief = []
        for i, measures in enumerate(_measures(page)):
            key = (page.tags[i], page.keys[i], page.above[i], _kind(page, page.parents[i]) if i else "", measures)
            if key not in cache:
                cache[key] = self._own(page, i, measures)
            belief.append(cache[key])
        edges = [self.edge[_kind(page, i)] for i in range(n)]
        up = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            p = page.parents[i]
            ((a, b), (c, d)), (x, y) = edges[p], belief[i]
            u, v = a * x + b * y, c * x + d * y
            up[i] = (u / (u + v), v / (u + v))
            s, t = belief[p][0] * up[i][0], belief[p][1] * up[i][1]
            belief[p] = (s / (s + t), t / (s + t))
        for i in range(1, n):
            p = page.parents[i]
            ((a, b), (c, d)), (s, t) = edges[p], belief[p]
            s, t = s / up[i][0], t / up[i][1]
            x, y = belief[i][0] * (s * a + t * c), belief[i][1] * (s * b + t * d)
            belief[i] = (x / (x + y), y / (x + y))
        return [y for _, y in belief]


def train_tree_model(pages: list[str] = LABELLED_PAGES, smoothing: float = 0.2) -> TreeModel:
    """Potentials by smoothed counts over labelled pages (a few; held on the driver)."""
    seen, edges, labels = Counter(), Counter(), Counter()
    for source in pages:
        page = parse(source)
        measures = _measures(page)
        for i in range(1, len(page.tags)):
            y = page.main[i]
            labels[y] += 1
            edges[_kind(page, page.parents[i]), page.main[page.parents[i]], y] += 1
            for f in _features(page, i, measures[i]):
                seen[f, y] += 1
    features = {f for f, _ in seen}
    node = {f: tuple((seen[f, y] + smoothing) / (labels[y] + 2 * smoothing) for y in (False, True)) for f in features}
    edge = {
        k: tuple(tuple((edges[k, p, y] + smoothing) / (edges[k, p, False] + edges[k, p, True] + 2 * smoothing) / ((labels[y] + 1) / (labels[False] + labels[True] + 2)) for y in (False, True)) for p in (False, True))
        for k in ("frame", "article", "inner")
    }
    total = labels[False] + labels[True]
    return TreeModel(node, edge, ((labels[False] + 1) / (total + 2), (labels[True] + 1) / (total + 2)))


def main_text(source: str, model: TreeModel) -> str:
    page = parse(source)
    if not page.parts:
        return ""
    belief = model.marginals(page)
    texts = (_plain([x for x in parts if belief[x[0]] > 0.5]) for parts in page.parts)
    return "\n\n".join(x for x in texts if x)


def extract(pages: DataFrame, model: TreeModel, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text (blocks of main text joined by two line ends), n_chars.

    White space in a block is one space; line breaks inside a block are white space. A marginal of exactly 0.5 isn't main
    text; very long pages are read whole, in a slice of their own. A null or empty page has the text
    ''; null ids and urls stay; broken or cut markup is read as far as it goes; repeated rows each get their row; an empty
    table gives none; extra columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("_html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in small_slices(batches, "_html"):
            texts = [main_text(x.decode(errors="replace"), shared.value) for x in sources]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
