"""Main text of web pages by tag-path ratios.

A page is read once into its text nodes in order, each with its root-to-leaf tag path. Per path the
length of its text outside links and its punctuation are added up over the page; the ratio of a path is
text per node times punctuation per node, on a logarithmic scale. Three steps then pick the content:

* smooth: the ratios, as a series over the nodes in page order, get a Gaussian of three taps, so that
  a short paragraph between long ones is lifted and a long caption in a menu is not; a path's score is
  the mean of its nodes;
* fuse: a node's score is joined with that of the path it lies in: the mean, by length, of the scores right
  below that path, or a little less than that of the path above, whichever is more. So a heading or a
  list item among paragraphs is lifted, and a paragraph among links is not;
* threshold: nodes whose fused score reaches ``LEVEL`` of the page's mean, by length and prior, are content.

Tags, roles and words of class or id are priors, factors of the fused score: menus, footers, adverts,
reader comments and the like count little, words that also occur in articles do so outside an article
only, and beside an article or main element all else counts less. Scripts, styles and the like have no text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by
one space. Pages are independent: one pass inside Arrow batches, no shuffle.

Defined results: null or empty html, or a page without content, gives an empty text and 0 characters.
Repeated rows each give their row. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import pieces, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: A start tag of the key ends an open element of these names (end tags left out).
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"),
}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas select button textarea audio video".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
_WORDS = r"(?:^|[^a-z])(?:%s)(?:$|[^a-z])"
#: Words of class or id that mark boilerplate wherever they are.
BOILER_WORD = re.compile(
    _WORDS % "ads?|adverts?|advertisements?|advertising|adsense|breadcrumbs?|comments?|commentlist|disqus|replies|cookies?|consent|gdpr|"
    "popup|modal|overlay|footer|footnav|copyright|sidebar|side|aside|widget|nav|navbar|navigation|menu|topbar|toolbar|masthead|"
    "sponsored|sponsor|newsletter|subscribe|signup|login|search|pagination|pager|hidden|skip"
)
#: Words that an article's own parts have as well.
WEAK_WORD = re.compile(_WORDS % "banner|notices?|alert|legal|share|sharing|social|related|recommended|promo|promoted|tags")
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？")

LEVEL = 0.5
GAUSS = (0.25, 0.5, 0.25)
#: The node's own part of the fused score, and what is left of a path's score one step below.
OWN = 0.3
BELOW = 0.95
#: Priors: boilerplate by tag, role or word; a weak word outside and inside an article; beside an article.
BOILER, WEAK, WEAK_INSIDE, BESIDE = 0.1, 0.1, 0.6, 0.3
CHUNK = 4 << 20
SCHEMA = "page_id long, url string, text string, n_chars long"


class _Element:
    """An open tag; ``path`` is the number of its tag path, ``block`` the nearest element that is not inline."""

    __slots__ = ("tag", "path", "parent", "skip", "prior", "article", "block", "linked")

    def __init__(self, tag: str, parent: _Element | None, attrs: dict[str, str | None], paths: dict) -> None:
        self.tag, self.parent = tag, parent
        inline = tag in INLINE and parent is not None and parent.parent is not None
        self.block = parent.block if inline else self
        self.linked = inline and (parent.linked or tag == "a")
        words = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        words = re.sub(r"([a-z])([A-Z])", r"\1-\2", words).lower()
        name = tag
        if words.strip() and not inline:
            name += "." + ".".join(sorted(set(re.sub(r"\d+", "", words).split())))
        self.path = paths.setdefault((parent.path if parent else 0, name), len(paths) + 1)
        self.article = bool(parent and parent.article) or tag in ("article", "main")
        self.skip = bool(parent and parent.skip) or tag in SKIPPED or "hidden" in attrs
        own = 1.0
        if tag in BOILERPLATE or (tag == "header" and not self.article) or (attrs.get("role") or "").lower() in BOILER_ROLE:
            own = BOILER
        # A word of class or id marks an element; on html, body, main and article it names the page's layout.
        elif words.strip() and tag not in ("html", "body", "main", "article"):
            if BOILER_WORD.search(words):
                own = BOILER
            elif WEAK_WORD.search(words):
                own = WEAK_INSIDE if self.article else WEAK
        self.prior = min(parent.prior if parent else 1.0, own)


class _Page(HTMLParser):
    """Blocks of text: (element of the block, parts, characters inside links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paths: dict[tuple[int, str], int] = {}
        self.top = self.root = _Element("", None, {}, self.paths)
        self.blocks: list[list] = []
        self.open = False
        self.tags: Counter = Counter()

    def _close(self, element: _Element) -> None:
        """Ends the open elements up to and with this one."""
        while self.top is not element:
            self.tags[self.top.tag] -= 1
            self.top = self.top.parent
        self.tags[element.tag] -= 1
        self.top = element.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.open = False
            return
        if tag in ENDS_P:
            self._end_implied(("p",), stop=("button", "table", "td", "th", "article", "section", "div", "li"))
        if tag in CLOSES:
            self._end_implied(CLOSES[tag], stop=("ul", "ol", "dl", "table", "select"))
        if tag not in INLINE:
            self.open = False
        self.top = _Element(tag, self.top, dict(attrs), self.paths)
        self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _end_implied(self, names: tuple, stop: tuple) -> None:
        if not any(self.tags[n] for n in names):
            return
        e = self.top
        while e.parent is not None and e.tag not in stop:
            if e.tag in names:
                self._close(e)
                return
            e = e.parent

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.open = False
        if not self.tags[tag]:
            return
        e = self.top
        while e.parent is not None and e.tag != tag:
            # An inline end tag without its start inside the block ends nothing.
            if tag in INLINE and e.tag not in INLINE:
                return
            e = e.parent
        if e.parent is not None:
            self._close(e)

    def handle_data(self, data: str) -> None:
        e = self.top
        if e.skip:
            return
        if not self.open:
            if not data.strip():
                return
            self.blocks.append([e.block, [], 0])
            self.open = True
        self.blocks[-1][1].append(data)
        if e.linked:
            self.blocks[-1][2] += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass


def page_nodes(html: str) -> list[tuple[_Element, str, float]]:
    """Text nodes in page order: block element, its text, the share of it inside links."""
    page = _Page()
    page.feed(re.sub(r"<!\[[^>]*>", "", html))
    page.close()
    nodes = []
    for block, parts, linked in page.blocks:
        text = " ".join("".join(parts).split())
        if text:
            nodes.append((block, text, linked / len(text)))
    return nodes


def path_ratios(nodes: list[tuple[_Element, str, float]]) -> dict[int, float]:
    """Per tag path: text outside links per node times punctuation per node, as a logarithm."""
    length, marks, count = defaultdict(float), defaultdict(int), defaultdict(int)
    for block, text, linked in nodes:
        count[block.path] += 1
        length[block.path] += len(text) * (1 - linked)
        marks[block.path] += sum(c in PUNCTUATION for c in text)
    return {p: math.log1p(length[p] / n * (0.1 + marks[p] / n)) for p, n in count.items()}


def smooth(series: list[float]) -> list[float]:
    if not series:
        return []
    padded = [series[0], *series, series[-1]]
    return [sum(g * padded[i + k] for k, g in enumerate(GAUSS)) for i in range(len(series))]


def priors(nodes: list[tuple[_Element, str, float]]) -> list[float]:
    has_article = any(block.article for block, _, _ in nodes)
    return [block.prior * (BESIDE if has_article and not block.article else 1.0) for block, _, _ in nodes]


def fuse(nodes: list[tuple[_Element, str, float]], scores: dict[int, float]) -> list[float]:
    """Each node's score joined with that of the path it lies in."""
    total, weight = defaultdict(float), defaultdict(int)
    for block, text, _ in nodes:
        if block.parent is not None:
            total[block.parent.path] += scores[block.path] * len(text)
            weight[block.parent.path] += len(text)
    known: dict[int, float] = {}

    def around(element: _Element | None) -> float:
        above = []
        while element is not None and element.path not in known:
            above.append(element.path)
            element = element.parent
        value = known[element.path] if element is not None else 0.0
        for path in reversed(above):
            value = max(value * BELOW, total[path] / weight[path] if weight[path] else 0.0)
            known[path] = value
        return value

    return [OWN * scores[block.path] + (1 - OWN) * around(block.parent) for block, _, _ in nodes]


def content(html: str | None) -> str:
    """The main text of one page."""
    nodes = page_nodes(html or "")
    if not nodes:
        return ""
    ratios = path_ratios(nodes)
    by_path: dict[int, list[float]] = defaultdict(list)
    for (block, _, _), value in zip(nodes, smooth([ratios[block.path] for block, _, _ in nodes])):
        by_path[block.path].append(value)
    prior = priors(nodes)
    fused = [f * w for f, w in zip(fuse(nodes, {p: sum(v) / len(v) for p, v in by_path.items()}), prior)]
    weight = [len(text) * w * w for (_, text, _), w in zip(nodes, prior)]
    mean = sum(f * w for f, w in zip(fused, weight)) / sum(weight)
    return " ".join(text for f, (_, text, _) in zip(fused, nodes) if f > 0 and f >= LEVEL * mean)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html", CHUNK):
        texts = [content(html) for html in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page with html."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, SCHEMA)


def op3_html_text(spark, sf_dir) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
