"""Main text of web pages by tag-path ratios.

Each text node has a root-to-leaf tag path.  Per page and path the operator sums
text length and punctuation marks, takes their ratios per node and their spread
over the nodes, and multiplies them (the extended tag-path ratio); prose scores
high, link lists and captions low.  The scores, in page order, are smoothed by a
Gaussian, and paths whose nodes reach a share of the deviation are selected.
Fusion: the deepest container that holds nearly all selected text is the core of
the article; from there it widens to the outermost article or else main element
about it, and further while the text that comes in is headings and prose more
than anything else, so a title or lead beside a long body stays.  Every path
below belongs to it, however short its nodes, save what marks itself as something
else (menus, forms, adverts, comments and the like).  Names that may as well mark
a part of the article (legal, discussion and the like) only weigh: inside an
article or main element such text stays if its path is selected.  Where no such
element marks the article, blocks of links alone stay only if theirs is.

Edge cases: a null or empty page, or one of markup only, gives an empty text;
unclosed tags, stray end tags, unquoted attributes and a `<` that begins no tag
are read as browsers do, roughly; a page is parsed in one go, in time in
proportion to its length however deep or broken it is;
repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

# A `<` that begins another tag ends one that was not closed, so each character is looked at a bounded number of times.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*"|'[^']*'|[^'"<>]|<(?![a-zA-Z/!?]))*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?…¿¡。、，；：！？]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*>|\Z", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body article main section div td center".split())
#: Elements that are never article text, and those that are not unless they stand inside the article.
OTHER = frozenset("head nav footer aside form button select option menu dialog svg math object canvas audio video map fieldset".split())
#: A start tag of these ends an open paragraph.
BREAKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = re.compile(
    r"(?<!\bhas)(?<!\bwith)(?<!\bno)(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit)|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|side-?bar|aside|widget|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related(?![-_]?works?\b)|recommend\w*|comments?|commentlist|disqus|pagination|pager|toolbar|skip|hidden|sr-only|tracking|rail|sidecol|teaser|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
#: These may name a part of the article as well: inside an article or main element the path's score decides.
UNSURE = re.compile(r"(?:^|[\s_-])(?:copyright|legal|disclaimer|discussion|search|respond|replies|reply)(?=$|[\s_-])", re.I)
#: Of these names only outside the article, and not where they name the article's own head.
HEAD = re.compile(r"(?:^|[\s_-])(?:header|topnav|top-bar|site-title)(?=$|[\s_-])", re.I)
OWN_HEAD = re.compile(r"entry|article|post|content|story|title", re.I)
#: Paths are selected from this share of the deviation of the smoothed scores; the article holds this share of the selected text.
THRESHOLD, MASS = 0.8, 0.98
#: Text in these is prose; so is other text of this length with a punctuation mark.
PROSE, PROSE_LENGTH = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split()), 25


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip(" /") else {}


def _marked(tag: str, attributes: dict[str, str], inside: bool) -> int:
    """0 for what may be article text, 1 for what may be if its path says so, 2 for what is not."""
    if tag in OTHER or tag in RAW:
        return 2
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}" if attributes else ""
    if not inside and (tag == "header" or named and HEAD.search(named) and not OWN_HEAD.search(named)):
        return 2
    if not attributes:
        return 0
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return 2
    if attributes.get("role", "").lower() in ROLES:
        return 2
    if tag in ("html", "body"):
        return 0
    if MARKS.search(named):
        return 2
    return (1 if inside else 2) if UNSURE.search(named) else 0


class Page:
    """Elements by number, in page order, and text nodes (text, block, element).

    Of each element: tag, parent, path (a number for each parent path and tag) and
    mark.  Element 0 is the page itself.  Open elements are counted by tag, so an
    end tag without a start is not looked for, and all work is in proportion to
    the page's length, however deep or broken it is.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[str, int, int]] = []
        self.tags, self.parent, self.path, self.mark = [""], [0], [0], [0]
        self._stack: list[int] = [0]
        self._open: Counter[str] = Counter()
        paths: dict[tuple[int, str], int] = {}
        block = at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            end = m.start() if m else len(source)
            if end > at:
                self._text(source[at:end], block)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag not in INLINE:
                block += 1
            if m[1]:
                self._close(tag)
                continue
            if tag in RAW:  # its content is no markup and no text
                at = RAW[tag].search(source, at).end()
                continue
            if tag in BREAKS:
                self._end({"p"}, CONTAINERS | OTHER)
            if tag in ENDS:
                self._end(ENDS[tag], {"ul", "ol", "dl", "table", "select"} | (CONTAINERS - {"td"}))
            if tag in VOID or m[3].endswith("/") and tag in ("path", "circle", "rect"):
                continue
            inside = bool(self._open["article"] or self._open["main"])
            above = self._stack[-1]
            self.mark.append(max(self.mark[above], _marked(tag, _attributes(m[3]), inside)))
            self.path.append(paths.setdefault((self.path[above], tag), len(paths) + 1))
            self.parent.append(above)
            self._stack.append(len(self.tags))
            self._open[tag] += 1
            self.tags.append(tag)

    def _text(self, raw: str, block: int) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if text.strip():
            self.nodes.append((text, block, self._stack[-1]))
        elif text and self.nodes and self.nodes[-1][1] == block:
            last = self.nodes[-1]
            self.nodes[-1] = (last[0] + " ", *last[1:])

    def _end(self, tags: set, barrier: set) -> None:
        if any(self._open[t] for t in tags):
            for k in range(len(self._stack) - 1, 0, -1):
                tag = self.tags[self._stack[k]]
                if tag in tags:
                    return self._cut(k)
                if tag in barrier:
                    return None
        return None

    def _close(self, tag: str) -> None:
        if self._open[tag]:
            for k in range(len(self._stack) - 1, 0, -1):
                here = self.tags[self._stack[k]]
                if here == tag:
                    return self._cut(k)
                if tag in INLINE and here not in INLINE:
                    return None
        return None

    def _cut(self, k: int) -> None:
        for e in self._stack[k:]:
            self._open[self.tags[e]] -= 1
        del self._stack[k:]

    def below(self, first, step) -> list:
        """A value for each element, from its parent's: step(value of the parent, element)."""
        out = [first]
        for e in range(1, len(self.tags)):
            out.append(step(out[self.parent[e]], e))
        return out

    def totals(self, own: list[int]) -> list[int]:
        """For each element what it and those below it have; parents stand before their children."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def path_scores(nodes: list, path: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The extended tag-path ratio of each node's path, as it is and smoothed in page order."""
    length = np.array([len(n[0].strip()) for n in nodes], float)
    marks = np.array([len(PUNCTUATION.findall(n[0])) for n in nodes], float)
    _, group = np.unique([path[n[2]] for n in nodes], return_inverse=True)
    count = np.bincount(group)
    mean = lambda x: np.bincount(group, weights=x) / count
    spread = lambda x: np.sqrt(np.maximum(mean(x * x) - mean(x) ** 2, 0))
    score = (mean(length) * (1 + mean(marks)) * (1 + spread(length)) ** 0.5 * (1 + spread(marks)) ** 0.5)[group]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    return score, np.convolve(np.pad(score, 2, mode="edge"), kernel / kernel.sum(), mode="valid")


def _widened(page: Page, nodes: list, core: int) -> int:
    """The outermost element about the core whose further text belongs to the article."""
    chain = [core]
    while page.parent[chain[-1]]:
        chain.append(page.parent[chain[-1]])
    chain.reverse()
    place = {e: k for k, e in enumerate(chain)}
    # Of each element: where it hangs on the chain, and whether prose, links or another article stand in between.
    hangs = page.below((-1, False, False), lambda up, e: (place[e], False, False) if e in place else (up[0], up[1] or page.tags[e] in PROSE, up[2] or page.tags[e] in ("a", "article")))
    extra, prose = [0] * len(chain), [0] * len(chain)
    for text, _, e in nodes:
        at, heading, other = hangs[e]
        if not 0 <= at < len(chain) - 1:
            continue
        text = text.strip()
        extra[at] += len(text)
        if not other and (heading or len(text) >= PROSE_LENGTH and PUNCTUATION.search(text)):
            prose[at] += len(text)
    tags = [page.tags[e] for e in chain]
    at = tags.index("article") if "article" in tags else tags.index("main") if "main" in tags else len(chain) - 1
    for k in range(at - 1, -1, -1):
        if tags[k + 1] == "main" or 2 * prose[k] < extra[k]:
            break
        if extra[k]:
            at = k
    return chain[at]


def main_text(source: str | None) -> str:
    """The article's text, blocks joined by one space."""
    if not source:
        return ""
    page = Page(source)
    nodes = [n for n in page.nodes if page.mark[n[2]] < 2]
    if not nodes:
        return ""
    plain, score = path_scores(nodes, page.path)
    own_score = {page.path[n[2]]: s for n, s in zip(nodes, plain, strict=True)}
    best: dict[int, float] = {}
    for n, s in zip(nodes, score, strict=True):
        best[page.path[n[2]]] = max(best.get(page.path[n[2]], 0.0), s)
    least = min(THRESHOLD * score.std(), score.max())
    chosen = lambda n: best[page.path[n[2]]] >= least
    alone = lambda n: own_score[page.path[n[2]]] >= least  # noqa: E731  without what stands beside it
    nodes = [n for n in nodes if not page.mark[n[2]] or alone(n)]
    own = [0] * len(page.tags)
    for n in filter(chosen, nodes):
        own[n[2]] += len(n[0].strip())
    mass = page.totals(own)
    # Elements are numbered in page order, so of those that hold the mass the last is the deepest.
    article = max((e for e in range(1, len(mass)) if mass[e] >= max(MASS * mass[0], 1) and page.tags[e] in CONTAINERS), default=None)
    if article is not None:
        article = _widened(page, nodes, article)
        inside = page.below(False, lambda up, e: up or e == article)
        nodes = [n for n in nodes if inside[n[2]]]
    blocks: dict[int, list[str]] = defaultdict(list)
    linked = _links(page, nodes, alone) if article is None or page.tags[article] not in ("article", "main") else set()
    for n in nodes:
        if n[1] not in linked:
            blocks[n[1]].append(n[0])
    return " ".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def _links(page: Page, nodes: list, alone) -> set[int]:
    """Blocks of nothing but links whose paths alone score too little: menus that do not say so, where no element marks the article."""
    link = page.below(False, lambda up, e: up or page.tags[e] == "a")
    other = {n[1] for n in nodes if n[0].strip() and (not link[n[2]] or alone(n))}
    return {n[1] for n in nodes} - other


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (its code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return texts(df).select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html")).mapInArrow(run, SCHEMA)
