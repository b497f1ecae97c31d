"""Main text of web pages from streaming parser events.

The standard library's parser feeds events; block-level tags cut the text into lines. A line's text-to-tag ratio (its
text outside links by its tags) is smoothed by a Gaussian over its neighbours, and a threshold between two clusters of
the smoothed ratios marks content lines. The content region is the only article or main element with text if it holds
most of theirs, else the smallest container with all of it; an article or main element on the way is the region itself.

Inside the region, elements that can't be text of the article (menus, forms, scripts, hidden ones) are out, as are
whole containers whose class or id says so and nothing else ("site-footer", "related-posts"). A name that says so
among other words ("legal-analysis", "promo-story") is a hint only: such a container goes if the clusters leave it
without a content line, and so do runs of links outside of articles. What would be out but is wrapped around the page
(a form, a hidden body, a menu that is never closed) isn't. All else stays. A page takes time in proportion to its
length, however deep its tags are nested; markup that never ends is cut off first, as each tag of it would be sought to the end.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea option iframe object svg canvas audio video dialog menu map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("body html article main section div td center table tbody tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class and id that tell what isn't the article; those with a star as a beginning.
MARKS = frozenset(
    "nav navbar menu menubar breadcrumb breadcrumbs masthead banner topbar footer foot sidebar side aside rail widget widgets ad ads advert adverts adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall signup login comment comments commentlist respond reply replies disqus discussion reactions share sharing social related recommended recommendations pagination pager search copyright legal disclaimer skip toolbar hidden".split()
)
BEGINNINGS = ("comment", "sidebar", "advert", "cookie", "navbar", "navigation", "newsletter", "subscri", "breadcrumb", "sponsor", "promo", "disqus", "footer", "notif")
#: Words that may stand beside such a word without another meaning: places, kinds of boxes, whose they are.
BESIDE = frozenset(
    "site page global main primary secondary top bottom left right inner outer header head body area bar bars box boxes block blocks section sections container wrapper wrap holder panel pane slot unit list lists item items link links button buttons btn icon icons text title heading form field input js mobile desktop sticky fixed post posts article articles story stories reader readers user users blog news more content thread message region module component card cards row col column grid id".split()
)
PROTECTED = frozenset(("html", "body", "article", "main"))
CLOSES = {  # an opening tag ends an open element of these
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "a": ("a",),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of DROPPED, what stands inside a line of text without ending it, and what may be wrapped around a whole page.
INLINE = frozenset("script style noscript template button select textarea iframe object svg canvas audio map".split())
WRAPPERS = frozenset("nav aside form dialog menu header".split())
#: The beginning of markup that never ends, if no ">" follows.
_CUT = re.compile(r"<[A-Za-z/!?]")
_REMARKS = re.compile(r"\W*(?P<count>\d+\s+)?(reader |user )?(comments|responses|kommentare|commentaires|comentarios)\W*(?P<after>\(?\d+\)?)?\W*|\W*1\s+(comment|response|kommentar|commentaire|comentario)\W*", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an attribute says of an element: nothing, a hint, or that it isn't the article.
NOTHING, HINT, STRONG = range(3)


class _Node:
    __slots__ = ("tag", "parent", "at", "last", "drop", "hides", "inside", "linked", "told")

    def __init__(self, tag: str, parent: _Node | None, at: int, hides: bool, told: int):
        """hides: the element is no text of the article, unless the article is in it; of DROPPED but WRAPPERS it is none for sure."""
        self.tag, self.parent, self.at, self.last, self.told, self.hides = tag, parent, at, at, told, hides
        self.drop = tag in DROPPED and tag not in WRAPPERS or bool(parent and parent.drop)
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.linked = tag == "a" or bool(parent and parent.linked)

    def holds(self, other: _Node) -> bool:
        return self.at <= other.at <= self.last


def _named(value: str, inside: bool) -> int:
    """What the names in a class or id tell; each is taken as a whole."""
    found = NOTHING
    for name in value.split():
        words = [w.lower() for w in _CAMEL.split(name) if w]
        marks = [w in MARKS or w.startswith(BEGINNINGS) or w == "header" and not inside for w in words]
        if any(marks):
            if all(m or w in BESIDE for m, w in zip(marks, words, strict=True)):
                return STRONG
            found = HINT
    return found


def _gone(tag: str, attrs: list, inside: bool) -> bool:
    """Whether an element can't be text of the article whatever it holds."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
    return False


def _told(tag: str, attrs: list, inside: bool) -> int:
    if tag == "article":
        return STRONG if any(n in ("class", "id") and any(w.lower().startswith("comment") for w in _CAMEL.split(v or "")) for n, v in attrs) else NOTHING
    if tag in PROTECTED or tag in HEADINGS:
        return NOTHING
    if inside and tag == "section":  # an id there is a place to jump to, and its name one of the article's topics
        attrs = [(n, v) for n, v in attrs if n != "id"]
    return max((_named(v or "", inside) for n, v in attrs if n in ("class", "id")), default=NOTHING)


class _Lines(HTMLParser):
    """Lines of a page: text, its node, tags in it, characters in links. Nodes are in the order in which they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = _Node("html", None, 0, False, NOTHING)
        self.nodes, self.open = [self.node], Counter(["html"])
        self.lines: list[tuple[str, _Node, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.node, self.tags, self.linked))
        self.parts.clear()
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in DROPPED and tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._end("p", ("div", "article", "section", "td", "li", "blockquote", "body"))
        for other in CLOSES.get(tag, ()):
            self._end(other, ("ul", "ol", "dl", "table", "select"))
        inside = self.node.inside
        self.node = _Node(tag, self.node, len(self.nodes), _gone(tag, attrs, inside), _told(tag, attrs, inside))
        self.nodes.append(self.node)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end(self, tag: str, within: tuple[str, ...] = ()) -> None:
        if not self.open[tag]:
            return
        at, passed = self.node, []
        while at.parent and at.tag != tag and at.tag not in within:
            passed.append(at.tag)
            at = at.parent
        if at.parent and at.tag == tag:
            self.open.subtract([*passed, tag])
            self.node = at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in DROPPED and tag not in INLINE:
            self.flush()
        self.tags += 1
        self._end(tag)

    def handle_data(self, data: str) -> None:
        if self.node.drop:
            return
        self.parts.append(data)
        if self.node.linked:
            self.linked += len(data.strip())


def smoothed_ratios(texts: list[int], tags: list[int], sigma: float = 1.0) -> np.ndarray:
    """Characters by tags of each line, smoothed by a Gaussian of three deviations either way."""
    ratio = np.array(texts, float) / np.maximum(1, np.array(tags, float))
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


def cluster_threshold(values: np.ndarray) -> float:
    """Half-way between the means of two clusters (on a log scale); content lies at or above it."""
    x = np.log1p(values)
    low, high = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper, lower = x[x >= cut], x[x < cut]
        now = (float(lower.mean()) if len(lower) else low, float(upper.mean()) if len(upper) else high)
        if now == (low, high):
            break
        low, high = now
    return math.expm1((low + high) / 2) if high > low else 0.0


def _sums(nodes: list[_Node], values: dict[int, float]) -> list[float]:
    """By node: the values at it and below it."""
    out = [values.get(n.at, 0) for n in nodes]
    for n in reversed(nodes):
        if n.parent:
            out[n.parent.at] += out[n.at]
    return out


def _per_node(lines: list, values) -> dict[int, float]:
    out: dict[int, float] = {}
    for line, v in zip(lines, values, strict=True):
        out[line[1].at] = out.get(line[1].at, 0) + v
    return out


def _outside(lines: list, spans: list[tuple[int, int]]) -> list:
    """Lines whose node is in none of the spans of nodes."""
    held, end = [], -1
    for lo, hi in sorted(spans):
        if lo > end:
            held.append((lo, hi))
            end = hi
    starts = [lo for lo, _ in held]

    def free(at: int) -> bool:
        k = bisect_right(starts, at)
        return not k or held[k - 1][1] < at

    return [x for x in lines if free(x[1].at)]


def _honoured(nodes: list[_Node], lines: list) -> list[_Node]:
    """Outermost elements that their tags, attributes or names rule out, but for those wrapped around the page: around all
    its articles and most of its text, or, of elements that hide or are forms, around nearly all text of a page without an article."""
    articles = [n.at for n in nodes if n.tag in ("article", "main") and n.told != STRONG]
    texts = _sums(nodes, _per_node(lines, [len(x[0]) - x[3] for x in lines]))
    some = [at for at in articles if texts[at]]
    marked, end = [], -1
    for n in nodes:
        if n.at > end and (n.told == STRONG or n.hides):
            around = all(n.at <= at <= n.last for at in some) and (2 if some else 1.25) * texts[n.at] >= texts[0]
            if around and (some or n.hides):
                continue  # what is ruled out inside of it still is
            marked.append(n)
            end = n.last
    return marked


def _without_remarks(lines: list) -> list:
    """Lines but for readers' remarks: what follows a heading like "3 comments" inside its container.

    A heading without a count is one of the article if text of its own kind of container goes on after it: it opens
    remarks only where it is the first line of a container, or where other than plain blocks follow.
    """
    out, lo, hi = [], 0, -1
    opened: set[int] = set()
    for k, (text, node, _, _) in enumerate(lines):
        if lo <= node.at <= hi:
            continue
        parent, first = node.parent, node.parent is None or node.parent.at not in opened
        up = node
        while up and up.at not in opened:  # every node is noted once
            opened.add(up.at)
            up = up.parent
        if out and parent and node.tag in (*HEADINGS, "p", "div", "summary", "legend") and (found := _REMARKS.fullmatch(text)):
            after = lines[k + 1][1] if k + 1 < len(lines) else None
            plain = after is not None and after.parent is parent and after.tag in ("p", "pre", "blockquote", "table")
            counted = found["count"] or found["after"] or any(c.isdigit() for c in text)
            if counted or node.tag in HEADINGS and (first and parent.tag not in PROTECTED or not plain):
                lo, hi = parent.at, parent.last
                continue
        out.append(lines[k])
    return out


def _region(nodes: list[_Node], every: list[float], mass: list[float], lines: list) -> _Node:
    """The element that holds the article. every, mass: text outside links of all lines and of content lines, by node."""
    named = [n for n in nodes if n.tag in ("article", "main") and n.parent and not n.parent.inside and every[n.at]]
    region = nodes[0]
    if len(named) == 1 and mass[0] and mass[named[0].at] >= 0.75 * mass[0]:
        region = named[0]
    best: dict[int, _Node] = {}
    for n in nodes:
        if n.parent and (n.parent.at not in best or every[n.at] > every[best[n.parent.at].at]):
            best[n.parent.at] = n
    while mass[0]:
        child = best.get(region.at)
        # of main only an article with all of its text outside links is taken; elsewhere, too, all of it must lie in the child
        if child is None or child.tag not in CONTAINERS or every[child.at] < every[region.at]:
            break
        if region.tag == "article" or region.tag == "main" and child.tag != "article":
            break
        region = child
    return region


def main_text(html: str | None) -> str:
    """The article's blocks joined by line breaks; empty for a null, empty or textless page."""
    if not html:
        return ""
    page = _Lines()
    cut = _CUT.search(html, html.rfind(">") + 1)  # a tag that never ends has no text, nor what follows it
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    page.flush()
    nodes = page.nodes
    for n in reversed(nodes):
        if n.parent:
            n.parent.last = max(n.parent.last, n.last)
    # where names alone would leave nothing of a page, they aren't believed
    lines = _outside(page.lines, [(n.at, n.last) for n in _honoured(nodes, page.lines)]) or page.lines
    lines = _without_remarks(lines)
    if not lines:
        return ""
    own = [max(0, len(t) - linked) for t, _, _, linked in lines]
    ratio = smoothed_ratios(own, [tags for _, _, tags, _ in lines])
    content = ratio >= cluster_threshold(ratio)
    every = _sums(nodes, _per_node(lines, own))
    mass = _sums(nodes, _per_node(lines, [o if c else 0 for o, c in zip(own, content, strict=True)]))
    region = _region(nodes, every, mass, lines)
    linky = [linked >= 0.6 * len(t) for t, _, _, linked in lines]
    solid = _sums(nodes, _per_node(lines, [int(c and not a) for c, a in zip(content, linky, strict=True)]))
    hinted = [(n.at, n.last) for n in nodes if n.told == HINT and not solid[n.at] and n is not region and region.holds(n)]
    held = [k for k, x in enumerate(lines) if region.holds(x[1])]
    stay = {id(x) for x in _outside([lines[k] for k in held], hinted)}
    texts = [k for k in held if not linky[k]]
    out = []
    for k, line in enumerate(lines):
        text, node = line[0], line[1]
        if region.holds(node):
            # outside of articles, a line of links is text only by itself and between lines of text
            alone = linky[k] and texts and texts[0] < k < texts[-1] and not (linky[k - 1] or linky[k + 1])
            if id(line) in stay and (region.inside or not linky[k] or node.tag in ("h1", "h2") or alone):
                out.append(text)
        elif node.tag == "h1" and not region.inside and held and k < held[0]:
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages.

    A null html is empty; empty and textless pages give an empty text. Repeated rows and null ids stay as they are;
    other columns are ignored. Pages are taken one by one, whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col(html_col)).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
