"""Main text of web pages by a tree-structured graphical model of the DOM.

Every element is a binary variable (content or not).  Its own evidence - tag,
words in class, id and role, length and link share of its text - gives a unary
potential; a parent and a child are tied by a pairwise potential.  Sum-product
messages go from the leaves to the root and back, which on a tree yields exact
marginals; a text block is kept when the marginal of its element says content.

Both potentials are counted from labelled pages: the hand-labelled skeletons of
``html_seeds`` and at most ``TRAIN_PAGES`` pages of the corpus itself, labelled by
their own landmark elements (article or main against nav, aside, footer ...).
The bounded sample only fits the model; every page is parsed and read whole.

Blocks: text belongs to the nearest block-level element; a block ends where a
block-level element starts or ends.  Character references are decoded, runs of
white space become one blank, blocks are joined in page order by an empty line.

Defined results: a null or empty page, and one without content, give an empty
text; broken markup is repaired like a lenient parser would; rows may repeat and
ids may be null; empty in, empty out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.html_seeds import labelled_pages

#: Pages of the corpus that the model is fitted on, at most.
TRAIN_PAGES = 200

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p "
    "pre section select summary table tbody td tfoot th thead title tr ul video audio iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never text of the page.
SILENT = frozenset("script style template head title noscript iframe object textarea select svg".split())
#: Elements that may stand in a head; any other tag, or text, ends one that is open.
HEAD_CONTENT = frozenset("html head title base link meta style script noscript template".split())
#: An opening tag closes these open elements, up to the given borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_BORDER = frozenset("td th li dd dt article section div main aside body blockquote button figure form".split())

#: Elements that may begin or end the main content by themselves; any other
#: without a telling name hangs on its parent by a potential of its own.
CONTAINER = frozenset(
    "article aside body center details div figure fieldset footer form header html iframe main menu nav noscript section "
    "table button script style head".split())

#: Word families in class, id and role names.
FAMILIES = (
    ("nav", "nav navigation menu menus breadcrumb breadcrumbs toc pagination pager tabs toolbar"),
    ("ad", "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense"),
    ("comment", "comment comments reply replies discussion disqus respond forum thread"),
    ("side", "sidebar side aside related widget widgets recommended trending popular tags rail"),
    ("notice", "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup paywall"),
    ("foot", "footer foot copyright legal credits colophon"),
    ("head", "masthead topbar siteheader header head logo"),
    ("form", "form login search register contact"),
    ("share", "share sharing social follow"),
    ("main", "article content post entry main story body text prose"),
)
FAMILY = {w: name for name, words in FAMILIES for w in words.split()}
_WORD = re.compile(r"[a-z]+")
#: Landmarks that label the corpus pages of the sample.
LANDMARK_YES = frozenset(("article", "main"))
LANDMARK_NO = frozenset("nav aside footer header form".split())
NO_FAMILIES = frozenset("nav ad comment side notice foot form share".split())


class Dom(HTMLParser):
    """Elements in page order (a parent before its children) and text blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.family, self.mark = ["#root"], [-1], [""], [None]
        self.size, self.linked = [0], [0]
        self.stack, self.silent, self.links, self.formula = [0], 0, 0, False
        self.blocks: list[tuple[int, list[str]]] = []
        self.fresh = True

    @classmethod
    def of(cls, html: str | None) -> "Dom":
        dom = cls()
        dom.feed((html or "").replace("\0", ""))
        dom.close()
        return dom

    def _pop(self, depth: int) -> None:
        for i in self.stack[depth:]:
            tag = self.tag[i]
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            self.fresh = self.fresh or tag in BLOCK
        del self.stack[depth:]

    def _close(self, tags, borders) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in tags:
                self._pop(depth)
                return
            if tag in borders:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        self.formula = tag == "math" or self.formula and tag not in BLOCK
        if self.formula:  # words like any others, no element of the page
            return
        if tag in BLOCK:
            self._close(("p",), P_BORDER)
            self.fresh = True
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if self.silent and tag not in HEAD_CONTENT:
            self._close(("head",), SILENT - {"head"})
        elif tag == "br":
            self.handle_data(" ")
        family, mark = "", None
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for w in _WORD.findall(value.lower()):
                    family = FAMILY.get(w, family) if family in ("", "main") else family
            elif name == "y":
                mark = value
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.family.append(family)
        self.mark.append(mark)
        self.size.append(0)
        self.linked.append(0)
        if tag not in VOID:
            self.stack.append(len(self.tag) - 1)
            self.silent += tag in SILENT
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.tag[self.stack[-1]] == tag:
            self._pop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.formula:
            self.formula = tag != "math" and tag not in BLOCK
            if tag not in BLOCK:
                return
        for depth in range(len(self.stack) - 1, 0, -1):
            own = self.tag[self.stack[depth]]
            if own == tag:
                self._pop(depth)
                return
            if own in BLOCK and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.silent and self.tag[self.stack[-1]] == "head" and not data.isspace():
            self._close(("head",), ())
        if self.silent:
            return
        n = len(data)
        for depth in range(len(self.stack) - 1, -1, -1):
            at = self.stack[depth]
            if self.tag[at] in BLOCK or not depth:
                break
        if not self.fresh or not data.isspace():
            if self.fresh or not self.blocks or self.blocks[-1][0] != at:
                self.blocks.append((at, []))
                self.fresh = False
            self.blocks[-1][1].append(data)
        own = self.stack[-1]
        self.size[own] += n
        self.linked[own] += n if self.links else 0

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        size, linked = self.size, self.linked
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        return np.asarray(size), np.asarray(linked)


def evidence(dom: Dom) -> list[tuple[str, str, int, int]]:
    """(tag, word family, length class, link class) of each element."""
    size, linked = dom.totals()
    length = np.searchsorted((1, 25, 120, 500), size, side="right").tolist()
    links = np.where(size > 0, np.searchsorted((0.01, 0.3, 0.7), linked / np.maximum(size, 1), side="right"), 4).tolist()
    return list(zip(dom.tag, dom.family, length, links))


def tie(e: tuple[str, str, int, int]) -> int:
    """Which of the two parent-child potentials an element has."""
    return int(e[0] in CONTAINER or e[1] != "")


def landmark_labels(dom: Dom) -> list[int] | None:
    """Content marks from a page's own landmark elements; None without any."""
    if not any(t in LANDMARK_YES for t in dom.tag):
        return None
    y = [0]
    for i in range(1, len(dom.tag)):
        up = y[dom.parent[i]]
        if dom.tag[i] in LANDMARK_NO or dom.family[i] in NO_FAMILIES or dom.tag[i] in SILENT:
            up = 0
        elif dom.tag[i] in LANDMARK_YES:
            up = 1
        y.append(up)
    return y


def marked_labels(dom: Dom) -> list[int]:
    y = [0]
    for i in range(1, len(dom.tag)):
        y.append(y[dom.parent[i]] if dom.mark[i] is None else int(dom.mark[i] == "1"))
    return y


class Model:
    """Log potentials counted from labelled trees (add-one smoothed)."""

    def __init__(self, trees: list[tuple[list[tuple], list[int], list[int]]]):
        self.unary: list[dict] = []
        marks = [0.5, 0.5]
        pair = np.full((2, 2, 2), 0.5)
        counts = [[Counter(), Counter()] for _ in range(4)]
        for ev, parent, y in trees:
            for i in range(1, len(y)):
                marks[y[i]] += 1
                pair[tie(ev[i]), y[parent[i]], y[i]] += 1
                for f in range(4):
                    counts[f][y[i]][ev[i][f]] += 1
        for f in range(4):
            values = set(counts[f][0]) | set(counts[f][1])
            self.unary.append({
                v: tuple(np.log((counts[f][y][v] + 1.0) / (marks[y] + len(values) + 1)) for y in (0, 1)) for v in values})
        self.pair = np.log(pair / pair.sum(axis=2, keepdims=True))

    def potentials(self, ev: list[tuple]) -> list[tuple[float, float]]:
        a, b, c, d = self.unary
        none = (0.0, 0.0)
        cache: dict = {}
        out = []
        for e in ev:
            p = cache.get(e)
            if p is None:
                parts = (a.get(e[0], none), b.get(e[1], none), c.get(e[2], none), d.get(e[3], none))
                p = cache[e] = (sum(x[0] for x in parts), sum(x[1] for x in parts))
            out.append(p)
        out[0] = (0.0, -30.0)  # the document itself is no content
        return out


def marginals(unary: np.ndarray, parent: np.ndarray, ties: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Probability of content per node of a forest (parents before children, -1
    at roots), by sum-product messages up and down, a level of all trees at once."""
    n = len(parent)
    up, hops = parent.copy(), (parent >= 0).astype(np.int64)
    while (live := np.flatnonzero(up >= 0)).size:  # pointer doubling
        hops[live] += hops[up[live]]
        up[live] = up[up[live]]
    depth = hops
    order = np.argsort(depth, kind="stable")
    border = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    belief = unary.astype(np.float64).copy()
    message = np.zeros((n, 2))
    for d in range(depth.max(), 0, -1):
        at = order[border[d]:border[d + 1]]
        for y in (0, 1):
            message[at, y] = np.logaddexp(belief[at, 0] + pair[ties[at], y, 0], belief[at, 1] + pair[ties[at], y, 1])
        np.add.at(belief, parent[at], message[at])
    for d in range(1, depth.max() + 1):
        at = order[border[d]:border[d + 1]]
        rest = belief[parent[at]] - message[at]
        rest -= rest.max(axis=1, keepdims=True)
        for y in (0, 1):
            belief[at, y] += np.logaddexp(rest[:, 0] + pair[ties[at], 0, y], rest[:, 1] + pair[ties[at], 1, y])
    return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def extract(pages: list[str | None], model: Model) -> list[str]:
    doms = [Dom.of(p) for p in pages]
    if not doms:
        return []
    sizes = np.asarray([len(d.tag) for d in doms])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    seen = [evidence(d) for d in doms]
    unary = np.asarray([u for ev in seen for u in model.potentials(ev)])
    ties = np.asarray([tie(e) for ev in seen for e in ev])
    parent = np.concatenate([np.where(np.asarray(d.parent) < 0, -1, np.asarray(d.parent) + b) for d, b in zip(doms, begin)])
    content = marginals(unary, parent, ties, model.pair) > 0.5
    out = []
    for d, b in zip(doms, begin):
        texts = (" ".join("".join(t).split()) for at, t in d.blocks if content[b + at])
        out.append("\n\n".join(t for t in texts if t))
    return out


def train(pages: list[str | None], skeletons: list[str] | None = None) -> Model:
    """The skeletons count as much as the corpus pages, whose few templates would
    else teach that a paragraph is always content."""
    trees, marked = [], []
    for p in pages:
        d = Dom.of(p)
        y = landmark_labels(d)
        if y is not None:
            trees.append((evidence(d), d.parent, y))
    for p in labelled_pages() if skeletons is None else skeletons:
        d = Dom.of(p)
        marked.append((evidence(d), d.parent, marked_labels(d)))
    times = max(5, sum(len(t[1]) for t in trees) // max(1, sum(len(t[1]) for t in marked)))
    return Model(trees + marked * times)


def fit(df: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Model:
    """Fit on a bounded sample: the pages whose text hashes lowest."""
    pages = df.select(F.col(html).cast("string").alias("h")).filter(F.col("h").isNotNull()).withColumn("o", F.xxhash64("h"))
    # hashes first: only the chosen pages themselves go to the driver
    chosen = [r[0] for r in pages.select("o").distinct().orderBy("o").limit(train_pages).collect()]
    rows = pages.filter(F.col("o").isin(chosen)).groupBy("o").agg(F.min("h").alias("h")).orderBy("o").collect()
    return train([r["h"] for r in rows])


def main_text(df: DataFrame, html: str = "html", model: Model | None = None, out: str = "text") -> DataFrame:
    """``df`` without its ``html`` column and with the main text in ``out``."""
    model = model or fit(df, html)
    rest = [c for c in df.columns if c not in (html, out)]
    src = df.select(F.struct(*rest).alias("row") if rest else F.lit(None).alias("row"), F.col(html).cast("string").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(extract(b.column("h").to_pylist(), model),
                                                                           pa.string())], ["row", "text"])

    done = src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, text string")
    return done.select(*([F.col(f"row.`{c}`").alias(c) for c in rest]), F.col("text").alias(out))
