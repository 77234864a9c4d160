"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import fit_trees, margins
from .common import materialise

#: The fit sees about this many pages, and about this many labelled nodes of them.
FIT_PAGES, FIT_NODES = 1500, 60_000
#: A container may only be split between content and the rest for more evidence than this.
SPLIT_COST = 25.0

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: Elements that cannot hold main text.
NEVER = {"head", "title", "script", "style", "noscript", "template", "button", "select", "option", "textarea", "iframe",
         "svg", "canvas", "object", "audio", "video"}
#: Elements that seldom hold it.
SELDOM = {"nav", "footer", "aside", "form", "menu", "dialog", "label", "fieldset"}
MAIN = {"article", "main"}
#: A new one of these closes an open one, up to the container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
BAD_TOKENS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
              "consent", "cookie", "cookies", "copyright", "disqus", "footer", "header", "login", "masthead", "menu", "modal",
              "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "related",
              "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored",
              "subscribe", "tags", "toolbar", "widget", "alert", "complementary", "contentinfo"}
GOOD_TOKENS = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}
GROUPS = [{"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section"}]
FEATURES = len(GROUPS) + 16
#: Log-odds that article and main add to what they hold, and what marks take off below a SELDOM element,
#: below a bad token, and below either in an article (where no odds are added then).
MAIN_ODDS, SELDOM_ODDS, TOKEN_ODDS, INNER_ODDS = 8.0, 8.0, 4.0, 1.5


class Dom(HTMLParser):
    """Nodes of a page in document order, and its text in pieces.

    Inline elements belong to the node around them, unless an attribute token
    marks them; an element that cannot hold another closes itself.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.good, self.bad = ["#page"], [-1], [0], [0]
        self.depths, self.pieces = [0], []
        self.stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
        #: Where in the stack each open tag stands, and the open elements that are no inline ones.
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def parse_marked_section(self, i, report=1):
        """``<![ ...``: a comment, whatever it says."""
        return self.parse_bogus_comment(i)

    def _push(self, tag, node, link):
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node, link))

    def _cut(self, size):
        """Close the elements from place ``size`` of the stack on; each is closed once, so a page takes time in proportion to its length."""
        while len(self.stack) > size:
            tag, *_ = self.stack.pop()
            self.open[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def _last(self, tags):
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.pieces.append((-1, " ", False))
            return
        inline = tag in INLINE
        if not inline:
            self.pieces.append((-1, " ", False))
            if self.open.get("p"):
                self._close({"p"}, {"table", "td", "button", "object"})
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        good = bad = 0
        for name, value in attrs:
            if value and name in ("class", "id", "role", "itemprop", "aria-label"):
                tokens = set(re.split(r"[^a-z0-9]+", value.lower()))
                good += len(tokens & GOOD_TOKENS)
                bad += len(tokens & BAD_TOKENS)
        _, node, link = self.stack[-1]
        if not inline or bad:
            self.tags.append(tag)
            self.parents.append(node)
            self.depths.append(self.depths[node] + 1)
            self.good.append(good)
            self.bad.append(bad)
            node = len(self.tags) - 1
        self._push(tag, node, link or tag == "a")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tags, until):
        at = self._last(tags)
        if at > self._last(until):
            self._cut(at)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.pieces.append((-1, " ", False))
        at = self._last((tag,))
        if at and (tag not in INLINE or at > self.blocks[-1]):  # an inline element does not end beyond its block
            self._cut(at)

    def handle_data(self, data):
        _, node, link = self.stack[-1]
        self.pieces.append((node, data, link))


def parse(html: str | None) -> Dom:
    dom = Dom()
    dom.feed(html or "")
    dom.close()
    return dom


def node_table(dom: Dom) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, own characters, prior log-odds, weak label) of every node.

    The prior is -inf under what cannot hold text, MAIN_ODDS under article or main,
    less under a mark (SELDOM element, bad token), else 0; the trees may overrule a
    mark. A mark says nothing on what holds the article or main with the most prose
    or, on a page without, most of the prose; nor a token on a paragraph or heading
    in an article. The features leave these tags out, so that the trees learn
    from densities, links, siblings, depth and tokens. Label 1: under article or main (or a content token) and under no
    mark; 0: under a mark, if not just a token in an article; -1: unknown.
    """
    n = len(dom.tags)
    own, links, commas, before = [0] * n, [0] * n, [0] * n, [0] * n
    total, reached = 0, -1
    for node, text, link in dom.pieces:
        if node >= 0:
            size = len(text) - text.count(" ") if text else 0
            while reached < node:
                reached += 1
                before[reached] = total
            own[node] += size
            links[node] += size if link else 0
            commas[node] += text.count(",") + text.count(".")
            total += size
    parents, tags = dom.parents, dom.tags
    subtree, sub_links, sub_commas, sub_nodes = own[:], links[:], commas[:], [1] * n
    children, child_chars = [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        up = parents[k]
        subtree[up] += subtree[k]
        sub_links[up] += sub_links[k]
        sub_commas[up] += sub_commas[k]
        sub_nodes[up] += sub_nodes[k]
        children[up] += 1
        child_chars[up] += subtree[k]
    never, inside, held, index, met, label, mark = ([0] * n for _ in range(7))
    for k in range(n):
        never[k] = k and never[parents[k]] or tags[k] in NEVER
    prose = [0 if never[k] else own[k] - links[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        prose[parents[k]] += prose[k]
    chief = max((k for k in range(n) if tags[k] in MAIN and prose[k]), key=prose.__getitem__, default=-1)
    above = {k for k in range(n) if chief < 0 and 2 * prose[k] > prose[0]}
    while chief >= 0:
        above.add(chief)
        chief = parents[chief]
    for k in range(n):
        up, tag = parents[k], tags[k]
        main = tag in MAIN
        if up >= 0:
            index[k] = met[up]
            met[up] += 1
            held[k] = held[up] or main
            inside[k] = inside[up] or main or dom.good[k] > 0 and not dom.bad[k]
            mark[k] = mark[up]
            if k not in above:
                token = dom.bad[k] > 0 and not main and not (held[up] and any(tag in group for group in GROUPS[:2]))
                mark[k] = max(mark[k], 2 if tag in SELDOM or tag == "header" and not inside[up] else int(token))
        label[k] = 0 if never[k] or mark[k] > held[k] else -1 if mark[k] or not inside[k] else 1
    a = np.array
    up = np.maximum(a(parents), 0)
    own_a, sub, link_a, nodes = a(own, float), a(subtree, float), a(sub_links, float), a(sub_nodes, float)
    siblings, sibling_chars = a(children, float)[up], a(child_chars, float)[up]
    columns = [a([t in group for t in tags], float) for group in GROUPS]
    columns += [a(dom.depths, float), np.log1p(own_a), np.log1p(sub), sub / nodes, link_a / np.maximum(sub, 1),
                a(sub_commas, float) / np.maximum(sub, 1), np.log1p(nodes), a(children, float), siblings, a(index, float),
                sibling_chars / np.maximum(siblings, 1), sub / np.maximum(sibling_chars, 1), a(before, float) / max(total, 1),
                sub / max(total, 1), a(dom.good, float), a(dom.bad, float)]
    off = np.array([0.0, TOKEN_ODDS, SELDOM_ODDS])[a(mark, int)]
    prior = np.where(a(held, bool), np.where(off > 0, -INNER_ODDS, MAIN_ODDS), -off)
    prior[a(never, bool)] = -np.inf
    return np.stack(columns, axis=1).astype(np.float32), own_a, prior, a(label)


def decode(parents: list[int], odds: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Nodes to keep: a subtree is content as a whole, not at all, or mixed, and a
    choice for a whole binds everything below it, so that an ancestor and its
    descendants never disagree. The best sum of log-odds * characters wins; what a
    mark (a prior below that of its parent) starts joins a whole only on its own merit. Where
    that leaves nothing, everything without a mark that may be content is kept."""
    n, never = len(parents), np.isinf(prior)
    score = np.where(never, -1e6, odds + np.where(never, 0.0, prior)) * weight
    whole = score.tolist()
    mixed = np.maximum(score, 0).tolist()
    best = [0.0] * n
    for k in range(n - 1, -1, -1):
        best[k] = max(whole[k], 0.0, mixed[k] - SPLIT_COST)
        if k:
            if whole[k] < 0 and prior[k] < prior[parents[k]]:
                whole[k] = -1e9
            whole[parents[k]] += whole[k]
            mixed[parents[k]] += best[k]
    keep = np.zeros(n, bool)
    state = [""] * n
    for k in range(n):
        above = state[parents[k]] if k else "mixed"
        if above != "mixed":
            state[k] = above
        elif whole[k] >= max(0.0, mixed[k] - SPLIT_COST) and not (never[k] and weight[k]):
            state[k] = "in"
        else:
            state[k] = "mixed" if mixed[k] - SPLIT_COST > 0 else "out"
        keep[k] = state[k] == "in" or state[k] == "mixed" and score[k] > 0
    keep &= ~never
    return keep if (weight[keep] > 0).any() else prior >= 0


def text_of(dom: Dom, keep: np.ndarray) -> str:
    kept = keep.tolist()
    return " ".join("".join(text if node < 0 or kept[node] else " " for node, text, _ in dom.pieces).split())


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, fit_nodes: int = FIT_NODES) -> dict | None:
    """Trees fitted on weakly labelled nodes of a bounded sample of pages, or None
    where the sample lacks one of the classes. Features of node tokens and tags
    carry the mark-up, densities and siblings the pages that have none.

    About ``fit_pages`` rows are chosen by a hash of id and html and equal pages of them
    taken once; about ``fit_nodes`` of their labelled nodes (all, if fewer) are chosen by
    a hash inside Spark, so the driver gets no more, however large or common a page is.
    """
    some = pages.where("html IS NOT NULL").select("page_id", "html")
    rows = some.count()
    share = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = some.where(share * F.lit(float(max(rows, 1))) < fit_pages).select("html").distinct()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column(0):
                x, _, _, y = node_table(parse(html.as_py()))
                known = np.flatnonzero(y >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[known]], pa.binary()), pa.array(y[known].astype(np.int8)),
                                                  pa.array(known.astype(np.int32))], ["x", "y", "place"])

    nodes = materialise(sample.mapInArrow(label, "x binary, y tinyint, place int"))
    many = nodes.count()
    kept = F.pmod(F.xxhash64("x", "y", "place"), F.lit(max(many, 1))) < fit_nodes
    got = nodes.where(kept).orderBy(F.xxhash64("x", "place"), "x", "y", "place").collect()
    if not got:
        return None
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, FEATURES)
    y = np.array([r.y for r in got], float)
    return fit_trees(x, y) if 0 < y.sum() < len(y) else None


def extract(pages: DataFrame, model: dict | None) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null or empty html, and pages where nothing is content, give an empty text.
    Without a model every node that has no mark and can hold text is content.
    Repeated rows are extracted each; broken mark-up never fails; extra columns
    are ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                doms = [parse(html) for html in part.column(2).to_pylist()]
                tables = [node_table(dom) for dom in doms]
                odds = margins(trees, np.concatenate([t[0] for t in tables])) if trees else None
                texts, first = [], 0
                for dom, (x, weight, prior, _) in zip(doms, tables):
                    own = odds[first:first + len(x)] if trees else np.ones(len(x))
                    first += len(x)
                    texts.append(text_of(dom, decode(dom.parents, own, weight, prior)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        read, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
