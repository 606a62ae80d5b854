"""HTML main text by a tree-structured graphical model.

Nodes are the block elements of a page, each content or not.  A node's own
evidence is a sum of log odds of its features (element, names in class, id and
role, length, share of link text); a name is a whole class or id, hashed, and
tells what it is only if all of its parts do (``ad-box``, ``site-footer``; not
``related-work`` or ``tags-intro``) and no other name of the element says the
opposite; an edge holds the log odds of a child's
label given its parent's (or that the parent is the page), one table for
children that say by element or class what they are, one for plain ones.  Sum-product messages go up from the leaves and down
from the root, which gives every node's exact marginal; the text runs of nodes
whose marginal is at least one half are the main text.

Training counts features and parent-child labels over labelled pages: the
pages' own semantic elements are the labels (``article`` and ``main`` are
content; navigation, headers, footers, asides, forms, adverts and comment
sections are not), plus ``EXAMPLES``, pages labelled by hand for layouts
without such elements.  The counts are additive, so every page takes part and
only the table of counts (a fixed set of features) reaches the driver.

Defined cases: a null, empty or contentless page gives an empty text; unclosed
and cut-off markup is closed at the page's end; repeated rows give repeated
rows; an empty table gives an empty result.
"""
from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.dom import Node, tree

CONTENT_TAGS = {"article", "main"}
# fixed values: elements, and words of class, id and role, that are not content
OTHER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
OTHER_WORDS = {"nav", "navbar", "navigation", "menu", "header", "footer", "sidebar", "ad", "ads", "advert", "advertisement", "banner",
               "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "comment", "comments",
               "reply", "replies", "respond", "disqus", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs",
               "newsletter", "subscribe", "signup", "login", "search", "form", "widget", "pagination", "copyright", "masthead",
               "contentinfo", "complementary", "dialog", "toolbar"}
CONTENT_WORDS = {"article", "content", "post", "entry", "story", "body", "main", "text", "page"}
# fixed values: name parts that say nothing of their own
NEUTRAL_WORDS = {"site", "page", "main", "top", "bottom", "left", "right", "box", "block", "bar", "area", "section", "container", "wrapper", "wrap",
                 "inner", "outer", "slot", "unit", "list", "item", "items", "links", "link", "button", "buttons", "row", "col", "global", "primary",
                 "secondary", "body", "content", "text", "posts", "post", "articles", "article", "the", "id", "js", "is", "has"}
_WORD = re.compile(r"[a-z]+")
_NAME = re.compile(r"[^\s]+")
NAME_BUCKETS = 4096

# pages labelled by hand: the text of content blocks starts with "C:"
EXAMPLES = (
    '<div class="header"><a href="/">x</a></div><div class="post-content"><h1>C:title</h1><p>C:{long}</p><p>C:{long}</p></div><div class="sidebar"><p>{short}</p></div>',
    '<div id="content"><p>C:{long}</p><div class="ad">{short}</div><p>C:{long}</p></div><div id="comments"><div class="comment"><p>{long}</p></div></div>',
    '<div class="cookie-notice"><p>{long}</p></div><div class="entry"><p>C:{long}</p><ul><li>C:{short}</li></ul></div><div class="footer">{short}</div>',
    '<section class="story-body"><h2>C:{short}</h2><p>C:{long}</p><blockquote>C:{long}</blockquote></section><section class="comments"><article class="comment"><p>{long}</p></article></section>',
    '<article><h1>C:{short}</h1><p>C:{long}</p><aside><p>{long}</p></aside><form><p>{short}</p></form><div class="share"><a href="/">{short}</a></div></article>',
    '<article><p>C:{long}</p><div class="advert"><p>{long}</p></div><div class="newsletter"><p>{short}</p></div><section class="comments"><p>{long}</p></section></article><div class="related"><ul><li><a href="/">{short}</a></li></ul></div>',
    '<div class="menu"><ul><li><a href="/">{short}</a></li></ul></div><main><p>C:{long}</p><table><tr><td>C:{short}</td></tr></table><footer><p>{short}</p></footer></main><div class="popup"><p>{short}</p></div>',
)
LONG, SHORT = "a sentence of some length, as articles have. " * 6, "a few words"
EXAMPLE_WEIGHT = 50  # a page labelled by hand counts as so many of each 5000 blocks
SMOOTH = 0.5
EDGES = tuple(f"{a}:{b}" for a in ("telling", "plain") for b in ("page", "0", "1"))


def _kinds(name: str) -> set[str]:
    """What a class, id or role says: other, content, or nothing."""
    parts = _WORD.findall(name)
    if any(p in OTHER_WORDS for p in parts):
        return {"other"} if all(p in OTHER_WORDS or p in NEUTRAL_WORDS for p in parts) else set()
    return {"content"} if any(p in CONTENT_WORDS for p in parts) else set()


@functools.lru_cache(1 << 16)
def names(words: str) -> tuple[str, frozenset]:
    """(what the names of an element say together, their hash buckets)."""
    found = _NAME.findall(words)
    kinds = set().union(*map(_kinds, found)) if found else set()
    said = kinds.pop() if len(kinds) == 1 else ""
    return said, frozenset(zlib.crc32(re.sub("[0-9]+", "", x).encode("utf-8", "replace")) % NAME_BUCKETS for x in found)


def features(n: Node) -> list[str]:
    said, buckets = names(n.words)
    size = sum(len(t) for _, t, _ in n.runs)
    links = sum(k for _, _, k in n.runs)
    out = [f"tag:{n.tag}", *(f"name:{x}" for x in sorted(buckets))]
    if said:
        out.append(f"{said} names")
    if size:
        out += [f"size:{min(4, int(math.log2(size + 1)) // 2)}", f"links:{0 if not links else 1 + (2 * links >= size)}"]
    return out


def edge_kind(nodes: list[Node], n: Node, parent_label: int) -> str:
    telling = n.tag in OTHER_TAGS or n.tag in CONTENT_TAGS or names(n.words)[0]
    return ("telling" if telling else "plain") + (":page" if n.parent == 0 else f":{parent_label}")


def weak_labels(nodes: list[Node]) -> list[int]:
    """1 content, 0 not, by the nearest telling ancestor or the node itself."""
    out = []
    for n in nodes:
        up = out[n.parent] if n.parent >= 0 else 0
        if n.tag in OTHER_TAGS or names(n.words)[0] == "other":
            out.append(0)
        elif n.tag in CONTENT_TAGS and not (n.parent >= 0 and _commenting(nodes, n.parent)):
            out.append(1)
        else:
            out.append(up)
    return out


def _commenting(nodes: list[Node], i: int) -> bool:
    while i >= 0:
        if names(nodes[i].words)[0] == "other" and set(_WORD.findall(nodes[i].words)) & {"comment", "comments", "replies"}:
            return True
        i = nodes[i].parent
    return False


def hand_labels(nodes: list[Node]) -> list[int]:
    """1 for nodes with content text, and for those all of whose text is content."""
    good, bad = [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        for _, t, _ in nodes[i].runs:
            good[i] += t.startswith("C:")
            bad[i] += not t.startswith("C:")
        p = nodes[i].parent
        if p >= 0:
            good[p] += good[i]
            bad[p] += bad[i]
    return [int(i > 0 and g > 0 and (g > b or names(n.words)[0] == "content" or n.tag in CONTENT_TAGS))
            for i, (n, g, b) in enumerate(zip(nodes, good, bad))]


def count(nodes: list[Node], labels: list[int], into: Counter, weight: int = 1) -> None:
    for n, y in zip(nodes, labels):
        if n.parent < 0:
            continue
        into["edge", edge_kind(nodes, n, labels[n.parent]), y] += weight
        into["all", "", y] += weight
        for f in features(n):
            into["feature", f, y] += weight


def train(pages: DataFrame, html_col: str = "html") -> dict:
    """The model: feature -> log odds, parent label -> log odds of the child."""
    def fn(batches):
        for b in batches:
            c: Counter = Counter()
            for t in b.column("html").to_pylist():
                nodes = tree(t or "")
                labels = weak_labels(nodes)
                if any(labels):
                    count(nodes, labels, c)
            if c:
                k = list(c)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k]), pa.array([x[1] for x in k]),
                                                  pa.array([x[2] for x in k], pa.int64()), pa.array([c[x] for x in k], pa.int64())],
                                                 names=["kind", "name", "label", "n"])

    got = (pages.select(F.col(html_col).alias("html")).mapInArrow(fn, "kind string, name string, label long, n long")
           .groupBy("kind", "name", "label").agg(F.sum("n").alias("n")))
    total: Counter = Counter()
    for r in got.collect():  # a fixed set of features
        total[r["kind"], r["name"], r["label"]] += r["n"]
    return fit(total)


def fit(total: Counter) -> dict:
    total = Counter(total)
    share = max(1, sum(n for (k, _, _), n in total.items() if k == "all") // 5000)
    for page in EXAMPLES:
        nodes = tree(page.format(long=LONG, short=SHORT))
        nodes_plain = tree(page.replace("C:", "").format(long=LONG, short=SHORT))
        count(nodes_plain, hand_labels(nodes), total, EXAMPLE_WEIGHT * share)
    names = {f for k, f, _ in total if k == "feature"}
    ones, zeros = total["all", "", 1], total["all", "", 0]
    odds = {f: math.log((total["feature", f, 1] + SMOOTH) / (ones + 2 * SMOOTH)) - math.log((total["feature", f, 0] + SMOOTH) / (zeros + 2 * SMOOTH))
            for f in sorted(names)}
    edge = {k: math.log((total["edge", k, 1] + SMOOTH) / (total["edge", k, 0] + SMOOTH)) for k in EDGES}
    return {"odds": odds, "edge": edge}


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """Log odds of content of every node, by messages up, then down the tree.
    The page node itself is not content."""
    odds = model["odds"]
    # p(child = 1 | parent) by kind of edge
    p = {k: 1 / (1 + math.exp(-e)) for k, e in model["edge"].items()}
    own = [sum(odds.get(f, 0.0) for f in features(n)) for n in nodes]
    n = len(nodes)
    q = [(0.5, 0.5)] + [(p[edge_kind(nodes, x, 0)], p[edge_kind(nodes, x, 1)]) for x in nodes[1:]]

    def through(x: float, a: float, b: float, c: float, d: float) -> float:
        """Message over an edge from belief log odds x: log of (a e^x + b) / (c e^x + d)."""
        if x > 0:
            t = math.exp(-min(x, 700))
            return math.log(a + b * t) - math.log(c + d * t)
        t = math.exp(max(x, -700))
        return math.log(a * t + b) - math.log(c * t + d)

    up, message = own[:], [0.0] * n
    for i in range(n - 1, 0, -1):
        q0, q1 = q[i]
        message[i] = through(up[i], q1, 1 - q1, q0, 1 - q0)
        up[nodes[i].parent] += message[i]
    out = [0.0] * n
    out[0] = -700.0
    for i in range(1, n):
        q0, q1 = q[i]
        above = out[nodes[i].parent] - (message[i] if nodes[i].parent else 0.0)
        out[i] = up[i] + through(above, q1, q0, 1 - q1, 1 - q0)
    return out


def main_text(source: str, model: dict) -> str:
    nodes = tree(source)
    score = marginals(nodes, model)
    runs = [r for n, s in zip(nodes, score) if s >= 0 for r in n.runs]
    return " ".join(t for _, t, _ in sorted(runs))


def extract(pages: DataFrame, model: dict, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for every row."""
    def fn(batches):
        for b in batches:
            src = b.column("html")
            for i in range(0, b.num_rows, 256):
                text = [main_text(t, model) if t else "" for t in src[i:i + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id")[i:i + 256], b.column("url")[i:i + 256], pa.array(text, pa.string())],
                                                 names=["page_id", "url", "text"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(fn, "page_id long, url string, text string")
