"""Main text of pages: flat text blocks, classified by a decision tree over shallow features."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<skip>script|style|textarea)\b[^>]*>.*?(?:</(?P=skip)\s*>|\Z)|<title\b[^>]*>[^<]*(?:</title\s*>)?"
    r"|<(?P<part>noscript|template|svg|iframe|select|object)\b[^>]*>.*?</(?P=part)\s*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Kinds of elements, and what class names say.
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("div section article main aside nav header footer form ul ol dl table blockquote figure dialog details fieldset menu body button".split())
FURNITURE_TAGS = set("nav footer aside form dialog menu button".split())
FURNITURE = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal "
    "newsletter subscribe subscription share sharing social sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments disqus respond reply related recommended recommendations pagination pager widget login signup search toolbar copyright".split()
)
ARTICLE = set("article content entry post story".split())
# What others say of an article, or beside it: never the page itself, however long.
BESIDE = set("comment comments disqus respond reply related recommended recommendations".split())
WHOLE_TAGS = set("body main".split())
# A small labelled table: words and link density of the block before, the block itself and the block after, whether it lies in an
# element named as furniture, whether in an article, and whether it is main text.
LABELLED = [
    (0, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0), (4, 1.0, 6, 1.0, 30, 0.0, 0, 0, 0), (6, 1.0, 8, 0.9, 8, 1.0, 0, 0, 0), (3, 0.0, 2, 0.5, 3, 0.0, 0, 0, 0),
    (40, 0.0, 60, 0.0, 35, 0.1, 0, 0, 1), (12, 0.0, 80, 0.02, 5, 1.0, 0, 0, 1), (60, 0.0, 20, 0.0, 70, 0.0, 0, 0, 1), (50, 0.05, 9, 0.0, 45, 0.0, 0, 0, 1),
    (8, 0.0, 25, 0.1, 40, 0.0, 0, 0, 1), (30, 0.0, 35, 0.6, 3, 1.0, 0, 0, 0), (5, 0.8, 12, 0.0, 4, 0.9, 0, 0, 0), (2, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0),
    (0, 0.0, 10, 0.0, 40, 0.0, 0, 1, 1), (10, 0.0, 3, 0.0, 50, 0.0, 0, 1, 1), (50, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1), (1, 0.0, 1, 0.0, 12, 0.0, 0, 1, 1),
    (60, 0.0, 120, 0.1, 0, 0.0, 0, 1, 1), (30, 0.0, 12, 0.7, 20, 0.0, 0, 1, 1), (20, 0.0, 5, 1.0, 30, 0.0, 0, 1, 1), (4, 0.0, 200, 0.0, 9, 0.0, 0, 1, 1),
    (50, 0.0, 40, 0.0, 60, 0.0, 1, 0, 0), (0, 0.0, 3, 1.0, 3, 1.0, 1, 0, 0), (10, 0.0, 25, 0.0, 0, 0.0, 1, 0, 0), (3, 1.0, 12, 0.0, 20, 0.0, 1, 0, 0),
    (40, 0.0, 30, 0.0, 40, 0.0, 1, 1, 0), (50, 0.0, 8, 0.0, 60, 0.0, 1, 1, 0), (20, 0.0, 90, 0.0, 15, 0.0, 1, 1, 0), (5, 0.0, 2, 1.0, 6, 0.0, 1, 1, 0),
    (0, 0.0, 4, 1.0, 4, 1.0, 0, 1, 1), (4, 1.0, 4, 1.0, 4, 1.0, 0, 1, 1), (6, 1.0, 7, 1.0, 0, 0.0, 0, 1, 1), (3, 1.0, 9, 0.8, 5, 0.6, 0, 1, 1),
    (1, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1), (0, 0.0, 2, 0.0, 2, 0.0, 0, 1, 1), (7, 0.5, 6, 0.0, 0, 0.0, 0, 1, 1), (9, 0.9, 15, 0.9, 9, 0.9, 0, 1, 1),
    (100, 0.0, 30, 1.0, 90, 0.0, 0, 1, 1), (3, 0.0, 300, 0.3, 2, 0.0, 0, 1, 1), (12, 0.0, 14, 0.0, 400, 0.0, 0, 1, 1), (1, 1.0, 6, 0.0, 1, 1.0, 0, 1, 1),
    (60, 0.0, 70, 0.0, 60, 0.0, 1, 0, 0), (0, 0.0, 200, 0.0, 0, 0.0, 1, 0, 0), (30, 0.0, 15, 0.0, 150, 0.0, 1, 1, 0), (80, 0.0, 300, 0.0, 80, 0.0, 1, 1, 0),
    (5, 0.0, 45, 0.1, 50, 0.0, 1, 0, 0), (90, 0.0, 22, 0.0, 33, 0.0, 1, 1, 0), (15, 0.0, 60, 0.05, 0, 0.0, 1, 1, 0), (35, 0.0, 110, 0.0, 7, 0.0, 1, 0, 0),
    (0, 0.0, 120, 0.0, 0, 0.0, 0, 0, 1), (0, 0.0, 40, 0.0, 50, 0.0, 0, 0, 1), (2, 1.0, 60, 0.0, 70, 0.05, 0, 0, 1), (5, 0.9, 45, 0.1, 4, 1.0, 0, 0, 1),
    (12, 1.0, 6, 1.0, 20, 1.0, 0, 0, 0), (60, 0.0, 5, 0.0, 3, 1.0, 0, 0, 0), (25, 0.9, 30, 0.8, 30, 0.9, 0, 0, 0), (9, 0.0, 7, 0.0, 5, 0.0, 0, 0, 0),
]


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None
    label: bool = False


def train_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 5) -> Node:
    """Binary splits that lessen the Gini impurity most; the first feature and cut in a tie."""
    if depth == 0 or labels.all() or not labels.any():
        return Node(label=2 * labels.sum() > len(labels))
    impurity = lambda y: len(y) * (m := y.mean()) * (1 - m) if len(y) else 0.0
    best = (impurity(labels) - 1e-9, -1, 0.0)
    for j in range(rows.shape[1]):
        values = np.unique(rows[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            low = rows[:, j] < cut
            cost = impurity(labels[low]) + impurity(labels[~low])
            if cost < best[0] - 1e-12:
                best = (cost, j, float(cut))
    _, j, cut = best
    if j < 0:
        return Node(label=2 * labels.sum() > len(labels))
    low = rows[:, j] < cut
    return Node(j, cut, train_tree(rows[low], labels[low], depth - 1), train_tree(rows[~low], labels[~low], depth - 1))


def classify(node: Node, rows: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(rows), node.label)
    low = rows[:, node.feature] < node.cut
    out = np.zeros(len(rows), bool)
    out[low], out[~low] = classify(node.left, rows[low]), classify(node.right, rows[~low])
    return out


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role name furniture, an article, and whether the furniture may be beside the article only."""
    values = [m[1].strip("\"'").lower() for m in ATTRIBUTE.finditer(attributes)]
    # "has-sidebar" says what a page has, not what the element is.
    names = [n for v in values for n in v.split() if not n.startswith(("has-", "with-", "no-"))]
    words = {w for n in names for w in re.split(r"[^a-z]+", n)}
    bad, good = words & FURNITURE, bool(words & ARTICLE)
    return bool(bad - {"header", "side", "menu"}) or bool(bad) and not good, (good and not bad) or "main" in words, bool(bad & BESIDE)


@dataclass
class Element:
    """An open element: whether it is furniture, an article, and what decides if it is the page itself after all."""

    tag: str
    bad: bool
    good: bool
    beside: bool = False
    closed: bool = False
    words: int = 0
    has_article: bool = False

    def is_furniture(self, total: int) -> bool:
        """Named so, unless it holds most of the page's words together with an article, or was never closed."""
        if not self.bad or self.beside:
            return self.bad
        return not (2 * self.words > total and (self.has_article or not self.closed))


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, in furniture, in an article) of every block with text, in page order."""
    out: list[tuple[str, int, int, bool, list[Element]]] = []
    stack: list[Element] = []
    text: list[str] = []
    linked: list[str] = []
    in_link = 0
    leaf_bad = False

    def end_block() -> None:
        nonlocal text, linked
        clean = re.sub(r"\s+", " ", html.unescape("".join(text))).strip()
        if clean:
            words = len(clean.split())
            links = min(words, len(html.unescape("".join(linked)).split()))
            for element in stack:
                element.words += words
            out.append((clean, words, links, leaf_bad, list(stack)))
        text, linked = [], []

    at = 0
    for m in MARKUP.finditer(page):
        piece = page[at : m.start()]
        at = m.end()
        if piece:
            text.append(piece)
            if in_link:
                linked.append(piece)
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"])
        if tag == "a":
            in_link = 0 if closing else 1
            linked.append(" ")
        elif tag == "br":
            text.append(" ")
        elif tag not in INLINE:
            end_block()
            leaf_bad = False
            if tag in CONTAINERS:
                in_link = 0
                if closing:
                    names = [e.tag for e in stack]
                    if tag in names:
                        last = len(names) - 1 - names[::-1].index(tag)
                        stack[last].closed = True
                        del stack[last:]
                elif not m["attrs"].endswith("/"):
                    bad, good, beside = _named(m["attrs"])
                    inside = any(e.good for e in stack)
                    bad = tag not in WHOLE_TAGS and (bad or tag in FURNITURE_TAGS or (tag == "header" and not inside))
                    stack.append(Element(tag, bad, good or tag in ("article", "main"), beside))
                    if stack[-1].good and not bad:
                        for element in stack[:-1]:
                            element.has_article = True
            elif not closing:
                leaf_bad = _named(m["attrs"])[0]
    if at < len(page):
        text.append(page[at:])
    end_block()
    total = sum(words for _, words, *_ in out)
    return [(t, w, k, leaf or any(e.is_furniture(total) for e in around), any(e.good for e in around)) for t, w, k, leaf, around in out]


def features(found: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    own = np.array([(w, k / w) for _, w, k, _, _ in found]).reshape(-1, 2)
    none = np.zeros((1, 2))
    flags = np.array([(b, a) for *_, b, a in found], float).reshape(-1, 2)
    return np.hstack([np.vstack([none, own[:-1]]), own, np.vstack([own[1:], none]), flags])


def _extracted(tree: Node):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [blocks(p or "") for p in part["html"]]
            every = [b for page in found for b in page]
            main = classify(tree, np.vstack([features(page) for page in found if page])) if every else np.zeros(0, bool)
            cuts = np.r_[0, np.cumsum([len(page) for page in found])]
            texts = ["\n".join(b[0] for b, keep in zip(page, main[a:z]) if keep) for page, a, z in zip(found, cuts, cuts[1:])]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": np.diff(cuts)})

    return run


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, url, text, n_chars and n_blocks of every row: its main text, a block a line.

    A page falls into blocks at every element that is not inline; scripts, styles, comments and the
    title are dropped, references decoded and white space made single. A decision tree, trained on the table
    ``LABELLED``, judges each block by the words and link density of itself and both neighbours, and by whether the
    elements around it are named as furniture or as an article. Unclosed elements end with the one around them. Body and main
    are never furniture, and no element that holds most of the words together with an article, or that is never closed.
    A null or empty page, or one without main text, gives ``""``. Null keys and repeated rows keep
    their rows; other columns are ignored.
    """
    table = np.array(LABELLED, float)
    tree = train_tree(table[:, :-1], table[:, -1] > 0)
    kind = dict(pages.dtypes)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    schema = f"page_id {kind[key]}, url {kind[url]}, text string, n_chars long, n_blocks long"
    out = rows.mapInPandas(_extracted(tree), schema)
    return out.withColumnsRenamed({"page_id": key, "url": url})
