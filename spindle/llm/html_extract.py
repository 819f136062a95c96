"""Operator 9: main text of web pages by gradient-boosted trees over DOM nodes.

Every block of text and every element around one is a node with features: depth, subtree text, tag and link density, attribute tokens,
position and sibling statistics.  Boosted trees (Spark ML) give the log-odds that the node belongs to the main text; a dynamic program over the
tree then takes the most likely labelling in which no kept node has a dropped ancestor.

The trees learn from at most ``SAMPLE_PAGES`` pages.  There the mark-up's own semantics (article, main, nav, footer, aside, form, ...) give
the labels; each page is also learned from with those elements renamed to plain containers and with boilerplate moved into it, so that
the trees rely on densities, siblings and attribute tokens as well.

Defined cases: null or empty html, or html without text, gives an empty text; malformed mark-up is read leniently; without any page that shows
its main element all nodes are judged by the fallback rule of the labels; rows repeat as they do in the input; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import cut, scratch_root

SAMPLE_PAGES = 400  #: pages that the trees learn from, at most
TREES, DEPTH = 20, 5
TOGETHER = 200  #: pages whose nodes are judged in one go

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S
)
SPACES = re.compile(r"\s+")
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORDS_IN_NAMES = re.compile(r"[a-z]+")

# Fixed values of the HTML standard: elements by kind.
RAW = {"script", "style", "template", "iframe", "textarea", "title", "select", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "li", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "button", "label", "legend", "option",
}
CLOSED_BY_SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                  "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
KEEPS_P = {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "label", "button", "legend", "summary"}

# Words in names of elements that speak for or against main text.
AGAINST = {"ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
           "sidebar", "aside", "widget", "related", "recommended", "footer", "foot", "copyright", "legal", "header", "masthead", "topbar", "cookie",
           "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing",
           "social", "comment", "comments", "reply", "replies", "disqus", "discussion", "tags", "pagination", "pager", "search", "form", "contentinfo",
           "complementary", "toolbar", "skip"}
FOR = {"article", "articlebody", "content", "main", "post", "entry", "story", "body", "text", "prose", "page"}
LISTS = {"ul", "ol", "li", "dl"}
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "footer", "aside", "header", "form", "menu", "button", "label", "legend", "fieldset", "dialog", "head", "option", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}


class Page:
    """Block nodes of a page in document order; a node's parent comes before it."""

    def __init__(self, html: str):
        self.tag, self.parent, self.depth, self.text, self.link, self.names, self.tags = ["#root"], [-1], [0], [""], [0], [set()], [0]
        self._read(html or "")

    def _node(self, tag: str, parent: int, names: set[str]) -> int:
        for column, x in ((self.tag, tag), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.text, ""), (self.link, 0), (self.names, names), (self.tags, 0)):
            column.append(x)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        """One pass; what is open is found by name, so that unclosed or stray tags cost no search through the open elements."""
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the block node each belongs to
        places: dict[str, list[int]] = {}  # where in the stack each tag is open
        blocks: list[int] = [0]  # where blocks are
        firm: list[int] = [0]  # the same without paragraphs
        unended: set[str] = set()  # raw elements that no end tag follows any more
        run: list[str] = []
        linked, at, last = 0, 0, html.rfind(">") + 1  # no tag ends behind ``last``

        def flush() -> None:
            nonlocal linked
            text = SPACES.sub(" ", unescape("".join(run))).strip()
            run.clear()
            if text:
                node = self._node("#text", stack[-1][1], set())
                self.text[node], self.link[node] = text, min(linked, len(text))
            linked = 0

        def add(start: int, stop: int) -> None:
            nonlocal linked
            if stop > start:
                run.append(html[start:stop])
                if places.get("a"):
                    linked += stop - start

        def push(tag: str, node: int) -> None:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
                if tag != "p":
                    firm.append(len(stack))
            stack.append((tag, node))

        def cut_at(k: int) -> None:
            while len(stack) > k:
                places[stack.pop()[0]].pop()
            for held in (blocks, firm):
                while held[-1] >= k:
                    held.pop()

        def top(tags: Iterable[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        while m := TOKEN.search(html, at, last):
            add(at, m.start())
            at = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(html)
                    break
                continue
            closing, tag, rest = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
            if tag in RAW and not closing:
                if not rest.rstrip().endswith("/"):
                    end = None if tag in unended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    if end:
                        at = end.end()
                    else:
                        unended.add(tag)
                        at = len(html) if tag in ("script", "style") else at
                run.append(" ")
            elif tag in VOID or tag in RAW:
                self.tags[stack[-1][1]] += 1
                if tag == "hr":
                    flush()
                elif tag == "br":
                    run.append(" ")
            elif closing:
                k = top((tag,))
                if k and (tag in BLOCK or k > blocks[-1]):  # a stray end of an inline element doesn't leave its block
                    if blocks[-1] >= k:
                        flush()
                    cut_at(k)
            elif tag in BLOCK:
                flush()
                k = top(CLOSED_BY_SAME.get(tag, set()) | (set() if tag in KEEPS_P else {"p"}))
                if k and k >= (top(SCOPES[tag]) if tag in SCOPES else firm[-1]):
                    cut_at(k)
                push(tag, self._node(tag, stack[-1][1], names_of(rest)))
            else:
                self.tags[stack[-1][1]] += 1
                push(tag, stack[-1][1])
        comment = html.find("<!--", at)
        add(at, len(html) if comment < 0 else comment)
        flush()


def names_of(rest: str) -> set[str]:
    if "=" not in rest:
        return set()
    return {w for m in NAMED.finditer(rest) for w in WORDS_IN_NAMES.findall((m[1] or m[2] or m[3] or "").lower())}


FEATURE_NAMES = [
    "depth", "chars", "words", "link_share", "density", "blocks", "own_against", "own_for", "up_against", "up_for", "heading", "list", "paragraph",
    "side_tag", "main_tag", "up_side", "up_main", "text", "place", "siblings", "same_siblings", "sibling_chars", "share_of_parent", "stops", "share_of_page",
]


def features(page: Page) -> list[tuple[float, ...]]:
    """One row for each node; the root's is empty."""
    n, parent, tag, names = len(page.tag), page.parent, page.tag, page.names
    chars, links = [len(t) for t in page.text], list(page.link)
    stops, words = [t.count(".") + t.count(",") for t in page.text], [t.count(" ") + 1 if t else 0 for t in page.text]
    tags, blocks = [k + 1 for k in page.tags], [int(t == "#text") for t in tag]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for column in (chars, links, stops, tags, blocks, words):
            column[p] += column[k]
    kids, kid_chars = [0] * n, [0] * n
    alike: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        p = parent[k]
        kids[p] += 1
        kid_chars[p] += chars[k]
        alike[p, tag[k]] = alike.get((p, tag[k]), 0) + 1
    out: list[tuple[float, ...]] = [(0.0,) * len(FEATURE_NAMES)]
    up = [(0.0, 0.0, 0.0, 0.0)]
    seen, total = 0, max(1, chars[0])
    for k in range(1, n):
        p, t, own_names = parent[k], tag[k], names[k]
        above, around, size = up[p], tag[p], max(1, chars[k])
        if own_names or t in SIDE_TAGS or t in MAIN_TAGS:
            own = (float(not AGAINST.isdisjoint(own_names)), float(not FOR.isdisjoint(own_names)), float(t in SIDE_TAGS), float(t in MAIN_TAGS))
            up.append(tuple(map(max, above, own)))
        else:
            own = up[0]
            up.append(above)
        out.append((
            page.depth[k], log1p(chars[k]), log1p(words[k]), links[k] / size, log1p(chars[k] / tags[k]), log1p(blocks[k]), own[0], own[1], above[0], above[1],
            float(t in HEADINGS or around in HEADINGS), float(t in LISTS or around == "li"), float(t == "p" or around == "p"), own[2], own[3], above[2], above[3],
            float(t == "#text"), seen / total, log1p(kids[p]), log1p(alike[p, t]), log1p((kid_chars[p] - chars[k]) / max(1, kids[p] - 1)), chars[k] / max(1, chars[p]),
            stops[k] / max(1, words[k]), chars[k] / total,
        ))
        if t == "#text":
            seen += chars[k]
    return out


def labels(page: Page) -> np.ndarray | None:
    """1 for nodes of the main text and around it, judged by semantic mark-up; None where the page shows no main element."""
    n = len(page.tag)
    good, bad = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(1, n):
        p = page.parent[k]
        against = bool(page.names[k] & AGAINST) or page.tag[k] in SIDE_TAGS
        bad[k] = bad[p] or (against and page.tag[k] not in MAIN_TAGS)
        good[k] = (good[p] or page.tag[k] in MAIN_TAGS or MARK in page.names[k] or bool(page.names[k] & {"main", "articlebody"})) and not bad[k]
    if not good.any():
        return None
    keep = good.copy()
    for k in range(n - 1, 0, -1):
        keep[page.parent[k]] |= keep[k]
    return keep.astype(float)


MARK = "spindlemain"  #: names the main element of a disguised page; no feature looks at it
DISGUISES = ["div class=content", "section", "div", "div class=post", "td", "div id=main-content", "div class=story"]
SIDES = ["div class=menu", "div", "div class=footer", "ul class=navigation", "div class=header", "section class=sidebar"]
BOILERPLATE = ["div class=sidebar", "div class=comments", "div id=cookie-notice", "div class=related", "aside", "div class=newsletter", "section class=comment-list",
               "div class=share", "div class=promo", "form", "header", "div class=advert", "div class=breadcrumb", "div class=login", "footer", "div class=ad"]
SHAPES = ["<p>{0}</p>", "<p>{0}</p><p>{1}</p>", "{0}", "<h3>{0}</h3><p>{1}</p>", "<ul><li>{0}</li><li>{1}</li></ul>", "<div><p><b>{0}</b> {1}</p></div>", "<a href=x>{0}</a>"]
MAIN_TAG = re.compile(r"<(/?)(?:article|main)\b[^>]*>", re.I)
SIDE_TAG = re.compile(r"<(/?)(?:nav|footer|aside)\b[^>]*>", re.I)


def disguised(html: str, texts: list[str], turn: int) -> str:
    """The page with its telling elements renamed, and with boilerplate made of its own texts before, inside and after the main element."""
    main, side = DISGUISES[turn % len(DISGUISES)], SIDES[turn // 2 % len(SIDES)]

    def box(k: int) -> str:
        what = BOILERPLATE[(turn + 5 * k) % len(BOILERPLATE)]
        found = [texts[(turn * 7 + 3 * k + j) % len(texts)].replace("<", "&lt;") for j in range(2)]
        return f"<{what}>{SHAPES[(turn // 3 + k) % len(SHAPES)].format(*found)}</{what.split()[0]}>"

    if not texts:
        return html
    named = main.replace("class=", f"class={MARK}-") if "class=" in main else f"{main} class={MARK}"
    html = SIDE_TAG.sub(lambda m: f"</{side.split()[0]}>" if m[1] else f"<{side}>", html)
    inside = box(0) if turn % 2 else ""
    return MAIN_TAG.sub(lambda m: f"{inside}</{main.split()[0]}>{box(1)}{box(2)}" if m[1] else f"{box(3)}{box(4)}<{named}>", html)


def learned_rows(pages: DataFrame) -> DataFrame:
    """``(label, x)`` of the nodes of the sampled pages, as they are and disguised."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, xs = [], []
            for h, turn in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                page = Page(h.as_py() or "")
                keep = labels(page)
                if keep is None:
                    continue
                texts = [t for t, ok in zip(page.text, keep, strict=True) if ok and t] or [t for t in page.text if t]
                versions = [page, *(Page(disguised(h.as_py(), texts, turn + k)) for k in (0, 1, 4))]
                for version in versions:
                    keep = labels(version)
                    if keep is not None:
                        marks += keep[1:].tolist()
                        xs += features(version)[1:]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.float64()), pa.array(xs, pa.list_(pa.float64()))], names=["label", "x"])

    picked = pages.select("page_id", "html").withColumn("_h", F.xxhash64("page_id"))
    ids = picked.select("page_id", "_h").where("page_id is not null").distinct().orderBy("_h", "page_id").limit(SAMPLE_PAGES)
    rows = picked.drop("_h").join(F.broadcast(ids), "page_id")
    return cut(rows.select("html", F.pmod("_h", F.lit(1009)).cast("int").alias("turn")).mapInArrow(run, "label double, x array<double>"), "dom")


class Forest:
    """Boosted trees as arrays: feature, threshold, children and value of each node."""

    def __init__(self, trees: list[tuple[float, list]]):
        self.trees = []
        for weight, nodes in trees:
            nodes = sorted(nodes, key=lambda x: x["id"])
            self.trees.append((weight, *(np.array([x[c] for x in nodes]) for c in ("feature", "threshold", "left", "right", "value"))))

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                inner = left[at] >= 0
                lower = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(lower, left[at], right[at]), at)
            total += weight * value[at]
        return 2 * total


def fit(pages: DataFrame) -> Forest | None:
    rows = learned_rows(pages)
    seen = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(seen) < 2:
        return None
    spark = pages.sparkSession
    train = rows.select("label", array_to_vector("x").alias("features")).coalesce(2).persist()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(train)
    train.unpersist()
    path = f"{scratch_root(spark)}/spindle/trees-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", F.col("nodeData.*")).select(
        "treeID", "id", F.col("split.featureIndex").alias("feature"), F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("value"),
    ).collect()  # fmt: skip  # TREES trees of DEPTH levels
    return Forest([(w, [r.asDict() for r in nodes if r["treeID"] == k]) for k, w in enumerate(model.treeWeights)])


def decode(page: Page, odds: list[float]) -> list[bool]:
    """The most likely labels of the nodes under which a kept node has kept ancestors only."""
    n, parent = len(page.tag), page.parent
    best = [x * (1.0 + log1p(len(t))) for x, t in zip(odds, page.text, strict=True)]
    for k in range(n - 1, 0, -1):
        if best[k] > 0:
            best[parent[k]] += best[k]
    keep = [True] * n
    for k in range(1, n):
        keep[k] = keep[parent[k]] and best[k] > 0
    return keep


def by_rule(page: Page) -> list[bool]:
    """What the labels' own rule keeps, for want of trees."""
    found = labels(page)
    keep = [x > 0 for x in found] if found is not None else [not (names & AGAINST) and t not in SIDE_TAGS for names, t in zip(page.names, page.tag, strict=True)]
    for k in range(1, len(keep)):
        keep[k] = keep[k] and keep[page.parent[k]]
    return keep


def main_texts(htmls: list[str], forest: Forest | None) -> list[str]:
    pages = [Page(h) for h in htmls]
    if forest is None:
        kept = [by_rule(p) for p in pages]
    else:
        odds = forest.odds(np.array([row for p in pages for row in features(p)], dtype=float).reshape(-1, len(FEATURE_NAMES))).tolist()
        kept, at = [], 0
        for p in pages:
            kept.append(decode(p, odds[at : at + len(p.tag)]))
            at += len(p.tag)
    out = []
    for p, keep in zip(pages, kept, strict=True):
        bare = all(t == "#text" for t in p.tag[1:])  # no mark-up: the text is all there is
        out.append("\n".join(t for t, ok in zip(p.text, keep, strict=True) if t and (ok or bare)))
    return out


def main_text(html: str, forest: Forest | None) -> str:
    return main_texts([html], forest)[0]


def extract(pages: DataFrame, forest: Forest | None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def text(htmls):  # noqa: ANN001, ANN202
        import pandas as pd

        found = [h or "" for h in htmls]
        return pd.Series([t for k in range(0, len(found), TOGETHER) for t in main_texts(found[k : k + TOGETHER], shared.value)], dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
