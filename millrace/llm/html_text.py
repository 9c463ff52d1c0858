"""Main text of HTML pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each the log-odds of being content, in two parts. The
first comes from the place: articles and main parts, the class and id words of ancestors, and elements and
roles of navigation, forms and the like. The second comes from the text: its share of characters in links, its
length, its end and its element; it is a logistic regression, fitted on a bounded sample of pages to the blocks
whose place says what they are, so it speaks for blocks whose place says nothing. The costs of either label are
the capacities to the two terminals. Smoothness edges join blocks that follow each other, weaker the farther
apart their parents are in the tree, and successive blocks of one container even where something else stands
between them. The minimum cut, by augmenting paths after direct flows are cancelled, separates content from
boilerplate; its content blocks are the text.

Null and empty pages, and pages without content, give an empty text. Markup may be broken: unclosed
elements end with their container, unmatched ends are ignored, an unclosed comment, script or style runs
to the end of the page. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|[^<]++|<", re.S)
_REST = re.compile(r"<!--.*|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "canvas", "audio", "video", "button"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = _BLOCK - {"html", "head", "body", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDARY = {"table", "ul", "ol", "dl", "article", "section", "div", "body", "main", "aside", "nav", "blockquote", "form"}
_BAD_TAG = {"nav", "aside", "footer", "form", "menu", "dialog", "search", "head", "fieldset"}
_BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar", "status"}
_BAD_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|header|masthead|topbar|footer|sidebar\w*|widgets?|related|recommend\w*|more-?stories|shar(?:e|ing)|social|comments?|commentlist|replies|reply|respond|discussion|disqus|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|signup|login|paywall|pagination|pager|toolbar|skip)(?=$|[\s_-])",
    re.I,
)
#: These are boilerplate only outside of articles.
_WEAK_WORD = re.compile(r"(?:^|[\s_-])(?:side|rail|search|copyright|legal|disclaimer|feedback|reviews?)(?=$|[\s_-])", re.I)
_GOOD_WORD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|posts?|entry|story|body|text|prose|maintext)(?=$|[\s_-])", re.I)
_SPACE = re.compile(r"\s+")


class Block:
    """A text, the odds that its place gives it, what the text says, and the elements around it."""

    __slots__ = ("text", "place", "features", "top")

    def __init__(self, text: str, place: float, features: tuple[float, ...], top: _Open) -> None:
        self.text, self.place, self.features, self.top = text, place, features, top


class _Open:
    __slots__ = ("tag", "up", "depth", "bad", "good", "article", "hidden")

    def __init__(self, tag, up, bad, good, article, hidden):
        self.tag, self.up, self.bad, self.good, self.article, self.hidden = tag, up, bad, good, article, hidden
        self.depth = up.depth + 1 if up else 0


def _enter(tag: str, attributes: str, above: _Open) -> _Open:
    bad, good, article, hidden = above.bad, above.good, above.article, above.hidden
    if tag in ("article", "main"):
        article = True
    own_bad = tag in _BAD_TAG or (tag == "header" and not article)
    if attributes:
        words = []
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                words.append(value)
            elif name == "role":
                own_bad |= value.lower() in _BAD_ROLE
                article |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
        if words and tag not in ("html", "body"):
            joined = " ".join(words)
            if (_BAD_WORD.search(joined) or (not article and _WEAK_WORD.search(joined))) and not (tag in ("article", "main") or (article and tag in ("h1", "header"))):
                own_bad = True
            elif _GOOD_WORD.search(joined):
                good = True
    return _Open(tag, above, bad + own_bad, good, article, hidden)


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    root = _Open("", None, 0, False, False, False)
    stack = [root]
    parts: list[str] = []
    linked = link = 0
    raw_until = None

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            top = stack[-1]
            if not top.hidden:
                links = min(1.0, linked / max(1, sum(map(len, parts))))
                out.append(Block(text, place_odds(top), text_features(top, text, links), top))
        parts.clear()
        linked = 0

    at, end_of_tags = 0, page.rfind(">")
    while at < len(page):
        if at > end_of_tags:  # nothing closes any more
            m = _REST.match(page, at)
        else:
            m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] if m.re is _TOKEN else None
        if tag is None:
            token = m[0]
            if token[0] != "<" or len(token) == 1:
                parts.append(token)
                if link:
                    linked += len(token)
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = 0
            elif tag == "br":
                parts.append(" ")
            elif tag in _BLOCK:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                if tag not in ("p", "li", "td", "th"):
                    link = 0
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 1
        elif tag in _BLOCK:
            flush()
            link = 0
            if tag in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag in _BOUNDARY:
                        break
            if tag in _SIBLING:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _SIBLING[tag]:
                        del stack[k:]
                        break
                    if stack[k].tag in _BOUNDARY:
                        break
            if tag not in _VOID:
                stack.append(_enter(tag, m[3], stack[-1]))
    flush()
    return out


_TEXT_TAGS = {"p", "blockquote", "pre"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ITEMS = {"li", "dd", "dt", "td", "th"}
#: Weights of text_features, and of smoothness, where a sample can't give any; bounds of the latter.
PRIOR = (-0.8, -4.0, 1.0, 0.5, -0.3, 1.0, 0.5, 0.0, 1.0)
SMOOTH = (0.5, 2.0)
#: Pages that the weights are fitted on, at most, and blocks of either kind that they need, at least.
SAMPLE_PAGES, LEAST_BLOCKS = 2000, 50


def place_odds(place: _Open) -> float:
    return 5.0 * place.article + 2.0 * place.good - 9.0 * min(place.bad, 2)


def text_features(place: _Open, text: str, links: float) -> tuple[float, ...]:
    words = text.count(" ") + 1
    ends = text[-1] in ".!?…:;\"”»"
    return (1.0, links, min(2.0, words / 12), float(ends), float(words < 4), float(place.tag in _TEXT_TAGS), float(place.tag in _HEADS), float(place.tag in _ITEMS))


def odds(block: Block, weights: tuple[float, ...] = PRIOR) -> float:
    # Articles hold links to where they quote; elsewhere links are lists of them.
    own = sum(w * x for w, x in zip(weights, block.features))
    return block.place + own - (weights[1] * block.features[1] * 0.75 if block.top.article else 0.0)


def fit(pages: DataFrame) -> tuple[float, ...]:
    """Weights for pages (page_id, html), from blocks that their place labels: logistic regression for the text, and
    for smoothness half the log-odds with which siblings that follow each other have one label."""
    spark = pages.sparkSession
    shared.bound_batches(spark)
    ids = pages.select(F.xxhash64(F.col("page_id").cast("string")).alias("h")).orderBy("h").limit(SAMPLE_PAGES).distinct()
    ids = spark.createDataFrame([(r.h,) for r in ids.collect()], "h long")
    sample = pages.withColumn("h", F.xxhash64(F.col("page_id").cast("string"))).join(F.broadcast(ids), "h").groupBy("h").agg(F.min("html").alias("html")).select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column(0).to_pylist():
                found = [b for b in blocks(page or "") if b.place]
                for b in found:
                    counts[tuple(round(x, 2) for x in b.features), int(b.place > 0)] += 1
                for a, b in zip(found, found[1:]):
                    if a.top.up is b.top.up:
                        counts[(), int((a.place > 0) == (b.place > 0))] += 1
            yield pa.record_batch([pa.array([list(k[0]) for k in counts], pa.list_(pa.float64())), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["x", "y", "n"])

    rows = sample.mapInArrow(run, "x array<double>, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).orderBy("x", "y").collect()
    pairs = {r.y: r.n for r in rows if not r.x}
    rows = [r for r in rows if r.x]
    k = len(PRIOR) - 1
    x, y, n = np.array([r.x for r in rows]).reshape(-1, k), np.array([r.y for r in rows], float), np.array([r.n for r in rows], float)
    if min(n[y == 1].sum(), n[y == 0].sum()) < LEAST_BLOCKS:
        return PRIOR
    n = np.where(y == 1, 0.5 / n[y == 1].sum(), 0.5 / n[y == 0].sum()) * n  # both kinds weigh the same
    theta, prior, keep = np.array(PRIOR[:k]), np.array(PRIOR[:k]), 0.01
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (n * (y - p)) - keep * (theta - prior)
        theta = theta + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + keep * np.eye(k), grad)
    smooth = 0.5 * math.log((pairs.get(1, 0) + 1) / (pairs.get(0, 0) + 1))
    return (*(float(t) for t in theta), min(max(smooth, SMOOTH[0]), SMOOTH[1]))


def minimum_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut; edges have one capacity both ways."""
    excess = [a - b for a, b in zip(to_source, to_sink)]  # flow straight through a node is no choice
    if all(x >= 0 for x in excess) or all(x <= 0 for x in excess):
        return [x > 0 for x in excess]
    near: list[dict[int, float]] = [{} for _ in excess]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    for s in range(len(excess)):
        while excess[s] > 1e-12:
            back = {s: s}
            queue = deque([s])
            end = None
            while queue and end is None:
                u = queue.popleft()
                for v, c in near[u].items():
                    if c > 1e-12 and v not in back:
                        back[v] = u
                        if excess[v] < -1e-12:
                            end = v
                            break
                        queue.append(v)
            if end is None:
                break
            path, v = [], end
            while v != s:
                path.append((back[v], v))
                v = back[v]
            flow = min(excess[s], -excess[end], *(near[u][v] for u, v in path))
            for u, v in path:
                near[u][v] -= flow
                near[v][u] = near[v].get(u, 0.0) + flow
            excess[s] -= flow
            excess[end] += flow
    side = [x > 1e-12 for x in excess]
    queue = deque(i for i, x in enumerate(side) if x)
    while queue:
        u = queue.popleft()
        for v, c in near[u].items():
            if c > 1e-12 and not side[v]:
                side[v] = True
                queue.append(v)
    return side


def _apart(a: _Open, b: _Open) -> int:
    """Steps in the tree from one element to another."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def labelled(page: str | None, weights: tuple[float, ...] = PRIOR) -> list[tuple[Block, float, bool]]:
    """Each block with its odds and the label of the minimum cut."""
    found = blocks(page or "")
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, weights[-1] * 2.0 ** (1 - max(2, _apart(found[i - 1].top, b.top)) / 2)))
        container = id(b.top.up)
        if container in last and last[container] < i - 1:
            edges.append((last[container], i, weights[-1] / 4))
        last[container] = i
    own = [odds(b, weights) for b in found]
    soft = [math.log1p(math.exp(-abs(x))) for x in own]
    keep = minimum_cut([max(x, 0.0) + s for x, s in zip(own, soft)], [max(-x, 0.0) + s for x, s in zip(own, soft)], edges)
    return list(zip(found, own, keep))


def main_text(page: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    return "\n\n".join(b.text for b, _, k in labelled(page, weights) if k)


def extract(column: Column, weights: tuple[float, ...] = PRIOR) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return run(column)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    rows = pages.select("page_id", "url", extract(F.col("html"), fit(pages)).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
