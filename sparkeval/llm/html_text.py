"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks in a tree of elements. A logistic classifier turns the look of a block's text (length, links, sentence end, commas,
capitals, digits) into log-odds, the terminal capacities: what calling it content or boilerplate costs. Smoothness edges tie blocks that follow each other or share
an element, stronger the closer they are in the element tree, and tie each block to the container around it that says what it holds (an article; a menu, a footer, a
form, something named so), which is a node on one side for good. The cheapest labelling is a minimum cut between the two terminals,
found by maximum flow. The classifier never sees containers or names: on a sample of the pages, blocks inside such containers give it its labels, and how much neighbours
weigh is chosen on other pages of the sample with all containers hidden.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import read, stage

# a < outside quotes ends a tag that has no >, so that no text is looked at from each of many tags
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|select)\b(?:(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<>]*+>).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^<>]*+>"
    r"|<[!?][^<>]*+>"
    r"|<[/!?a-zA-Z][^<>]*+\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME = re.compile(r"[a-z]+")
# fixed lists: elements that end a block, that never close, and that close an open paragraph
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td tfoot th thead title tr ul".split()
)
VOID = frozenset("hr".split())
LIST_LIKE = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}
SCOPES = frozenset("article aside blockquote body div dl fieldset footer form header main menu nav ol section table ul".split())
# what containers weigh: an element inside another one of ill repute stays there
CONTAINERS = frozenset("nav menu footer form button aside dialog fieldset label option head title".split())
SEED = 20.0  # a tie to a container that no other ties outweigh
ARTICLE, MAIN, GOOD_NAME = 2.5, 1.5, 1.0  # to an article that is not the page's core, to main, to a good name
OWN = {"h1": 1.5, "p": 0.5}  # to the element itself
BYLINE = -2.0  # what stands in an article's own header and is no heading
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# the classifier's features and the weights that it starts from and that a small sample leaves it near
LONG, MOST_ODDS = 250, 3.0
PRIOR = {"bias": -0.8, "length": 3.5, "links": -5.0, "sentence": 1.0, "commas": 0.3, "capitals": 0.0, "digits": -0.5}
NAMES = list(PRIOR)
SAMPLE_PAGES, SAMPLE_BLOCKS, PULL = 2000, 20_000, 5.0  # pages and blocks of the sample, and what its pull to PRIOR weighs in blocks
SCALES = (0.0, 0.5, 1.0, 2.0, 4.0)  # of the ties between neighbours
# fixed lists: words of class names and the like that speak against a container, for it, or only of the page's state
BAD_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form "
    "gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup popular promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar tracking warning widget widgets contentinfo complementary".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
STATE_FIRST, STATE_LAST = frozenset("has is no with without".split()), frozenset("closed disabled enabled layout off on open page template".split())
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
# most that smoothness can weigh, halved with each step in the element tree
ADJACENT, SIBLING = 0.8, 0.6


class Node:
    """An element: its tag, what its attributes say, and what lies around it."""

    __slots__ = ("tag", "parent", "depth", "names", "hidden", "ill", "length", "core", "bonus", "bad", "byline")

    def __init__(self, tag: str, parent: Node | None, names: int, hidden: bool):
        self.tag, self.parent, self.names, self.hidden = tag, parent, names, hidden
        self.depth, self.length, self.core = parent.depth + 1 if parent else 0, 0, False
        self.ill = parent is not None and (parent.ill or parent.names == BAD)  # somewhere inside an element with a bad name
        self.bonus = 0.0
        self.bad = self.byline = False


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


NEUTRAL, GOOD, BAD, HEAD = 0, 1, 2, 3


def named(attributes: str) -> tuple[int, bool]:
    """Whether an element's names speak for or against it, and whether it is hidden."""
    kind, own = NEUTRAL, False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            own = True
        elif key != "style":
            for token in value.split():
                words = NAME.findall(HUMP.sub("-", token).lower())
                if not words or words[0] in STATE_FIRST or len(words) > 1 and words[-1] in STATE_LAST:
                    continue
                if BAD_NAMES.intersection(words) or "".join(words) in BAD_NAMES:
                    kind = BAD
                elif "header" in words and kind != BAD:
                    kind = HEAD
                elif words[-1] in GOOD_NAMES and kind == NEUTRAL:
                    kind = GOOD
    return kind, own


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with the containers' evidence; inline elements and line breaks don't end a block."""
    out: list[Block] = []
    root = Node("", None, NEUTRAL, False)
    nodes, stack = [root], [root]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, stack[-1], min(linked, len(text))))
                stack[-1].length += len(text) - out[-1].linked
            parts.clear()
        linked = 0

    def close(names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        if not any(opened.get(t) for t in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for n in stack[i:]:
                    opened[n.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in BLOCK:
            if tag == "a":
                in_link = 0 if m[2] else 1
            elif tag in ("br", "wbr", "img", "input"):
                parts.append(" " if tag != "wbr" else "")
            continue
        flush()
        in_link = 0
        if m[2]:
            close((tag,), frozenset() if tag in SCOPES else SCOPES)
            continue
        if stack[-1].tag == "p":
            close(("p",))
        if tag in LIST_LIKE:
            close(LIST_LIKE[tag], SCOPES)
        if tag in VOID:
            continue
        names, hidden = named(m[4]) if m[4] and tag not in ("html", "body") else (NEUTRAL, False)
        stack.append(Node(tag, stack[-1], names, hidden))
        nodes.append(stack[-1])
        opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    weigh(nodes)
    return out


def weigh(nodes: list[Node]) -> None:
    """What the containers around each element say. A container that holds the page's core (its main element, first h1 or longest article, or
    nine tenths of the text where there is none of these) is not judged by its names."""
    for n in reversed(nodes[1:]):
        n.parent.length += n.length
    cores = [n for n in nodes if n.tag == "main"][:1] + [n for n in nodes if n.tag == "h1"][:1]
    articles = [n for n in nodes if n.tag == "article" and n.names != BAD]
    apart = [n for n in articles if not n.ill]
    if apart or articles and not cores:
        cores.append(max(apart or articles, key=lambda n: n.length))
    for n in cores:
        n = n if n.tag in ("article", "main") else n.parent
        while n is not None and not n.core:
            n.core, n = True, n.parent
    if not cores:
        for n in nodes:
            n.core = n.length >= 0.9 * nodes[0].length > 0
    for n in nodes[1:]:
        up = n.parent
        n.bonus, n.bad, n.byline = up.bonus, up.bad, up.byline
        bad = n.tag in CONTAINERS or n.hidden or n.names == BAD and not n.core
        if n.tag == "header" or n.names == HEAD:
            if n.core or n.bonus:
                n.byline = True
            else:
                bad = True
        if bad:
            n.bad, n.bonus = True, 0.0
        elif not n.bad:
            article = SEED if n.core else ARTICLE
            n.bonus = max(n.bonus, article if n.tag == "article" else MAIN if n.tag == "main" else GOOD_NAME if n.names == GOOD else 0.0)


def features(block: Block) -> list[float]:
    """The text's look, in the order of NAMES: nothing of its element, its containers or what words mean."""
    text, n = block.text, len(block.text)
    words = text.split()
    capitals, digits = sum(w[0].isupper() for w in words) / len(words), sum(c.isdigit() for c in text[:LONG]) / min(n, LONG)
    return [1.0, min(n, LONG) / LONG, block.linked / n, float(text[-1] in ".!?…\"'»”"), min(1.0, text.count(",") / len(words) * 8), capitals, digits]


def tie(node: Node) -> float:
    """What the container around a block ties it to: content (above 0) or boilerplate. A title and a paragraph count as containers of themselves."""
    if node.bad:
        return -SEED
    if node.byline and node.tag not in HEADINGS:
        return BYLINE
    return max(node.bonus, OWN.get(node.tag, 0.0))


def own_label(block: Block) -> int | None:
    """1 inside the page's core article, 0 inside containers of boilerplate, none elsewhere."""
    if block.node.bad:
        return 0
    return 1 if block.node.bonus >= SEED and not block.node.byline else None


def own_odds(blocks: list[Block], weights: list[float]) -> list[float]:
    """The classifier's log-odds that each block is content, held within MOST_ODDS."""
    return [max(-MOST_ODDS, min(MOST_ODDS, sum(w * x for w, x in zip(weights, features(b), strict=True)))) for b in blocks]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges between neighbours in page order and between blocks of the same parent element."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT * 0.5 ** distance(blocks[i - 1].node, b.node)))
        parent = id(b.node.parent)
        if last.get(parent, i) < i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def distance(a: Node, b: Node) -> int:
    """Steps in the element tree between two elements, less the two that siblings are apart; more than 20 are as good as 20."""
    steps = 0
    while a is not b and steps < 22:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return max(0, steps - 2)


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling of least cost: odds are the terminal capacities, edges cost their weight where labels differ."""
    tied: list[dict[int, float]] = [{} for _ in odds]
    for i, j, w in edges:
        tied[i][j] = tied[i].get(j, 0.0) + w
        tied[j][i] = tied[j].get(i, 0.0) + w
    content = max_flow(odds, tied)
    return [i in content for i in range(len(odds))]


def max_flow(odds: list[float], tied: list[dict[int, float]]) -> set[int]:
    """Blocking flows over shortest paths from source (-1) to sink (-2); returns the blocks on the source's side."""
    left: dict[int, dict[int, float]] = dict(enumerate(tied)) | {-1: {}, -2: {}}
    for i, odd in enumerate(odds):
        if odd > 0:
            left[-1][i], left[i][-1] = odd, 0.0
        else:
            left[i][-2], left[-2][i] = -odd, 0.0
    while True:
        level, look = {-1: 0}, deque([-1])
        while look:
            i = look.popleft()
            for j, c in left[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    look.append(j)
        if -2 not in level:
            return {i for i in level if i >= 0}
        todo = {i: iter(list(left[i])) for i in level}
        path = [-1]
        while path:
            i = path[-1]
            if i == -2:
                flow = min(left[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if left[a][b] <= 1e-9)
                del path[full + 1 :]
                continue
            for j in todo[i]:
                if left[i].get(j, 0.0) > 1e-9 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()  # a dead end: the edge that led here is not looked at again


class Model(NamedTuple):
    """Weights of the features, and what ties between neighbours are multiplied with."""

    weights: list[float]
    scale: float


START = Model(list(PRIOR.values()), 1.0)


def labels_of(blocks: list[Block], model: Model, containers: bool = True) -> list[bool]:
    """Which blocks are content. A tie to a container is an edge to a node that lies on one side: it adds to the block's own capacity on that side."""
    odds = own_odds(blocks, model.weights)
    if containers:
        odds = [o + tie(b.node) for o, b in zip(odds, blocks, strict=True)]
    return minimum_cut(odds, [(i, j, w * model.scale) for i, j, w in edges_of(blocks)] if model.scale else [])


def main_text(page: str | None, model: Model = START) -> str:
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, k in zip(blocks, labels_of(blocks, model), strict=True) if k)


def _texts(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("html")
            texts = [main_text(x.as_py(), model) for x in batch.column(at)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [x for i, x in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], [*names, "text"])

    return run


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page's hash, place, features and label of the blocks that their containers label."""
    for batch in batches:
        for key, page in zip(batch.column("key").to_pylist(), batch.column("html"), strict=True):
            found = [(i, features(b), y) for i, b in enumerate(blocks_of(page.as_py() or "")) if (y := own_label(b)) is not None]
            columns = [pa.array([key] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "place", "x", "y"])


def _scores(models: list[Model]):
    """For each model, with all containers hidden: blocks called content rightly, wrongly, and missed, of those that containers label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(models), 3), np.int64)
        for batch in batches:
            for page in batch.column("html"):
                blocks = blocks_of(page.as_py() or "")
                truth = [own_label(b) for b in blocks]
                for k, model in enumerate(models):
                    for y, called in zip(truth, labels_of(blocks, model, containers=False), strict=True):
                        if y is not None and (y or called):
                            sums[k, 0 if y and called else 1 if called else 2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), *[pa.array(sums[:, i]) for i in range(3)]], ["model", "right", "wrong", "missed"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, pull: float = PULL) -> np.ndarray:
    """Weights of least logistic loss, with a pull to PRIOR of so many blocks' weight; without rows they are PRIOR."""
    start = np.array(list(PRIOR.values()))
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - start))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(pages: DataFrame, most: int = SAMPLE_PAGES) -> DataFrame:
    """About `most` pages by a hash of id and url, with their hash as `key`; all of them where there are fewer."""
    shares = max(1, pages.count() // most)
    key = F.xxhash64("id", "url")
    return pages.select(key.alias("key"), "html").where(F.pmod(key, F.lit(shares)) == 0)


def fit(pages: DataFrame, most: int = SAMPLE_PAGES, blocks: int = SAMPLE_BLOCKS) -> tuple[Model, DataFrame]:
    """The model, and how its candidates did on the held-out pages of the sample: scale, right, wrong, missed and f1, with all containers hidden.

    pages: id, url and html. The sample is bounded: about `most` pages, of one half of them `blocks` blocks at most train the classifier, and the other half
    chooses the scale (of equal ones the smallest). Everything else looks at all pages.
    """
    sample = stage(sampled(pages, most), "html_sample")
    half = F.pmod(F.xxhash64("key"), F.lit(2))
    rows = sample.where(half == 0).mapInArrow(_looks, "key long, place int, x array<double>, y int")
    rows = rows.orderBy(F.xxhash64("key", "place"), "key", "place", "x").limit(blocks).collect()
    weights = logistic(np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.y for r in rows], float))
    models = [Model([float(w) for w in weights], s) for s in SCALES]
    sums = sample.where(half == 1).mapInArrow(_scores(models), "model int, right long, wrong long, missed long").groupBy("model").agg(*[F.sum(c).alias(c) for c in ("right", "wrong", "missed")])
    f1 = F.try_divide(2.0 * F.col("right"), 2.0 * F.col("right") + F.col("wrong") + F.col("missed"))
    sums = sums.select(F.get(F.array(*[F.lit(s) for s in SCALES]), F.col("model")).alias("scale"), "right", "wrong", "missed", f1.alias("f1"))
    best = max(sums.collect(), key=lambda r: (r.f1 or 0.0, -r.scale), default=None)  # a row for each scale
    return (models[SCALES.index(best.scale)] if best and best.f1 else models[SCALES.index(START.scale)]), sums


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """id, url and main text of every page: its content blocks in page order, one a line. Without a model one is fitted on the pages themselves.

    A page that is null, empty or all boilerplate has an empty text. Null ids and urls and repeated rows pass through, an empty table gives an empty result; other
    columns are not looked at.
    """
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    model = fit(source)[0] if model is None else model
    return source.mapInArrow(_texts(model), "id long, url string, text string")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
