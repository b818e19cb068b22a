"""Main text of web pages by minimum cut.

A page is cut into blocks: runs of text between block-level tags. Every block has a cost for being
called content and one for being called boilerplate: the log odds of a classifier over its text
(length, links, punctuation, kind of element) and a fixed preference for what its nearest telling
ancestor says (article, main; nav, footer, aside, form, or a class or id such as "sidebar" or
"comments"). Blocks that follow each other, and blocks that follow each other under one parent, are
joined by edges that are the heavier the nearer the two are in the tree. The labelling of least cost
(costs of the labels and weights of the edges between differing labels) is a minimum cut, found by maximum
flow after blocks that their neighbours cannot overrule are fixed.

The classifier is a linear discriminant fitted on the blocks of at most ``SAMPLE`` pages (by the hash
of page_id; a documented bound) whose ancestors tell what they are; Spark sums the moments. Extraction reads every
page and whole pages.

Odd cases: a null or empty page has no text; unclosed tags, comments and quotes end with the page;
repeated rows are treated alike; a null page_id or url is kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edupulse.llm.staging import steps, text_or_empty

SAMPLE = 5_000

# How much the nearest telling ancestor counts, and the weight of an edge between neighbours.
PREFERENCE = 6.0
EDGE = 2.0
_RIDGE = 1e-3

# HTML facts: elements that break the text into blocks, have no end tag, or hold no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav footer aside form head title button select option menu dialog label search".split())
CONTENT = frozenset("article main".split())
# Words of a class, id or role that tell what an element is.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments respond disqus reply "
    "replies related recommended recommendations share sharing social widget pagination pager toolbar copyright contentinfo complementary search skip disclaimer".split())
CONTENT_WORDS = frozenset("article story post entry main maincontent articlebody storybody postbody entrycontent".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|canvas|math|audio|video|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/a-zA-Z][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)", re.S | re.I)
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_ENDS = (".", "!", "?", "…", "。", "：", ":", "»", "\"", "”")


class Node:
    """An open block element; ``parent`` is the one around it."""

    __slots__ = ("name", "parent", "depth")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 1


class Block:
    __slots__ = ("text", "linked", "node", "told")

    def __init__(self, text: str, linked: int, node: Node | None, told: int):
        self.text, self.linked, self.node, self.told = text, linked, node, told

    @property
    def element(self) -> str:
        return self.node.name if self.node else ""


class _Open:
    """An open element: what it tells, the innermost block element (itself, if one) and that one's place in the stack."""

    __slots__ = ("name", "told", "node", "block_at")

    def __init__(self, name: str, told: int, node: Node | None, block_at: int):
        self.name, self.told, self.node, self.block_at = name, told, node, block_at


def _tells(name: str, rest: str, outer: int) -> int:
    """1 content, -1 boilerplate, 0 as the ancestors say."""
    told = -1 if name in BOILERPLATE else 1 if name in CONTENT else 0
    if name == "header" and outer <= 0:  # a page's; an article's own header is part of it
        told = -1
    if rest and name not in ("html", "body"):
        for hint in _HINT.findall(rest):
            values = next(filter(None, hint), "").lower()
            parts = set(_PART.findall(values))
            if parts & BOILERPLATE_WORDS:
                return -1
            if told == 0 and (parts & CONTENT_WORDS):
                told = 1
    return told


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Every step costs the elements that it opens or closes, however deep the page."""
    out: list[Block] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, stack[-1].node if stack else None, stack[-1].told if stack else 0))
            parts.clear()
        linked = 0

    def close_from(at: int) -> None:
        for element in stack[at:]:
            opened[element.name] -= 1
        del stack[at:]

    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            parts.append(text)
            if opened["a"]:
                linked += len(text)
            continue
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if name in BLOCKS:
            close_block()
        elif name == "br":
            parts.append(" ")
        if token["end"]:
            if opened[name]:
                close_from(next(at for at in range(len(stack) - 1, -1, -1) if stack[at].name == name))
            continue
        if name in VOID:
            continue
        if name in BLOCKS:
            # A new block ends an open paragraph, and a new item or cell an open one of its kind.
            inner = stack[-1].node if stack else None
            if inner and (inner.name == "p" or inner.name == name and name in ("li", "dd", "dt", "td", "th", "tr", "option")):
                close_from(stack[-1].block_at)
        outer = stack[-1].told if stack else 0
        told = _tells(name, token["rest"], outer)
        if not token["rest"].endswith("/"):
            # Inside boilerplate all is boilerplate, but a dialog or menu may not hold an article.
            inner = stack[-1].node if stack else None
            own = name in BLOCKS
            stack.append(_Open(name, told or outer, Node(name, inner) if own else inner, len(stack) if own else stack[-1].block_at if stack else -1))
            opened[name] += 1
    close_block()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row per block: text and kind of element; nothing of what its ancestors tell."""
    rows = []
    for b in page:
        n = len(b.text)
        words = b.text.count(" ") + 1
        rows.append((
            np.log1p(words), min(1.0, b.linked / n), float(b.text.endswith(_ENDS)), min(5.0, 100 * b.text.count(",") / n),
            min(5.0, 100 * sum(map(b.text.count, ".!?")) / n), float(b.element in HEADINGS), float(b.element == "p"), float(b.element in ("li", "td", "option"))))
    return np.array(rows, float).reshape(-1, 8)


def fit(pages: DataFrame, *, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the log odds that a block is content (the last is the constant).

    A linear discriminant: class means and the shared covariance, from sums that tasks emit.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            found = [blocks(page) for page in batch.column("html").to_pylist()]
            told = [b for page in found for b in page if b.told]
            x = np.column_stack([features(told), np.ones(len(told))])
            good = np.array([b.told > 0 for b in told], bool)
            rows = [(label, i, j, v) for label in (True, False) for (i, j), v in np.ndenumerate(x[good == label].T @ x[good == label])]
            yield pa.RecordBatch.from_pylist([dict(zip("lijv", r, strict=True)) for r in rows], pa.schema([("l", pa.bool_()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]))

    read = pages.select("page_id", text_or_empty("html").alias("html"))
    count = read.count()
    if count > sample:
        read = read.where(F.pmod(F.xxhash64("page_id"), F.lit(count)) < sample)
    summed = read.mapInArrow(moments, "l boolean, i int, j int, v double").groupBy("l", "i", "j").agg(F.sum("v").alias("v")).collect()
    gram = {True: np.zeros((9, 9)), False: np.zeros((9, 9))}
    for r in summed:
        gram[r["l"]][r["i"], r["j"]] = r["v"]
    n = {label: g[8, 8] for label, g in gram.items()}
    if min(n.values()) < 2:
        return np.zeros(9)
    mean = {label: g[:8, 8] / n[label] for label, g in gram.items()}
    spread = sum(g[:8, :8] - n[label] * np.outer(mean[label], mean[label]) for label, g in gram.items()) / sum(n.values())
    slope = np.linalg.solve(spread + _RIDGE * np.eye(8), mean[True] - mean[False])
    constant = -slope @ (mean[True] + mean[False]) / 2
    return np.append(slope, constant)


def _apart(a: Node | None, b: Node | None) -> int:
    """Steps from one element to the other in the tree. From block to block of a page these are, in sum, the elements opened and closed."""
    steps_ = 0
    while a is not b:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps_ += 1
    return steps_


def _edges(page: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in the text, and neighbours under one parent that others separate."""
    out, last = [], {}
    for i, block in enumerate(page):
        if i:
            out.append((i - 1, i, EDGE / (1 + _apart(page[i - 1].node, block.node))))
        parent = block.node.parent if block.node else None
        before = last.get(parent)
        if before is not None and before < i - 1:
            out.append((before, i, EDGE / 4))
        last[parent] = i
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling that minimises the gains given up (|gain| where the label is against its sign) and the
    weights of edges between different labels. True goes with a positive gain; so do ties."""
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # fix what the open neighbours together cannot overrule
        i = queue.popleft()
        if label[i] is not None or abs(gain[i]) < sum(w for j, w in near[i].items() if label[j] is None):
            continue
        label[i] = gain[i] >= 0
        for j, w in near[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                queue.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        index = {i: k for k, i in enumerate(left)}
        for i, side in zip(left, _flow([gain[i] for i in left], [{index[j]: w for j, w in near[i].items() if label[j] is None} for i in left]), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _flow(gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting paths in level graphs; the blocks that can still reach the
    sink are boilerplate."""
    n = len(gain)
    source, sink = n, n + 1
    rest: list[dict[int, float]] = [dict(x) for x in near] + [{}, {}]
    for i, g in enumerate(gain):
        if g > 0:
            rest[source][i] = g
            rest[i].setdefault(source, 0.0)
        else:
            rest[i][sink] = -g
            rest[sink].setdefault(i, 0.0)
    tiny = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for j, c in rest[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            break
        choices, turn, path = {i: list(rest[i]) for i in level}, dict.fromkeys(level, 0), [source]
        while path:
            i = path[-1]
            if i == sink:
                steps_ = list(zip(path, path[1:]))  # noqa: B905
                flow = min(rest[a][b] for a, b in steps_)
                for a, b in steps_:
                    rest[a][b] -= flow
                    rest[b][a] += flow
                path = [source]
                continue
            while turn[i] < len(choices[i]):
                j = choices[i][turn[i]]
                if rest[i][j] > tiny and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
                turn[i] += 1
            else:
                path.pop()
                if path:
                    turn[path[-1]] += 1
    reach = {sink}
    queue = deque([sink])
    while queue:
        j = queue.popleft()
        for i in rest[j]:
            if i not in reach and rest[i].get(j, 0.0) > tiny:
                reach.add(i)
                queue.append(i)
    return [i not in reach for i in range(n)]


def main_text(page: str, weights: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    odds = features(found) @ weights[:8] + weights[8]
    gain = [float(np.clip(o, -4, 4)) + PREFERENCE * b.told for o, b in zip(odds, found, strict=True)]
    keep = minimum_cut(gain, _edges(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = fit(pages, sample=sample)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            found = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    read = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in read.schema.fields}
    return read.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
