"""HTML extraction: a tree-structured graphical model of the DOM.

The nodes are a page's block elements; each is content or not. A node's own evidence
(tag, names in its attributes, length, link share) gives its unary potential, and a
parent-child potential, by the kind of the child, ties neighbours together. Sum-product
messages go upward and downward once, which on a tree yields exact marginals; text of
nodes that are content with a probability of at least one half is the page's text. The
weights are learned by maximum likelihood, with the same messages, from labelled pages
(see labelled_pages.py).

Blocks: text between two block tags is a block of the element that holds it. Character
references are decoded, white space is made one space, empty blocks vanish, and blocks are
joined in page order by one line feed. What a browser does not show as text (head, script,
style, template, comments and the like) is never a block.

Defined cases: null or empty html gives an empty text; unclosed and truncated markup is
read as far as it goes; a page is read whole, in time that grows with its length however its
markup is nested; repeated rows give the same text; null ids and urls are passed on; an empty
table gives an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

ORACLE_SQL = None

# fixed values: the HTML standard's void elements, and elements that flow inside a line
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr nobr".split()
)
#: Elements whose content is not read as markup, and those whose content is not shown as text.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
HIDDEN = frozenset("head template svg math object canvas audio video select datalist map".split())
HEAD_ONLY = frozenset("meta link base title script style noscript template".split())
#: A start tag of the first closes open elements of the second, up to an element of the third.
_CELLS, _TABLE = frozenset(("td", "th")), frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), _TABLE),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), _TABLE),
    "thead": (frozenset(("thead", "tbody", "tfoot")), _TABLE),
    "tfoot": (frozenset(("thead", "tbody", "tfoot")), _TABLE),
}
#: A paragraph does not reach out of these.
P_SCOPE = frozenset("table td th caption button object html body".split())
_P = frozenset(("p",))
KIND = {
    **dict.fromkeys(("p", "pre", "blockquote", "figcaption"), 1),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2),
    **dict.fromkeys(("li", "dt", "dd"), 3),
    **dict.fromkeys(("ul", "ol", "dl", "menu"), 4),
    **dict.fromkeys(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"), 5),
    **dict.fromkeys(("article", "main"), 6),
    **dict.fromkeys(("div", "section", "figure", "body", "html"), 7),
}  # anything else: 0
KINDS = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:[\s=>]|$)|display\s*:\s*none", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?…][\"'”»)]?$")


class Page:
    """The block tree of a page: parallel lists by node, in page order; node 0 is the root."""

    __slots__ = ("parent", "tag", "names", "words", "linked", "stops", "runs", "label")

    def __init__(self):
        self.parent, self.tag, self.names, self.label = [-1], ["#root"], [()], [None]
        self.words, self.linked, self.stops = [0], [0], [0]
        self.runs: list[tuple[int, str]] = []

    def add(self, parent: int, tag: str, names: tuple, label) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(label)
        self.words.append(0)
        self.linked.append(0)
        self.stops.append(0)
        return len(self.tag) - 1


def _attribute_names(attrs: str) -> tuple[str, ...]:
    out = [p.lower() for m in _NAMES.finditer(attrs) for p in _NAME_PARTS.findall(m[1])]
    if _UNSEEN.search(attrs):
        out.append("hidden")
    return tuple(dict.fromkeys(out))


def parse(source: str, labelled: bool = False) -> Page:
    """The block tree of a whole page. labelled: read data-y as the label of an element."""
    page = Page()
    stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, the block that holds its text)
    # counts of open elements, so that the stack is only searched for what is there: by tag,
    # of paragraphs in each scope, and of inline tags in each block
    opened: Counter = Counter()
    paragraphs: list[int] = [0]
    inline: list[Counter | None] = [None]
    run: list[str] = []
    linked = 0  # words of the run inside links
    in_link = unseen = 0

    def flush():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                node = stack[-1][1]
                n = text.count(" ") + 1
                page.runs.append((node, text))
                page.words[node] += n
                page.linked[node] += min(n, linked)
                page.stops[node] += bool(_STOP.search(text))
            linked = 0

    def pop(to: int):
        nonlocal in_link, unseen
        while len(stack) > to:
            tag = stack[-1][0]
            if tag not in INLINE:
                flush()
            in_link -= tag == "a"
            unseen -= tag in HIDDEN
            stack.pop()
            opened[tag] -= 1
            if tag in INLINE:
                inline[-1][tag] -= 1
                continue
            inline.pop()
            if tag in P_SCOPE:
                paragraphs.pop()
            elif tag == "p":
                paragraphs[-1] -= 1

    def push(tag: str, node: int):
        stack.append((tag, node))
        opened[tag] += 1
        if tag in INLINE:
            if inline[-1] is None:
                inline[-1] = Counter()
            inline[-1][tag] += 1
            return
        inline.append(None)
        if tag in P_SCOPE:
            paragraphs.append(0)
        elif tag == "p":
            paragraphs[-1] += 1

    def leave(shut: frozenset, stop: frozenset):
        """Closes the nearest open element of `shut`, unless one of `stop` is nearer."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in shut:
                pop(k)
                break
            if stack[k][0] in stop:
                break

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else end]
        if text and not unseen:
            text = html_lib.unescape(text) if "&" in text else text
            run.append(text)
            if in_link:
                linked += len(text.split())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            # an inline end tag does not close a block
            if (inline[-1] and inline[-1][tag] > 0) if tag in INLINE else opened[tag] > 0:
                leave(frozenset((tag,)), frozenset())
            if tag == "br":
                run.append(" ")
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            at = close.start() if close else end
            if close:
                over = source.find(">", at)
                at = end if over < 0 else over + 1
            continue
        if unseen and stack[-1][0] == "head" and tag not in HEAD_ONLY:
            pop(len(stack) - 1)
        if tag in INLINE:
            if tag in ("br", "img"):
                run.append(" ")
            if tag not in VOID:
                if tag == "a":
                    in_link += 1
                push(tag, stack[-1][1])
            continue
        if tag in VOID:
            if tag in ("hr", "input"):
                flush()
            continue
        if paragraphs[-1] > 0:  # a block closes an open paragraph
            leave(_P, P_SCOPE)
        if tag in CLOSES and any(opened[x] > 0 for x in CLOSES[tag][0]):
            leave(*CLOSES[tag])
        flush()
        label = None
        if labelled and (y := re.search(r'data-y="(\d)"', attrs)):
            label = int(y[1])
        node = page.add(stack[-1][1], tag, _attribute_names(attrs) if attrs else (), label)
        unseen += tag in HIDDEN
        if not attrs.endswith("/") or tag not in HIDDEN:
            push(tag, node)
        else:
            unseen -= 1
    pop(1)
    flush()
    return page


def _size(n: int) -> str:
    return "0" if not n else "1" if n < 4 else "4" if n < 11 else "11" if n < 31 else "31"


def _share(part: int, whole: int) -> str:
    return "none" if not whole else "0" if not part else "low" if part < 0.3 * whole else "mid" if part < 0.7 * whole else "high"


def evidence(page: Page) -> list[list[str]]:
    """Names of the binary features of each node."""
    n = len(page.tag)
    words, linked = list(page.words), list(page.linked)
    for v in range(n - 1, 0, -1):
        words[page.parent[v]] += words[v]
        linked[page.parent[v]] += linked[v]
    out = []
    for v in range(n):
        tag, up = page.tag[v], page.tag[page.parent[v]] if v else ""
        share = _share(linked[v], words[v])
        out.append(
            ["bias", f"t:{tag}", f"u:{up}>{tag}", f"n:{_size(page.words[v])}", f"l:{share}", f"tl:{tag}:{share}", f"s:{page.stops[v] > 0}"]
            + [f"k:{x}" for x in page.names[v]]
        )
    return out


class Forest:
    """Many trees as one: arrays for messages, level by level."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0] + [len(p.tag) for p in pages])
        self.starts = starts
        self.parent = np.concatenate([np.array(p.parent) + (s if len(p.parent) else 0) for p, s in zip(pages, starts, strict=False)])
        roots = starts[:-1]
        self.parent[roots] = -1
        self.kind = np.array([KIND.get(t, 0) for p in pages for t in p.tag])
        level = np.zeros(len(self.parent), int)
        for v, p in enumerate(self.parent.tolist()):
            if p >= 0:
                level[v] = level[p] + 1
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(1, level.max(initial=0) + 2))
        self.levels = [x for x in np.split(order, cuts)[1:] if len(x)]  # without the roots


def sum_product(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of nodes (n x 2) and of parent-child pairs (n x 2 x 2), and the log partition.

    unary: n x 2; pair: KINDS x 2 (parent) x 2 (child), both as logs."""
    up = unary.copy()  # belief of the subtree
    to_parent = np.zeros_like(unary)
    for nodes in reversed(forest.levels):
        m = np.logaddexp.reduce(up[nodes][:, None, :] + pair[forest.kind[nodes]], axis=2)
        to_parent[nodes] = m
        np.add.at(up, forest.parent[nodes], m)
    down = np.zeros_like(unary)  # message from the parent
    joint = np.zeros((len(unary), 2, 2))
    for nodes in forest.levels:
        p = forest.parent[nodes]
        rest = up[p] + down[p] - to_parent[nodes]
        both = rest[:, :, None] + pair[forest.kind[nodes]]
        down[nodes] = np.logaddexp.reduce(both, axis=1)
        both = both + up[nodes][:, None, :]
        joint[nodes] = np.exp(both - np.logaddexp.reduce(both, axis=(1, 2), keepdims=True))
    belief = up + down
    roots = forest.starts[:-1]
    total = float(np.logaddexp.reduce(up[roots], axis=1).sum())
    return np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True)), joint, total


class Model:
    def __init__(self, features: dict[str, int], weights: np.ndarray, pair: np.ndarray):
        self.features, self.weights, self.pair = features, weights, pair

    def unary(self, pages: list[Page]) -> np.ndarray:
        score, known = [], self.features
        w = self.weights
        for page in pages:
            for names in evidence(page):
                score.append(sum(w[known[x]] for x in names if x in known))
        out = np.zeros((len(score), 2))
        out[:, 1] = score
        return out

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of content of each node, by page."""
        forest = Forest(pages)
        marginal = sum_product(forest, self.unary(pages), self.pair)[0][:, 1]
        return np.split(marginal, forest.starts[1:-1])


def train(pages: list[Page], rounds: int = 200, rate: float = 0.15, decay: float = 0.02) -> Model:
    """Maximum likelihood by gradient steps (Adam). Labels are inherited from the nearest labelled ancestor."""
    labels = []
    for page in pages:
        got: list[int] = []
        for v, y in enumerate(page.label):
            got.append(y if y is not None else got[page.parent[v]] if v else 1)
        labels.extend(got)
    y = np.array(labels)
    names = [x for page in pages for x in evidence(page)]
    features = {x: k for k, x in enumerate(sorted({x for xs in names for x in xs}))}
    node = np.repeat(np.arange(len(names)), [len(x) for x in names])
    feat = np.array([features[x] for xs in names for x in xs])
    forest = Forest(pages)
    inner = forest.parent >= 0
    observed = np.zeros((KINDS, 2, 2))
    np.add.at(observed, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    seen = np.bincount(feat, weights=y[node], minlength=len(features))
    theta = np.zeros(len(features) + KINDS * 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, pair = theta[: len(features)], theta[len(features) :].reshape(KINDS, 2, 2)
        unary = np.zeros((len(names), 2))
        unary[:, 1] = np.bincount(node, weights=w[feat], minlength=len(names))
        marginal, joint, _ = sum_product(forest, unary, pair)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, forest.kind[inner], joint[inner])
        g = np.concatenate([seen - np.bincount(feat, weights=marginal[node, 1], minlength=len(features)), (observed - expected).ravel()])
        g = g - decay * theta
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(features, theta[: len(features)].copy(), theta[len(features) :].reshape(KINDS, 2, 2).copy())


@lru_cache(maxsize=1)
def default_model() -> Model:
    from .labelled_pages import labelled_pages

    return train([parse(x, labelled=True) for x in labelled_pages()])


def extract(pages: list[str | None], model: Model) -> list[str]:
    """Main text of each page."""
    parsed = [parse(x or "") for x in pages]
    if not parsed:
        return []
    return [
        "\n".join(text for node, text in page.runs if p[node] >= 0.5)
        for page, p in zip(parsed, model.content(parsed), strict=True)
    ]


def html_extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))
