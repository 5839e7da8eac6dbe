"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of blocks (inline markup melts into its block). Each block has a
hidden label, main text or not. Its potential comes from what is seen of it: tag, class and
id names, length of its own text, links, sentence ends, place below an article or a list of
comments; parent and child are tied by transition potentials. Both are log odds of smoothed
counts over labelled pages. Sum-product messages run up the tree and down again, for all
pages of a batch level by level, and give each block's marginal; the text of blocks at or
above ``threshold`` is kept.

Character references are decoded; white space inside a block, line breaks included, is one
blank; blocks are trimmed and joined by one newline in page order. Scripts, styles,
comments and the head are no text; formulas and the content of objects are. A null or empty page, and one
without main text, give an empty text. Pages count whole, in time proportional to their length,
however many tags stay open. Rows stay as they are, repeated ones too; an empty table gives no
rows; columns named like a result are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestlens.llm.common import table
from harvestlens.llm.labelled_pages import labelled_pages
from harvestlens.llm.registry import query

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。]")

# Element names by their part in the page.
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "svg", "head", "xmp", "annotation", "annotation-xml"}
_TO_THE_END = {"script", "style", "textarea", "title", "xmp"}  # without an end tag they hold the rest of the page
# an end tag in the source itself: lower-casing can move offsets, and "</header" is no end of the head
_RAW_END = {name: re.compile(rf"</(?i:{name})(?=[\s/>]|\Z)", re.A) for name in _RAW}
_BODY = re.compile(r"<(?i:body)(?=[\s/>]|\Z)", re.A)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var object math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover "
    "munderover mstyle mpadded mphantom semantics".split()
)
_CLOSES = {  # an opening tag ends these open elements, up to the barrier elements
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAGS = {
    name: i
    for i, names in enumerate(
        [
            "article", "main", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside",
            "form fieldset button select option input legend", "div", "section", "table tbody thead tfoot tr", "td th",
            "blockquote pre", "figure figcaption", "html body",
        ]
    )
    for name in names.split()
}
_OTHER_TAG = 19
_HINTS = [
    re.compile(p)
    for p in (
        r"comment|repl(?:y|ies)|discuss|disqus",
        r"(?:^|[\W_])(?:ads?|adv|advert\w*|adsense|adsby\w*|sponsor\w*|promo\w*|banner\w*)(?:$|[\W_])|^ads",
        r"cookie|consent|notice|notif|popup|modal|alert|gdpr|overlay|warning",
        r"nav|menu|breadcrumb|pager|pagination|skip",
        r"foot|copyright|legal|colophon",
        r"side|widget|related|recommend|popular|tags|share|social|aside|rail|toc",
        r"form|search|login|subscri|newsletter|signup|register",
        r"head|masthead|logo|brand|topbar",
        r"article|content|post|entry|story|text|body|main|page",
    )
]
_NO_HINT = len(_HINTS)
_WRAPPER = re.compile(r"wrap|container|layout|(?:^|[\s_-])(?:has|with|no)[_-]")  # names of what is around it, not of itself
_FURNITURE_TAGS = {_TAGS[t] for t in ("nav", "footer", "aside", "form")}
_FEATURES = (20, _NO_HINT + 1, 6, 5, 3, 4)  # values of each feature
_BUCKETS = (0, 20, 80, 200, 600)


@dataclass
class Page:
    """Blocks in page order: parent, depth, features, and segments (block, text) of text."""

    parents: list[int]
    depths: list[int]
    features: list[tuple[int, ...]]
    segments: list[tuple[int, str]]
    marked: list[bool]


def _hint(attributes: str, known: dict) -> int:
    if not attributes:
        return _NO_HINT
    if attributes in known:
        return known[attributes]
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
    found = next((i for i, p in enumerate(_HINTS) if p.search(names)), _NO_HINT) if names else _NO_HINT
    if found < _NO_HINT and _WRAPPER.search(names):
        found = _NO_HINT
    if len(known) < 100_000:
        known[attributes] = found
    return found


def parse(source: str, known: dict | None = None) -> Page:
    """The tree of blocks of a page; open elements are closed as browsers do in the usual cases."""
    known = {} if known is None else known
    parents, depths, tags, hints, marked = [-1], [0], [_TAGS["html"]], [_NO_HINT], [False]
    # open elements: (name, block, or -1 for inline), the blocks among them, and where each name is open:
    # what a tag ends is looked up, not searched for, so a page costs time in proportion to its length
    stack: list[tuple[str, int]] = [("html", 0)]
    open_blocks = [0]
    places: dict[str, list[int]] = {}
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    own, linked, ends = [0], [0], [0]
    segments: list[tuple[int, str]] = []
    held: list[str] = []
    in_link = 0
    block = 0

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                segments.append((block, text))
                own[block] += len(text)
                ends[block] += len(_SENTENCE.findall(text))

    def add_text(text: str) -> None:
        if text:
            held.append(text)
            if in_link:
                linked[block] += len(text.strip())

    def push(name: str, of: int) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append((name, of))

    def pop_to(at: int) -> None:
        nonlocal in_link, block
        if any(b >= 0 for _, b in stack[at:]):
            flush()
        for name, of in stack[at:]:
            in_link -= name == "a"
            places[name].pop()
            if of >= 0:
                open_blocks.pop()
        del stack[at:]
        block = open_blocks[-1]

    def last_open(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    at = 0
    while True:
        m = _TOKEN.search(source, at)
        if not m:
            add_text(source[at:])
            break
        add_text(source[at : m.start()])
        at = m.end()
        close, open_, attributes = m.group(1), m.group(2) or m.group(4), m.group(3) or m.group(5) or ""
        if close:
            name = close.lower()
            if places.get(name):
                pop_to(places[name][-1])
        elif open_:
            name = open_.lower()
            if name in _RAW:
                if not attributes.endswith("/"):
                    end = None if name in unclosed else _RAW_END[name].search(source, at)
                    if not end:
                        unclosed.add(name)
                    if name == "head" and not end:  # never closed: ends where the body begins
                        body = _BODY.search(source, at)
                        at = body.start() if body else at
                        continue
                    if not end and name not in _TO_THE_END:
                        continue
                    stop = source.find(">", end.start()) if end else -1
                    at = stop + 1 if stop >= 0 else len(source)
                continue
            if name in _VOID:
                if name in ("br", "hr", "img", "input"):
                    held.append(" ")
                if name == "hr":
                    flush()
                continue
            if name in ("html", "body"):
                continue
            if name in _INLINE:
                push(name, -1)
                in_link += name == "a"
                continue
            if name in _CLOSES:
                ended, barrier = _CLOSES[name]
                at_end = last_open(ended)
                if at_end > last_open(barrier):
                    pop_to(at_end)
            elif places.get("p") and stack[places["p"][-1]][1] == open_blocks[-1]:  # a block ends an open paragraph
                pop_to(places["p"][-1])
            flush()
            parents.append(block)
            depths.append(depths[block] + 1)
            tags.append(_TAGS.get(name, _OTHER_TAG))
            hints.append(_hint(attributes, known))
            marked.append("data-main" in attributes)
            own.append(0)
            linked.append(0)
            ends.append(0)
            block = len(parents) - 1
            push(name, block)
            open_blocks.append(block)
    flush()
    return Page(parents, depths, _observe(parents, tags, hints, own, linked, ends), segments, marked)


def _observe(parents, tags, hints, own, linked, ends) -> list[tuple[int, ...]]:
    """Features of each block: tag, name hint, own length, links below, sentence ends, place."""
    n = len(parents)
    total, links = list(own), list(linked)
    for i in range(n - 1, 0, -1):
        total[parents[i]] += total[i]
        links[parents[i]] += links[i]
    place = [0] * n  # 1 below an article, 2 below comments, 3 below other furniture
    out = []
    for i in range(n):
        if i:
            above = parents[i]
            if place[above] >= 2:
                place[i] = place[above]
            elif hints[above] == 0:
                place[i] = 2
            elif tags[above] in _FURNITURE_TAGS or 1 <= hints[above] <= 6:
                place[i] = 3
            elif place[above] == 1 or tags[above] in (_TAGS["article"], _TAGS["main"]):
                place[i] = 1
        length = sum(own[i] > b for b in _BUCKETS)
        density = 0 if not total[i] else 1 if not links[i] else 2 if links[i] < 0.25 * total[i] else 3 if links[i] < 0.6 * total[i] else 4
        out.append((tags[i], hints[i], length, density, min(ends[i], 2), place[i]))
    return out


@dataclass
class ContentModel:
    unary: list[np.ndarray]  # for each feature (values, 2): log P(value | label)
    edge: np.ndarray  # log P(child label | parent label)
    root: np.ndarray

    def marginals(self, parents: np.ndarray, depths: np.ndarray, features: np.ndarray) -> np.ndarray:
        """P(main text) of each block. Trees of many pages may stand one after the other."""
        phi = sum(u[features[:, j]] for j, u in enumerate(self.unary))
        roots = parents < 0
        phi[roots] += self.root
        order = np.argsort(depths, kind="stable")
        cuts = np.searchsorted(depths[order], np.arange(depths.max(initial=0) + 2))
        levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        belief = phi.copy()  # own potential and messages from below
        up = np.zeros_like(phi)  # message of each block to its parent
        for level in reversed(levels[1:]):
            up[level] = _logsumexp(self.edge[None, :, :] + belief[level][:, None, :], axis=2)
            np.add.at(belief, parents[level], up[level])
        full = belief.copy()
        for level in levels[1:]:
            above = full[parents[level]] - up[level]  # without what the block itself said
            full[level] = belief[level] + _logsumexp(self.edge[None, :, :] + above[:, :, None], axis=1)
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: Sequence[str], smoothing: float = 0.5, temper: float = 0.7) -> ContentModel:
    """Fit the potentials on pages whose main blocks carry ``data-main``.

    A block without text of its own counts as main if most text below it is. ``temper``
    scales the unary potentials: features of a block are not independent.
    """
    unary = [np.full((n, 2), smoothing) for n in _FEATURES]
    edge, root = np.full((2, 2), smoothing), np.full(2, smoothing)
    for source in pages:
        page = parse(source)
        n = len(page.parents)
        main, every = np.zeros(n), np.zeros(n)
        for b, text in page.segments:
            every[b] += len(text)
            main[b] += len(text) * page.marked[b]
        below_main, below = main.copy(), every.copy()
        for i in range(n - 1, 0, -1):
            below_main[page.parents[i]] += below_main[i]
            below[page.parents[i]] += below[i]
        label = np.where(every > 0, page.marked, 2 * below_main > below).astype(int)
        for i in range(n):
            for j, value in enumerate(page.features[i]):
                unary[j][value, label[i]] += 1
            if i:
                edge[label[page.parents[i]], label[i]] += 1
            else:
                root[label[i]] += 1
    return ContentModel(
        [temper * np.log(u / u.sum(axis=0)) for u in unary], np.log(edge / edge.sum(axis=1, keepdims=True)), np.log(root / root.sum())
    )


def default_model() -> ContentModel:
    return train(labelled_pages())


def extract_texts(model: ContentModel, sources: Sequence[str | None], threshold: float = 0.5, known: dict | None = None) -> list[str]:
    pages = [parse(s or "", known) for s in sources]
    if not pages:
        return []
    sizes = np.array([len(p.parents) for p in pages])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    parents = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + b) for p, b in zip(pages, base)])
    depths = np.concatenate([p.depths for p in pages])
    features = np.concatenate([np.array(p.features) for p in pages])
    keep = model.marginals(parents, depths, features) >= threshold
    return ["\n".join(t for b, t in p.segments if keep[first + b]) for p, first in zip(pages, base)]


def extract(
    pages: DataFrame, model: ContentModel | None = None, html_col: str = "html", keep: Sequence[str] | None = None, threshold: float = 0.5
) -> DataFrame:
    """Add ``text``, the main text, and ``n_chars``. ``keep``: input columns to return, default all."""
    model = model or default_model()
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").cast("string").alias("_content_html"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts: list[str] = []
            column = batch.column(batch.num_columns - 1)
            for first in range(0, len(column), 256):
                texts += extract_texts(model, column.slice(first, 256).to_pylist(), threshold, known)
            added = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=schema.names)

    return rows.mapInArrow(run, schema)


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
