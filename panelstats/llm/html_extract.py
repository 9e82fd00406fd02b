"""Main-text extraction by minimum-cut labelling of a page's blocks.

A page becomes a sequence of text blocks.  A classifier gives each block a score in log-odds: a
prior for the landmark elements and class names that it lies in, and the odds of its shape,
learned from the blocks of a bounded sample of pages whose landmarks leave no doubt.  Scores
become the capacities of edges to two terminals, adjacency and DOM proximity become smoothness
edges of the same order, and a maximum flow separates content from boilerplate at least cost.
So a class name that lies about one paragraph among others is outvoted by its shape and its
neighbours, and a page without landmarks is cut by shapes and places.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|[^<]+|<""",
    re.DOTALL)
CLASSES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)

# Elements of HTML, by what they do to text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr nobr".split())
NEVER = frozenset("head script style noscript template svg select option button iframe object canvas datalist".split())
CHROME = frozenset("nav header footer aside form menu dialog fieldset label".split())
MAIN = frozenset("article main".split())
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"},
                 "td": {"tr", "table"}, "th": {"tr", "table"}}

# Parts of class names, ids and roles that name what is not the article.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget "
    "pagination pager search comment comments disqus respond replies reply contentinfo complementary".split())
NOT_CHROME = frozenset("has with no without".split())

# Scores in log-odds: elements that are not the article, names that say so, the article's elements,
# and elements that are never text (which nothing outvotes).
CHROME_SCORE, NAME_SCORE, MAIN_SCORE, NEVER_SCORE = -7.0, -5.0, 5.0, -40.0
SHAPE_LIMIT = 3.0                     # learned score stays within this
ADJACENT, PROXIMITY, SIBLING = 0.8, 1.5, 0.5  # smoothness weights
SAMPLE_PAGES = 4_000                  # pages that the shapes are learned from, at most


class Block:
    __slots__ = ("text", "tag", "score", "links", "path")

    def __init__(self, text: str, tag: str, score: float, links: int, path: tuple[int, ...]):
        self.text, self.tag, self.score, self.links, self.path = text, tag, score, links, path


def _name_score(attrs: str) -> float:
    for m in CLASSES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[-_]+", name)
            if not NOT_CHROME.intersection(parts) and CHROME_NAMES.intersection(parts):
                return NAME_SCORE
    return 0.0


def _element_score(tag: str, attrs: str) -> float:
    if tag in NEVER:
        return NEVER_SCORE
    if tag in CHROME:
        return CHROME_SCORE
    if tag in ("html", "body"):
        return 0.0
    score = _name_score(attrs) if attrs else 0.0
    if attrs and HIDDEN.search(attrs):
        score = CHROME_SCORE
    return score if score or tag not in MAIN else MAIN_SCORE


def page_blocks(page: str | None) -> list[Block]:
    """The non-empty text blocks of a page in order, references decoded, white space folded.

    A block's ``score`` is that of the strongest element around it: an element that is not
    the article outweighs an article around or within it.
    """
    blocks: list[Block] = []
    # open elements: (tag, id, score inherited by what is inside)
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]
    parts: list[str] = []
    state = {"links": 0, "in_link": 0}
    next_id = 1

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                tag, _, score = stack[-1]
                blocks.append(Block(text, tag, score, state["links"], tuple(x[1] for x in stack)))
        state["links"] = 0

    page = page or ""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        token = m[0]
        tag = m[2] or m[5]
        if tag is None:
            if token[0] != "<" or token == "<":  # not a comment or a tag that the page breaks off in
                text = html_lib.unescape(token) if "&" in token else token
                parts.append(text)
                if state["in_link"]:
                    state["links"] += len(text.strip())
            continue
        tag = tag.lower()
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE or tag == "br":
            if tag == "a":
                state["in_link"] = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if stack[-1][0] == "p":
            stack.pop()
        elif tag in CLOSES_ITSELF:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in CLOSES_ITSELF[tag]:
                    break
        if tag in VOID or attrs.endswith("/"):
            continue
        own, outer = _element_score(tag, attrs), stack[-1][2]
        stack.append((tag, next_id, min(own, outer) if own < 0 or outer < 0 else max(own, outer)))
        next_id += 1
    flush()
    return blocks


def shape_features(block: Block, place: float) -> tuple[str, ...]:
    """What a block looks like, in a fixed number of values, without its landmarks."""
    text = block.text
    words = text.count(" ") + 1
    density = block.links / max(1, len(text))
    return (f"words{min(10, words.bit_length())}", f"links{min(3, int(density * 4))}", f"tag:{_kind(block.tag)}",
            f"end{text[-1] in '.!?…。'}", f"commas{min(3, text.count(','))}", f"mark{text[0] in '©|»›·•'}",
            f"place{min(4, int(place * 5))}")


def _kind(tag: str) -> str:
    if tag in ("p", "li", "td", "th", "div", "blockquote", "pre", "section", "figcaption"):
        return tag
    return "heading" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else "other"


def _prior(block: Block) -> float:
    """Score of a block's shape before anything is learned: long text in favour, links against."""
    words = block.text.count(" ") + 1
    return (1.0 if words >= 12 else -0.5 if words < 4 else 0.0) + (0.5 if block.tag == "p" else 0.0) \
        - 3.0 * min(1.0, block.links / max(1, len(block.text)))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            blocks = page_blocks(page)
            for i, b in enumerate(blocks):
                if b.score in (CHROME_SCORE, MAIN_SCORE):
                    label = b.score > 0
                    counts[("", label)] += 1
                    counts.update((f, label) for f in shape_features(b, i / len(blocks)))
    rows = [(f, label, n) for (f, label), n in sorted(counts.items())]
    cols = list(zip(*rows)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()),
                                      pa.array(cols[2], pa.int64())], names=["feature", "content", "n"])


def learn_shapes(pages: DataFrame, html_col: str = "html", id_col: str | None = None, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds of every shape value, from the blocks that lie in a landmark element, of at most
    ``sample_pages`` pages, the first by a hash of id and html.

    What is collected is bounded by the feature values (about 50), not by the pages.
    """
    text = F.col(f"`{html_col}`").cast("string")
    key = F.xxhash64(*([F.col(f"`{id_col}`")] if id_col else []), F.octet_length(text), F.substring(text, 1, 200))
    keyed = pages.where(text.isNotNull()).select(key.alias("key"), text.alias("html"))
    # the cut is found on keys alone; equal pages of one id count once, however many there are
    cut = keyed.select("key").distinct().orderBy("key").limit(sample_pages).agg(F.max("key")).first()[0]
    sample = keyed.where(F.col("key") <= F.lit(cut)).groupBy("key").agg(F.min("html").alias("html")).select("html")
    counts = (sample.repartition(pages.sparkSession.sparkContext.defaultParallelism)
              .mapInArrow(_count_batches, "feature string, content boolean, n bigint")
              .groupBy("feature", "content").agg(F.sum("n").alias("n")).collect())
    n = {(r["feature"], r["content"]): r["n"] for r in counts}
    yes, no = n.pop(("", True), 0), n.pop(("", False), 0)
    if not yes or not no:
        return {}
    names = sorted({f for f, _ in n})
    return {f: math.log((n.get((f, True), 0) + 1) / (yes + 2)) - math.log((n.get((f, False), 0) + 1) / (no + 2))
            for f in names}


def block_scores(blocks: list[Block], weights: dict[str, float]) -> list[float]:
    """Cost of calling each block boilerplate minus that of calling it content."""
    out = []
    for i, b in enumerate(blocks):
        shape = _prior(b) + 0.5 * sum(weights.get(f, 0.0) for f in shape_features(b, i / len(blocks)))
        out.append(b.score + max(-SHAPE_LIMIT, min(SHAPE_LIMIT, shape)))
    return out


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbours (heavier the closer in the DOM) and between successive blocks
    of one parent that others separate."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, ...], int] = {}
    for i, b in enumerate(blocks):
        if i:
            other = blocks[i - 1].path
            same = 0
            for x, y in zip(other, b.path):
                if x != y:
                    break
                same += 1
            edges[i - 1, i] = ADJACENT + PROXIMITY / (1 + len(other) + len(b.path) - 2 * same)
        parent = b.path[:-1]
        if parent in last and last[parent] != i - 1:
            edges[last[parent], i] = SIBLING
        last[parent] = i
    return edges


def min_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) of least total cost; ties fall to boilerplate.

    A node whose score outweighs all its edges has its label in every minimum cut; such
    nodes are settled first and pass their edges on to their neighbours' scores.  What
    remains is solved by a maximum flow.
    """
    near: dict[int, dict[int, float]] = {i: {} for i in range(len(scores))}
    for (i, j), w in edges.items():
        near[i][j] = near[j][i] = near[i].get(j, 0.0) + w
    score, label = list(scores), [None] * len(scores)
    todo = deque(range(len(scores)))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(score[i]) <= sum(near[i].values()):
            continue
        label[i] = score[i] > 0
        for j, w in near[i].items():
            score[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        content = _source_side([score[i] for i in rest], [(place[i], place[j], w) for i in rest for j, w in near[i].items() if i < j])
        for i, k in place.items():
            label[i] = content[k]
    return label


def _source_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut, by blocking flows over shortest paths (every
    phase lengthens the shortest path, and passes each arc once)."""
    n = len(scores)
    source, sink = n, n + 1
    arcs: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def arc(u: int, v: int, there: float, back: float) -> None:
        arcs[u].append(len(to))
        arcs[v].append(len(to) + 1)
        to.extend((v, u))
        cap.extend((there, back))

    for i, j, w in edges:
        arc(i, j, w, w)
    for i, s in enumerate(scores):
        if s > 0:
            arc(source, i, s, 0.0)
        elif s < 0:
            arc(i, sink, -s, 0.0)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in arcs[u]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-12)
                u = to[path[first] ^ 1]
                del path[first:]
            while nxt[u] < len(arcs[u]):
                e = arcs[u][nxt[u]]
                if cap[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(arcs[u]):
                path.append(arcs[u][nxt[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                nxt[u] += 1
            else:
                break


def labelled_blocks(page: str | None, weights: dict[str, float]) -> tuple[list[Block], list[float], list[bool]]:
    """Blocks of a page, their scores, and the labels of the minimum cut (True: content)."""
    blocks = page_blocks(page)
    scores = block_scores(blocks, weights)
    return blocks, scores, min_cut(scores, smoothness(blocks))


def main_text(page: str | None, weights: dict[str, float]) -> str:
    blocks, _, labels = labelled_blocks(page, weights)
    return "\n\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, url, text and n_chars (code points) of every row.

    NULL and empty html, and pages of boilerplate only, have an empty text; broken markup is
    read as far as it goes; repeated rows are extracted one by one; other columns are
    ignored; an empty table gives an empty result.
    """
    weights = learn_shapes(pages, html_col, id_col)
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    kind = slim.schema["id"].dataType.simpleString()
    return (slim.mapInArrow(_extract(weights), f"id {kind}, url string, text string, n_chars bigint")
            .withColumnRenamed("id", id_col))
