"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into text blocks with the elements they stand in. A classifier gives every block a cost of being called
boilerplate or content, the capacity of its edge to one of two terminals. Neighbours in page order and neighbours under the
same parent are tied by smoothness edges. The minimum cut (by maximum flow) is the cheapest labelling of all blocks together:
a short odd paragraph follows its article, a long link list its menu. Pages are independent, so Spark maps over them.

The classifier is a logistic regression on the text itself: length, link density, element, depth, punctuation, neighbours. It is fitted
on a sample of pages whose elements say what a block is (an article, a menu, a footer), and then speaks for blocks that stand
in no such element; what elements and names say is added to its log odds. Names are weak evidence: one that holds more than
half of a page's text is no boilerplate, and never does it speak against the article, main or body element that bears it. Reader
comments alone are boilerplate at any length.
"""

from __future__ import annotations

import dataclasses
import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.session import stored

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|title|iframe|object)\b.*?(?:</(?P=raw)\s*>|\Z)
                       |<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>""",
                   re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr label".split())
CLOSES_P = frozenset("address article aside blockquote details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
                     "li main nav ol p pre section table tbody thead tfoot tr td th ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",)}
SCOPE = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote html figure".split())
# What elements and names say, in log odds. Positive speaks for content.
ELEMENT = {"article": 4.0, "main": 2.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "button": -8.0, "select": -8.0,
           "menu": -8.0, "dialog": -8.0, "head": -20.0, "header": -5.0, "label": -3.0, "fieldset": -6.0}
BODIES = frozenset(("html", "body", "article", "main"))
NAMES = {-8.0: "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
               "breadcrumb breadcrumbs footer cookie cookies consent notice notices alert gdpr popup modal overlay related "
               "recommended share sharing social newsletter subscribe subscription signup "
               "login search pagination pager widget toolbar topbar masthead copyright legal disclaimer",
         -5.0: "header tags tagcloud links teaser more trending popular",
         2.5: "article post entry content story body text main"}
NAME_WEIGHT = {name: weight for weight, names in NAMES.items() for name in names.split()}
READERS = frozenset("comment comments commentlist disqus discussion reply replies respond responses".split())
READER_WEIGHT = -9.0
# Names that say what an article is about and not what an element is.
TOPIC = re.compile(r"(?:category|cat|tag|tags|topic|author|type|status|format|post)[-_]", re.I)
ROLE_WEIGHT = {"navigation": -8.0, "banner": -6.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0, "dialog": -8.0,
               "alert": -8.0, "main": 2.0, "article": 4.0}
TIE_NEXT, TIE_SIBLING = 0.6, 0.8


def _hints(tag: str, rest: str) -> tuple[float, float, float]:
    """Of one element: its strongest hint against content, the strongest of its names alone, and the strongest for content."""
    bad, good, named = min(ELEMENT.get(tag, 0.0), 0.0), max(ELEMENT.get(tag, 0.0), 0.0), 0.0
    for name, value in ATTRIBUTE.findall(rest) if rest else ():
        name, value = name.lower(), value.strip("\"' ")
        if name in ("class", "id"):
            for token in value.split():
                parts = [p.lower() for p in NAME_PART.findall(token)]
                good = max([good, *(NAME_WEIGHT.get(p, 0.0) for p in parts)]) if tag not in ("html", "body") else good
                if tag in BODIES or TOPIC.match(token):
                    continue
                if READERS.intersection(parts):
                    bad = min(bad, READER_WEIGHT)
                else:
                    named = min([named, *(NAME_WEIGHT.get(p, 0.0) for p in parts)])
        elif name == "role":
            weight = ROLE_WEIGHT.get(value.lower(), 0.0)
            good = max(good, weight)
            if tag not in BODIES:
                bad = min(bad, weight)
        elif tag not in BODIES and (name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))):
            bad = -20.0
    return bad, named, good


class Block:
    """A stretch of text with the element it stands in (``tag``), that element's parent, its depth, and the hints above it."""

    __slots__ = ("text", "links", "tag", "parent", "depth", "bad", "good", "named")

    def __init__(self, text: str, links: int, tag: str, parent: int, depth: int, bad: float, good: float, named: tuple):
        self.text, self.links, self.tag, self.parent, self.depth = text, links, tag, parent, depth
        self.bad, self.good, self.named = bad, good, named


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order: character references decoded, white space as single blanks, empty ones left out."""
    blocks: list[Block] = []
    # tag, number, strongest hints on the way down, and the chain (hint, number, rest) of elements that only their names speak against
    stack: list[tuple[str, int, float, float, tuple]] = [("", 0, 0.0, 0.0, ())]
    pieces: list[str] = []
    number = links = in_link = 0

    def flush():
        nonlocal links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] not in INLINE), 0)
                tag, _, bad, good, _ = stack[at]
                blocks.append(Block(text, links, tag, stack[max(at - 1, 0)][1], at, min(bad, stack[-1][2]), good, stack[-1][4]))
            pieces.clear()
        links = 0

    def close(down_to: int):
        nonlocal in_link
        in_link -= sum(e[0] == "a" for e in stack[down_to:])
        del stack[down_to:]

    last = 0
    for m in TOKEN.finditer(page):
        if m.start() > last:
            pieces.append(page[last:m.start()])
            if in_link:
                links += m.start() - last
        last = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in ("svg", "object"):
                pieces.append(" ")
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img", "wbr"):
            pieces.append(" " if tag != "wbr" else "")
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in SCOPE and tag in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in SAME else ():
            if stack[i][0] in SAME[tag]:
                close(i)
                if tag != "tr":
                    break
            elif stack[i][0] in SCOPE:
                break
        bad, named, good = _hints(tag, m["rest"])
        number += 1
        chain = (named, number, stack[-1][4]) if named < 0 else stack[-1][4]
        stack.append((tag, number, min(bad, stack[-1][2]), max(good, stack[-1][3]), chain))
        in_link += tag == "a"
        if m["rest"].endswith("/") and tag not in INLINE:
            close(len(stack) - 1)
    if last < len(page):
        pieces.append(page[last:])
    flush()
    _weigh_names(blocks)
    return blocks


def _weigh_names(blocks: list[Block]) -> None:
    """Let names speak against blocks, but for those of elements that hold more than half of the page's text outside links."""
    held: dict[int, int] = {}
    total = 0
    for b in blocks:
        if b.bad <= -8.0:
            continue
        size = max(len(b.text) - b.links, 0)
        total += size
        chain = b.named
        while chain:
            held[chain[1]] = held.get(chain[1], 0) + size
            chain = chain[2]
    for b in blocks:
        chain = b.named
        while chain:
            if 2 * held.get(chain[1], 0) <= total:
                b.bad = min(b.bad, chain[0])
            chain = chain[2]


FEATURES = ("one", "length", "links", "paragraph", "item", "heading", "sentence", "depth", "length before", "length after")
MOST_ODDS = 3.0


@dataclasses.dataclass
class Model:
    """Weights of the features of a block. These stand in where no page says what its blocks are."""

    weights: tuple[float, ...] = (-0.8, 1.0, -3.0, 0.7, -0.3, 0.7, 0.0, 0.0, 0.0, 0.0)


def features(blocks: list[Block]) -> list[list[float]]:
    """What a block's text, place and neighbours tell, without the names and elements around it."""
    size = [min(len(b.text), 400) / 200 for b in blocks]
    rows = []
    for i, b in enumerate(blocks):
        heading = b.tag in ("h1", "h2", "h3")
        rows.append([1.0, size[i], min(1.0, b.links / len(b.text)), float(b.tag in ("p", "pre", "blockquote")), float(b.tag in ("li", "td", "th")),
                     float(heading), float(b.text[-1] in ".!?\u2026:;\"\u201d"), min(b.depth, 20) / 10,
                     size[i - 1] if i else 0.0, size[i + 1] if i + 1 < len(blocks) else 0.0])
    return rows


def costs(blocks: list[Block], model: Model) -> list[float]:
    """Score of every block on its own; above zero speaks for content."""
    odds = (np.array(features(blocks)) @ np.array(model.weights)).clip(-MOST_ODDS, MOST_ODDS)
    return [float(o) + b.good + b.bad for o, b in zip(odds, blocks)]


def fit(pages: DataFrame, sample_pages: int = 2_000, rounds: int = 8, ridge: float = 0.002) -> Model:
    """A model from about ``sample_pages`` rows of ``pages`` (html), drawn by a hash of the page (all, if there are no more).

    Blocks inside an article or main element that nothing speaks against are content, blocks that an element or a name clearly
    speaks against are boilerplate, the others teach nothing. Newton steps of a logistic regression; a step adds up one small matrix
    per task; ``ridge``, per labelled block, keeps weights moderate where the kinds part cleanly. Without blocks of both kinds the model is the one that stands in.
    """
    text = F.col("html").cast("string")
    known = pages.select(text.alias("html")).where("html <> ''")
    n = known.count()
    share = 1_000_000 * sample_pages // max(n, 1) + 1
    drawn = known if n <= sample_pages else known.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000).cast("long")) < share)
    width = len(FEATURES)

    def measure(batches):
        for batch in batches:
            for page in batch.column("html").to_pylist():
                blocks = blocks_of(page)
                labels = [1 if b.good >= 2.0 and b.bad >= 0 else 0 if b.bad <= -5.0 else -1 for b in blocks]
                rows = [(y, x) for y, x in zip(labels, features(blocks)) if y >= 0]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()),
                                                      pa.array([x for _, x in rows], pa.list_(pa.float64()))], ["y", "x"])

    blocks = stored(drawn.mapInArrow(measure, "y int, x array<double>"), "blocks")
    sizes = {r["y"]: r["n"] for r in blocks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    balance = {y: sum(sizes.values()) / (2 * n) for y, n in sizes.items()}
    weights, ridge = np.zeros(width), ridge * sum(sizes.values())
    for _ in range(rounds):
        def step(batches, weights=weights):
            for batch in batches:
                y = batch.column("y").to_numpy()
                x = batch.column("x").flatten().to_numpy().reshape(-1, width)
                c = np.where(y == 1, balance[1], balance[0])
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                found = np.r_[x.T @ (c * (p - y)), ((x * (c * p * (1 - p))[:, None]).T @ x).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.float64()))], ["v"])

        total = blocks.mapInArrow(step, "v array<double>").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width + width * width)]).first()
        total = np.array(total, dtype=float)
        move = np.linalg.solve(total[width:].reshape(width, width) + ridge * np.eye(width), total[:width] + ridge * weights)
        weights = weights - move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-4:
            break
    return Model(tuple(weights.tolist()))


def minimum_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source side of a minimum cut; scores are terminal capacities, ties undirected edges."""
    n = len(scores)
    source, sink = n, n + 1
    target: list[int] = []
    room: list[float] = []
    edges: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float):
        edges[a].append(len(target))
        target.append(b)
        room.append(there)
        edges[b].append(len(target))
        target.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, w in ties:
        join(a, b, w, w)
    while True:  # levels from the source, then a blocking flow along them
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in edges[a]:
                if room[e] > 1e-9 and level[target[e]] < 0:
                    level[target[e]] = level[a] + 1
                    queue.append(target[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = target[path[k] ^ 1]
                del path[k:]
            while at[a] < len(edges[a]):
                e = edges[a][at[a]]
                if room[e] > 1e-9 and level[target[e]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = target[path.pop() ^ 1]
                continue
            path.append(e)
            a = target[e]


def main_blocks(page: str, model: Model | None = None) -> list[str]:
    """The texts of the blocks that the cut calls content."""
    blocks = blocks_of(page)
    scores = costs(blocks, model or Model()) if blocks else []
    if all(s <= 0 for s in scores):
        return []
    ties, last_child = [], {}
    for i, b in enumerate(blocks):
        if i:
            # a hint on one side only marks a border between regions
            same = blocks[i - 1].bad == b.bad and blocks[i - 1].good == b.good
            ties.append((i - 1, i, TIE_NEXT if same else TIE_NEXT / 4))
        if b.parent in last_child:
            ties.append((last_child[b.parent], i, TIE_SIBLING))
        last_child[b.parent] = i
    return [b.text for b, keep in zip(blocks, minimum_cut(scores, ties)) if keep]


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text) per row of ``pages`` (page_id, url, html): content blocks in page order, one line each.

    ``model`` weighs the blocks; without it one is fitted on the pages. Null or empty html, and pages without content, give an empty
    text. Unclosed and crossed elements are closed where the next one implies it. Nothing is capped; repeated rows are answered
    one by one; an empty table gives an empty result; other columns are ignored.
    """
    model = model or fit(pages)

    def extract(batches):
        for b in batches:
            texts = ["\n".join(main_blocks(page, model)) if page else "" for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        extract, "page_id long, url string, text string")
