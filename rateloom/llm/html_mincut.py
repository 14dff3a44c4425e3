"""Main text of HTML pages by minimum-cut labelling.

A page becomes a graph of its text blocks and of those elements around them that tell something (``nav``, ``article``, a
class named ``sidebar``). What a word of a class or id tells is learned, around a prior, from where its blocks stand in
pages that mark their main part; of a name with several words the last counts as much as all others, and the less the fewer
are known, so that ``share-price-table`` tells little. A linear classifier over a block's own length, links and punctuation gives its cost of being
content or boilerplate; it is fitted, around a prior, on blocks of a bounded sample of pages that such elements label. The
costs, and the elements' evidence for each block below them, are the capacities to the two terminals. Smoothness edges
join a block to the nearest telling element, such an element to the next one above it, and blocks that follow each other
or are siblings, all the weaker the farther apart they are in the document tree. What stands in boilerplate can hardly be content, while content may hold
boilerplate, so edges up the tree weigh more one way. The minimum cut separates content from boilerplate; the content
blocks are returned in page order.
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

from ..shared import importable, save
from .word_cache import sliced

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+(?:["'][^<>]*+)?)(?:>|(?=<)|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
RAW_TEXT = frozenset("script style textarea title iframe noscript template svg math object canvas select".split())
#: The end of each, in any case; a longer name does not end it.
RAW_END = {tag: re.compile(rf"</{tag}(?![a-zA-Z0-9:-])[^>]*(?:>|\Z)", re.I | re.A) for tag in RAW_TEXT}
#: An open element of the first kind ends where one of the second kind begins.
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Evidence of an element for content (+) or boilerplate (-), in hundredths of a log odds for each block in it.
TAG_COST = {"article": 500, "main": 400, "nav": -900, "footer": -900, "aside": -900, "header": -700, "form": -900, "menu": -900, "button": -900, "dialog": -900, "label": -400, "address": -300}
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion recommended related replies respond rail search share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar tracking warning widget".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of names that say nothing of the text.
GENERIC = frozenset("area bar block bottom box btn component container element global group holder inner item js left list module outer page panel right row section site slot top unit wrap wrapper zone".split())
#: What a listed word tells before its places are counted, in hundredths of a log odds.
BAD_WORD, GOOD_WORD = -900, 250
PRIOR_WORDS = dict.fromkeys(GOOD_WORDS, GOOD_WORD) | dict.fromkeys(BAD_WORDS, BAD_WORD)
WORD = re.compile(r"[a-z]+")
#: Features of a block, and the classifier's weights before it is fitted (log odds).
FEATURES = ("one", "links", "length", "stop")
PRIOR = np.array([0.2, -3.5, 0.4, 0.6])
#: Bounds of the sample that the weights are fitted on, and the blocks that it counts as beside the prior.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_WEIGHT = 2000, 20_000, 200.0
#: Words of classes and ids that are learned at most, the blocks that the prior counts as, and the least evidence that is kept.
SAMPLE_WORDS, WORD_WEIGHT, LEAST_WORD = 2000, 4.0, 100
#: Elements that mark a page's main part, and steps up the tree in which they are looked for.
MAIN_TAGS, MAIN_STEPS = frozenset(["article", "main"]), 64
#: Largest cost of a block, in hundredths of a log odds.
MOST = 300
#: Capacities: a content block in a boilerplate element, the reverse; an element (for each block in it) likewise, and the reverse; neighbours.
INTO_BAD, OUT_OF_GOOD, ELEMENT_INTO_BAD, ELEMENT_OUT_OF_GOOD, NEAR = 800, 400, 1000, 300, 120
#: Steps up the tree in which a common element of neighbours is looked for.
NEAR_STEPS = 4


class Element:
    """``teller``: the nearest element, itself included, whose tag or attributes tell something."""

    __slots__ = ("attributes", "blocks", "cost", "depth", "inside", "number", "parent", "tag", "teller")

    def __init__(self, tag: str, parent: "Element | None", attributes: str, words: dict[str, int] = PRIOR_WORDS):
        self.tag, self.parent, self.blocks, self.number, self.attributes = tag, parent, 0, -1, attributes
        self.depth = parent.depth + 1 if parent else 0
        self.inside = parent is not None and (parent.inside or parent.tag in MAIN_TAGS)
        self.cost = element_cost(tag, attributes, self.inside, words)
        self.teller = self if self.cost else parent.teller if parent else None


def names_of(attributes: str) -> list[list[str]]:
    """The words of each name in an element's classes and id."""
    return [WORD.findall(n) for name, a, b, c in ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for n in (a or b or c).lower().split()]


def name_cost(name: list[str], words: dict[str, int]) -> int:
    """What a name tells: its last word as much as the mean of the others, less the share of words that are not known."""
    own = [words.get(w) for w in name if w not in GENERIC]
    if not own:
        return 0
    *before, last = [x or 0 for x in own]
    told = (last + sum(before) / len(before)) / 2 if before else last
    return int(told * sum(x is not None for x in own) / len(own))


def element_cost(tag: str, attributes: str, inside: bool, words: dict[str, int] = PRIOR_WORDS) -> int:
    """What the tag and attributes tell; of an element's names the worst counts, else the best."""
    cost = TAG_COST.get(tag, 0)
    if tag == "header" and inside:
        cost = -300
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role":
                cost += -900 if value in BAD_ROLES else 400 if value in ("main", "article") else 0
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                cost -= 900
        told = [name_cost(name, words) for name in names_of(attributes)]
        if told:
            cost += min(told) if min(told) < 0 else max(told)
    return cost


def blocks_of(page: str, words: dict[str, int] = PRIOR_WORDS) -> list[tuple[str, int, int, Element]]:
    """(text, its characters, those of them in links, innermost block element) of each block with text, in page order."""
    out: list[tuple[str, int, int, Element]] = []
    top = node = Element("", None, "")
    inline_links, opened = 0, Counter()
    held: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                links = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
                out.append((text, len(text), min(links, len(text)), node))
            held.clear()
            linked.clear()

    at = 0
    while True:
        m = TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            held.append(piece)
            if inline_links:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m.end() == m.start():
            at += 1
            continue
        if m[1]:
            if tag == "a":
                inline_links = max(0, inline_links - 1)
            if tag in INLINE:
                continue
            if tag == "br":
                held.append(" ")
                continue
            if opened[tag]:
                flush()
                inline_links = 0
                while True:
                    x, node = node, node.parent
                    opened[x.tag] -= 1
                    if x.tag == tag:
                        break
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in INLINE and tag != "img":
            if tag == "a":
                inline_links += 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW_TEXT:
            close = RAW_END[tag].search(page, at)
            if close:
                at = close.end()
            elif tag in ("script", "style"):
                at = len(page)
            continue
        flush()
        inline_links = 0
        if tag in ("html", "head", "body"):
            continue
        while node is not top and node.tag in CLOSED_BY and tag in CLOSED_BY[node.tag]:
            opened[node.tag] -= 1
            node = node.parent
        node = Element(tag, node, m[3], words)
        opened[tag] += 1
    flush()
    return out


def block_features(text: str, size: int, links: int, _: Element) -> list[float]:
    """What the block's own text tells; elements speak by their evidence and the edges."""
    return [1.0, links / size, min(size, 400) / 100, text[-1] in ".!?:;\"'»”…"]


def seed(element: Element) -> int | None:
    """What the elements around a block say it is: 0 inside any boilerplate, 1 inside content alone."""
    x, label = element.teller, None
    for _ in range(64):
        if x is None:
            break
        if x.cost < 0:
            return 0
        label = 1
        x = x.parent.teller if x.parent else None
    return label


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which nodes stay with the source (content). ``edges``: (i, j, price of i alone with the source, of j alone). Dinic's algorithm."""
    n = len(costs)
    if all(c >= 0 for c in costs) or all(c <= 0 for c in costs):
        return [all(c >= 0 for c in costs)] * n
    source, sink = n, n + 1
    to: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(there)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            join(source, i, c, 0)
        elif c < 0:
            join(i, sink, -c, 0)
    for i, j, there, back in edges:
        join(i, j, there, back)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if left[e] == 0)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def steps_apart(a: Element, b: Element) -> int:
    """Steps between two elements over their common one; more than ``2 * NEAR_STEPS`` if it is not near."""
    above, x = {}, a
    for k in range(NEAR_STEPS + 1):
        above[id(x)] = k
        x = x.parent
        if x is None:
            break
    x = b
    for k in range(NEAR_STEPS + 1):
        if id(x) in above:
            return k + above[id(x)]
        x = x.parent
        if x is None:
            break
    return 2 * NEAR_STEPS + 1


def graph_of(blocks: list[tuple[str, int, int, Element]], weights: np.ndarray) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """Costs of the blocks and then of the telling elements around them, and the edges."""
    logit = np.array([block_features(*b) for b in blocks], float) @ weights
    costs = np.clip(np.round(100 * logit), -MOST, MOST).astype(int).tolist()
    edges, tellers, last = [], [], {}
    for i, (_, _, _, element) in enumerate(blocks):
        x = element.teller
        if x:
            if x.number < 0:
                x.number = len(blocks) + len(tellers)
                tellers.append(x)
            x.blocks += 1
            steps = min(element.depth - x.depth, 2 * NEAR_STEPS)
            edges.append((i, x.number, 2 * INTO_BAD // (2 + steps), 2 * OUT_OF_GOOD // (2 + steps)))
        if i and blocks[i - 1][3].teller is x:
            near = NEAR // (1 + steps_apart(blocks[i - 1][3], element))
            edges.append((i - 1, i, near, near))
        family = id(element.parent or element), id(x)
        if last.get(family, i - 1) != i - 1:
            edges.append((last[family], i, NEAR // 3, NEAR // 3))
        last[family] = i
    for x in tellers:  # grows by the elements above
        up = x.parent.teller if x.parent else None
        if up and up.number < 0:
            up.number = len(blocks) + len(tellers)
            tellers.append(up)
    for x in sorted(tellers, key=lambda x: x.depth, reverse=True):
        up = x.parent.teller if x.parent else None
        if up:
            up.blocks += x.blocks
            edges.append((x.number, up.number, ELEMENT_INTO_BAD * x.blocks, ELEMENT_OUT_OF_GOOD))
    return costs + [x.cost * x.blocks for x in tellers], edges


def main_text(page: str | None, weights: np.ndarray = PRIOR, words: dict[str, int] = PRIOR_WORDS) -> str:
    """The content blocks of a page, joined by one space; empty if there are none."""
    blocks = blocks_of(page or "", words)
    if not blocks:
        return ""
    return " ".join(b[0] for b, content in zip(blocks, minimum_cut(*graph_of(blocks, weights))) if content)


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic weights around the prior (unit variance); both labels weigh alike, all blocks together ``SAMPLE_WEIGHT``."""
    if len(np.unique(y)) < 2:
        return PRIOR
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * SAMPLE_WEIGHT
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (each * (y - p)) - (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_classifier(pages: DataFrame, html_col: str = "html", most: int = SAMPLE_PAGES, blocks: int = SAMPLE_BLOCKS) -> np.ndarray:
    """Weights of ``FEATURES`` from blocks of about ``most`` pages, chosen by a hash, that the elements around them label; at
    most ``blocks`` rows of numbers come to the driver. Without both labels the prior stays."""
    importable(pages.sparkSession)
    share = max(1, pages.count() // most)
    rows = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.pmod(F.xxhash64(F.lit(5), "html"), F.lit(share)) == 0)
    names = ["label", *FEATURES]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            found = [(s, *block_features(*b)) for page in batch.column("html").to_pylist() for b in blocks_of(page or "") if (s := seed(b[3])) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (zip(*found) if found else [[]] * len(names))], names=names)

    found = save(rows.mapInArrow(learn, ", ".join(f"{n} double" for n in names)), "labelled-blocks")
    some = found.orderBy(F.xxhash64(*names), *names).limit(blocks).toPandas().to_numpy()
    some = some[np.lexsort(some.T)]
    return fit_weights(some[:, 1:], some[:, 0])


def places(page: str) -> list[tuple[str, bool]]:
    """Each word of a class or id with whether a block below it stands in the page's main part; ``("", ...)`` for the block.

    Pages without a main part tell nothing, nor do blocks of it that a listed word or another telling tag keeps out.
    """
    blocks, out = blocks_of(page), []
    paths = []
    for _, _, _, x in blocks:
        path = []
        while x is not None and len(path) < MAIN_STEPS:
            path.append(x)
            x = x.parent
        paths.append(path)
    if any(x.tag in MAIN_TAGS for path in paths for x in path):
        for path in paths:
            inside = any(x.tag in MAIN_TAGS for x in path)
            if not inside or all(x.cost >= 0 for x in path):
                out.append(("", inside))
                out += [(w, inside) for w in {w for x in path if x.attributes for name in names_of(x.attributes) for w in name}]
    return out


def word_weights(counts: dict[str, tuple[int, int]]) -> dict[str, int]:
    """What words tell, from (blocks in the main part, blocks outside) of each and of all blocks (``""``); the prior counts as
    ``WORD_WEIGHT`` blocks, so that an unlisted word tells nothing until it is seen."""
    told = dict(PRIOR_WORDS)
    within, out = counts.get("", (0, 0))
    share = (within + 1) / (within + out + 2)
    base = np.log(share / (1 - share))
    for word, (n, m) in counts.items():
        if word:
            before = 1 / (1 + np.exp(-(base + PRIOR_WORDS.get(word, 0) / 100)))
            p = (n + WORD_WEIGHT * before) / (n + m + WORD_WEIGHT)
            weight = int(np.clip(round(100 * (np.log(p / (1 - p)) - base)), BAD_WORD, -BAD_WORD))
            if abs(weight) >= LEAST_WORD:
                told[word] = weight
            else:
                told.pop(word, None)
    return told


def fit_words(pages: DataFrame, html_col: str = "html", most: int = SAMPLE_PAGES, words: int = SAMPLE_WORDS) -> dict[str, int]:
    """What words of classes and ids tell, from about ``most`` pages, chosen by a hash; counts of the ``words`` most frequent
    words come to the driver."""
    importable(pages.sparkSession)
    share = max(1, pages.count() // most)
    rows = pages.select(F.col(html_col).cast("string").alias("html")).filter(F.pmod(F.xxhash64(F.lit(5), "html"), F.lit(share)) == 0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            within, out = Counter(), Counter()
            for page in batch.column("html").to_pylist():
                for word, inside in places(page or ""):
                    (within if inside else out)[word] += 1
            found = sorted(within.keys() | out.keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([within[w] for w in found], pa.int64()), pa.array([out[w] for w in found], pa.int64())], names=["word", "within", "out"])

    counted = rows.mapInArrow(look, "word string, within long, out long").groupBy("word").agg(F.sum("within").alias("n"), F.sum("out").alias("m"))
    some = counted.orderBy(F.col("word") != "", -(F.col("n") + F.col("m")), "word").limit(words + 1).collect()
    return word_weights({r.word: (r.n, r.m) for r in some})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None, words: dict[str, int] | None = None) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``. Null and empty html give an empty text; broken markup is read on
    to its end; repeated rows are all returned; other columns are not read; an empty table gives no rows. The classifier is
    fitted on these pages unless its ``weights`` are given, likewise what ``words`` of classes and ids tell."""
    importable(pages.sparkSession)
    weights = fit_classifier(pages, html_col) if weights is None else weights
    words = fit_words(pages, html_col) if words is None else words

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [main_text(x, weights, words) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
