"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements; runs of text between block borders are the leaves. Every node has
features of its tag, its class, id and role tokens, its subtree (characters, words, link share, punctuation, leaves,
text density), its depth, its place among its siblings, and its ancestors. Spark's gradient-boosted trees estimate for
each node whether it holds main text. Hierarchical decoding then picks the best consistent choice: a node is kept only
together with all its ancestors, and the sum of log probabilities over the tree is the largest possible.

The trees are fitted on a bounded sample of pages (``train_pages``, by a hash of page_id) that mark their article by
an ``article`` or ``main`` element: text inside is main text, text outside is not. Each is used as it is and in
``variants`` rewritten forms that keep the texts but change the markup: other tags, classes and ids, and further
menus, notices, adverts, forms, sidebars and comments, so that the trees don't rest on one element.

Scripts, styles, the head, comments of the markup, embedded objects and form controls are dropped by the parser. Only
scripts, styles and comments without an end run to the end of the page. The head ends at the first tag that cannot be in
it; another dropped element ends with its parent and, if its end tag is missing, at the next block tag. Character references
are decoded; white space inside a leaf becomes one space, leaves are joined in page order by one space.

Defined results: null or empty html gives an empty text; markup may be broken anywhere (an unfinished tag at the end
is dropped). If no page of the sample marks an article, all leaves are kept. Rows with null ids are extracted too;
repeated rows give equal texts; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtables.llm import textarrays as ta

TRAIN_PAGES = 300
VARIANTS = 3
TREES, DEPTH = 16, 4
SLICE = 2 << 20
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])(?:[^>\"']*(?:\"[^\"]*\"|'[^']*'))*[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Groups of block tags; other tags are part of the text.
GROUPS = {
    "article": "article main",
    "section": "section",
    "division": "div body center html dd dl dt details summary address hgroup td th tr table tbody thead tfoot caption",
    "paragraph": "p blockquote pre figcaption figure",
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol menu dir li",
    "navigation": "nav",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form fieldset label legend dialog",
}
TAGS = {tag: i for i, tags in enumerate(GROUPS.values()) for tag in tags.split()}
ARTICLE, LEAF = 0, len(GROUPS)
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "hr"))
#: Elements whose text is dropped, those of them without markup inside, and those that may be empty as <svg/>.
DROPPED = frozenset("head title noscript template svg math iframe object select textarea button".split())
RAW, FOREIGN = frozenset(("title", "iframe", "textarea")), frozenset(("svg", "math"))
IN_HEAD = frozenset("head title noscript template base basefont bgsound link meta".split())
SELF_CLOSING = re.compile(r"(?:^|[\s\"'])/\s*\Z")
#: Kinds of open elements: kept, dropped with an end tag, dropped without one, the head.
KEPT, SUBTREE, LOOSE, HEAD = range(4)
#: Tags that end an open one of their own kind.
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
OUTSIDE = frozenset("ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist reply replies respond consent cookie cookies gdpr notice notices alert copyright footer foot header masthead menu nav navbar navigation newsletter subscribe signup login search popup modal overlay promo promoted promotion related recommended share sharing social sidebar side sponsor sponsored tags toolbar widget widgets rail teaser complementary contentinfo".split())
INSIDE = frozenset("article body content entry main post story text copy prose".split())
PUNCTUATION = re.compile(r"[.,;:!?]")
FEATURES = 11 + 1 + 24


def end_tags(tokens: list[re.Match]) -> dict[int, int]:
    """Token of the end tag of each start tag of a dropped element that has one."""
    out: dict[int, int] = {}
    begun: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        name = m[3] and m[3].lower()
        if name in DROPPED:
            if not m[2]:
                if name not in FOREIGN or not SELF_CLOSING.search(m[4]):
                    begun.setdefault(name, []).append(i)
            elif begun.get(name):
                out[begun[name].pop()] = i
    return out


class Nodes:
    """Nodes of many pages in page order, parents before children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.tag: list[int] = []
        self.outside: list[int] = []
        self.inside: list[int] = []
        self.counts: list[tuple[int, int, int, int]] = []  # characters, in links, words, punctuation of leaves
        self.text: list[str | None] = []
        self.page: list[int] = []

    def add(self, page: int, parent: int, tag: int, outside: int = 0, inside: int = 0, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.outside.append(outside)
        self.inside.append(inside)
        self.counts.append((len(text), min(linked, len(text)), text.count(" ") + 1, len(PUNCTUATION.findall(text))) if text else (0, 0, 0, 0))
        self.text.append(text)
        self.page.append(page)
        return len(self.parent) - 1

    def parse(self, page: int, html: str) -> None:
        """Add the tree of one page."""
        root = self.add(page, -1, TAGS["body"])
        stack: list[tuple[int, str, int]] = [(root, "body", KEPT)]  # node (-1: dropped), tag, kind; all above a dropped one are dropped
        pieces: list[str] = []
        linked, in_link = 0, False

        def flush() -> None:
            nonlocal pieces, linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.add(page, stack[-1][0], LEAF, text=text, linked=linked)
            pieces, linked = [], 0

        def say(raw: str) -> None:
            nonlocal linked
            if stack[-1][0] < 0:
                if stack[-1][2] != HEAD or head_ends or not raw.strip():
                    return
                stack.pop()
            raw = unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked += len(raw.strip())

        def loose(name: str) -> int:
            """Depth of the open element of that name among the loose ones on top, or 0."""
            depth = len(stack) - 1
            while stack[depth][2] == LOOSE and stack[depth][1] != name:
                depth -= 1
            return depth if stack[depth][2] == LOOSE else 0

        tokens = list(TOKEN.finditer(html))
        ends = end_tags(tokens)
        at, skipped, head_ends = 0, -1, False
        for i, m in enumerate(tokens):
            if i <= skipped:
                at = m.end()
                continue
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if stack[-1][2] == LOOSE:
                if m[2]:
                    depth = loose(name)
                    if depth:
                        del stack[depth:]
                        continue
                if m[2] or name in TAGS or name in BREAKS or (name in DROPPED and loose(name)):
                    while stack[-1][2] == LOOSE:
                        stack.pop()
            if stack[-1][2] == HEAD and (name == "body" if m[2] else name not in IN_HEAD):
                stack.pop()
            dropping = stack[-1][0] < 0
            if name == "a" and not dropping:
                in_link = not m[2]
                continue
            if name in BREAKS:
                if not dropping:
                    flush()
                continue
            if name in VOID:
                continue
            if m[2]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][1] == name:
                        if stack[depth][0] >= 0:
                            while stack[-1][0] < 0:
                                stack.pop()
                            flush()
                            in_link = False
                        del stack[depth:]
                        break
                continue
            empty = SELF_CLOSING.search(m[4])
            if name in DROPPED:
                if empty and (name in FOREIGN or i not in ends):
                    continue
                if name == "head":
                    if not dropping:
                        head_ends = i in ends
                        stack.append((-1, name, HEAD))
                elif name in RAW and i in ends:
                    skipped = ends[i]
                else:
                    stack.append((-1, name, SUBTREE if i in ends else LOOSE))
                continue
            if dropping:
                if stack[-1][2] != HEAD and not empty:
                    stack.append((-1, name, stack[-1][2]))
                continue
            tag, marks = TAGS.get(name), m[4]
            outside = inside = 0
            if marks and "=" in marks:
                for a in ATTRIBUTE.finditer(marks):
                    for word in PART.findall(a[1] or a[2] or a[3] or ""):
                        word = word.lower()
                        outside += word in OUTSIDE
                        inside += word in INSIDE
            if tag is None:
                if not outside:
                    continue  # inline
                tag = TAGS["div"]
            flush()
            in_link = False
            if stack[-1][1] == "p" and name in TAGS:
                stack.pop()
            kinds = OWN_KIND.get(name)
            if kinds:
                while len(stack) > 1 and stack[-1][1] in kinds:
                    stack.pop()
            if not marks.rstrip().endswith("/") or name in TAGS:
                stack.append((self.add(page, stack[-1][0], tag, outside, inside), name, KEPT))
        if at < len(html):
            say(html[at:])
        while stack[-1][0] < 0:
            stack.pop()
        flush()

    def matrix(self) -> np.ndarray:
        """Features of all nodes."""
        n = len(self.parent)
        parent, tag = np.array(self.parent, dtype=np.int64), np.array(self.tag, dtype=np.int64)
        up = np.maximum(parent, 0)
        own = np.concatenate((np.array(self.counts, dtype=np.float64).reshape(n, 4), (tag == LEAF)[:, None], (tag == TAGS["p"])[:, None], np.ones((n, 1))), axis=1)
        depth = np.zeros(n, dtype=np.int64)
        outside, inside = np.array(self.outside, dtype=np.float64), np.array(self.inside, dtype=np.float64)
        flags = np.stack([tag == g for g in range(len(GROUPS))], axis=1).astype(np.float64)
        above = np.zeros((n, len(GROUPS) + 2))
        rest, level = np.flatnonzero(parent >= 0), 0
        levels = [np.flatnonzero(parent < 0)]
        placed = parent < 0
        while len(rest):
            level += 1
            here = rest[placed[up[rest]] & (depth[up[rest]] == level - 1)]
            depth[here], placed[here] = level, True
            p = parent[here]
            above[here, : len(GROUPS)] = np.maximum(above[p, : len(GROUPS)], flags[p])
            above[here, len(GROUPS)] = above[p, len(GROUPS)] + outside[p]
            above[here, len(GROUPS) + 1] = above[p, len(GROUPS) + 1] + inside[p]
            levels.append(here)
            rest = rest[~placed[rest]]
        total = own.copy()
        for here in reversed(levels[1:]):
            np.add.at(total, parent[here], total[here])
        chars, linked, words, marks, leaves, paragraphs, size = total.T
        siblings = np.bincount(up[parent >= 0], minlength=n)
        place = np.zeros(n)
        order = np.lexsort((np.arange(n), up))
        new = np.append(True, up[order][1:] != up[order][:-1])
        place[order] = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
        whole = chars[np.flatnonzero(parent < 0)][np.cumsum(parent < 0) - 1] if n else chars
        some = np.maximum(chars, 1)
        around = np.where(parent >= 0, total[up, 0], chars)
        columns = [
            np.log1p(chars), linked / some, chars / np.maximum(words, 1), marks / np.maximum(words, 1), np.log1p(leaves), paragraphs / np.maximum(leaves, 1),
            chars / size, chars / np.maximum(leaves, 1), chars / np.maximum(whole, 1), chars / np.maximum(around, 1),
            depth, np.where(parent >= 0, siblings[up], 0), place, place / np.maximum(siblings[up], 1), siblings,
            outside, inside, above[:, len(GROUPS)], above[:, len(GROUPS) + 1],
            above[:, ARTICLE], above[:, 6] + above[:, 9] + above[:, 10], above[:, 7] + above[:, 8], above[:, 5],
            tag[up] * (parent >= 0),
        ]
        return np.concatenate((flags, (tag == LEAF)[:, None], np.stack(columns, axis=1)), axis=1) if n else np.zeros((0, FEATURES))

    def article_nodes(self) -> np.ndarray:
        """1 for nodes that hold a leaf inside an article element, else 0."""
        good = np.zeros(len(self.parent), dtype=np.int64)
        within = np.zeros(len(self.parent), dtype=bool)
        for i, p in enumerate(self.parent):
            within[i] = self.tag[i] == ARTICLE or (p >= 0 and within[p])
        for i in range(len(self.parent) - 1, -1, -1):
            if self.text[i] is not None and within[i]:
                good[i] = 1
            if good[i] and self.parent[i] >= 0:
                good[self.parent[i]] = 1
        return good


MARK = "\ue000"  # of main text in rewritten pages; a private-use character


def rewritten(nodes: Nodes, rng: Random) -> str:
    """A page of the same texts in other markup; leaves of main text begin with MARK."""
    good = nodes.article_nodes()
    main = [t for t, g in zip(nodes.text, good, strict=True) if t and g]
    rest = [t for t, g in zip(nodes.text, good, strict=True) if t and not g] or ["Menu"]
    pool = " ".join(main + rest).split()
    pick = rng.choice

    def prose(low: int, high: int) -> str:
        at = rng.randrange(len(pool))
        return " ".join(pool[at : at + rng.randint(low, high)])

    def links(n: int) -> str:
        item = pick(("<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<li class='item'><a href='/x'>{}</a>", "<div><a href='/x'>{}</a></div>"))
        return "".join(item.format(prose(1, 3)) for _ in range(n))

    def wrap(form: str, inner: str) -> str:
        tag, _, marks = form.partition(" ")
        return f"<{form}>{inner}</{tag}>" if marks or tag else inner

    def paragraphs(n: int) -> str:
        return "".join(f"<p>{prose(5, 60)}</p>" for _ in range(n))

    menu = lambda: wrap(pick(("nav", "ul class='menu'", "div id='navigation'", "div class='nav-bar'", "ul", "ol class='breadcrumb'", "div class='tabs'", "nav class='top'")), links(rng.randint(2, 8)))
    top = lambda: wrap(pick(("header", "div class='header'", "div id='masthead'", "header class='site-header'")), pick(("", "<h1>{}</h1>", "<p>{}</p>", "<div class='logo'>{}</div>", "{}")).format(prose(1, 8)) + pick(("", menu())))
    notice = lambda: wrap(pick(("div class='cookie-notice'", "div class='notice'", "div id='consent'", "div class='alert'", "section class='banner'", "div role='alert'", "p class='notice'")), pick((prose(5, 40), paragraphs(1), prose(4, 30) + "<button>OK</button>")))
    advert = lambda: wrap(pick(("div class='ad'", "div class='ads'", "aside class='advert'", "div id='sponsored'", "div class='promo'", "div class='ad-slot'", "ins class='advertisement'", "div class='advertising'")), pick((prose(3, 40), paragraphs(1), links(2))))
    side = lambda: wrap(pick(("aside", "div class='sidebar'", "div id='right-rail'", "div class='widget'", "section class='related'", "aside class='side'", "div class='recommended'")), pick(("", "<h2>{}</h2>", "<h3>{}</h3>")).format(prose(1, 4)) + pick((links(4), paragraphs(2), prose(5, 50))))
    form = lambda: wrap(pick(("form", "form class='search'", "form class='newsletter'", "div class='subscribe'", "form id='login'")), f"<label>{prose(1, 4)}</label><input type='text'>" + pick(("", f"<p>{prose(4, 25)}</p>", prose(2, 12))))
    comments = lambda: wrap(pick(("section class='comments'", "div id='comments'", "ol class='commentlist'", "div class='comment-thread'", "section id='replies'", "aside class='comments'")), pick(("", "<h2>{}</h2>", "<h3>{}</h3>")).format(prose(1, 3)) + "".join(wrap(pick(("div class='comment'", "li", "article class='comment'", "div", "p")), pick((prose(4, 60), f"<p>{prose(4, 60)}</p>"))) for _ in range(rng.randint(1, 5))))
    foot = lambda: wrap(pick(("footer", "div id='footer'", "div class='footer'", "div class='copyright'", "footer class='site'")), pick((prose(3, 30), paragraphs(1), links(3), "&copy; " + prose(2, 10))))
    body, block = [], pick(("p", "p", "p", "div"))
    for i, text in enumerate(main):
        if i == 0:
            shape = pick(("h1", "h1", "h2", "p", "div class='title'"))
        else:
            shape = pick((block,) * 9 + ("h2", "blockquote", "ul><li", "pre", "h3", "p class='lead'"))
        if i and rng.random() < 0.04:
            body.append(pick((advert, side, form, notice))())
        text = MARK + text.replace("&", "&amp;").replace("<", "&lt;")
        body.append("<ul><li>" + text + "</li></ul>" if shape == "ul><li" else wrap(shape, text))
    inner = "".join(body) + (comments() if rng.random() < 0.15 else "")
    story = wrap(pick(("article", "article", "main", "div id='content'", "div class='post'", "div class='entry-content'", "div class='story-body'", "section", "div", "div class='main'", "main id='main'")), inner)
    if rng.random() < 0.3:
        story = wrap(pick(("div", "main", "section", "div class='wrapper'", "div id='page'")), story + pick(("", side(), comments(), advert())))
    maybe = lambda make, p: make() if rng.random() < p else ""
    before = [maybe(top, 0.5), maybe(menu, 0.7), maybe(notice, 0.3), maybe(advert, 0.4), maybe(side, 0.2), maybe(form, 0.2)]
    after = [maybe(comments, 0.35), maybe(side, 0.4), maybe(advert, 0.2), maybe(form, 0.2), maybe(notice, 0.15), maybe(foot, 0.8)]
    page = "".join(before) + story + "".join(after)
    return f"<html><body>{wrap(pick(('div class=page', 'div', 'div id=container')), page) if rng.random() < 0.4 else page}</body></html>"


def training_nodes(pages: DataFrame, train_pages: int, variants: int) -> DataFrame:
    """(label, features) of the nodes of the sampled pages and of their rewritten forms."""
    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("page_id", "html")
    keys = marked.select(F.xxhash64("page_id", "html").alias("k")).distinct().orderBy("k").limit(train_pages)  # at most train_pages keys
    sample = marked.withColumn("k", F.xxhash64("page_id", "html")).join(F.broadcast(keys), "k").dropDuplicates(["k"]).select("k", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes = Nodes()
                nodes.parse(0, html)
                parts = [(nodes.article_nodes(), nodes.matrix())]
                if parts[0][0].any():
                    for v in range(variants):
                        other = Nodes()
                        other.parse(0, rewritten(nodes, Random(key * 31 + v)))
                        good = np.zeros(len(other.parent), dtype=np.int64)
                        for i in range(len(good) - 1, -1, -1):
                            good[i] |= bool(other.text[i] and other.text[i].startswith(MARK))
                            if good[i] and other.parent[i] >= 0:
                                good[other.parent[i]] = 1
                        parts.append((good, other.matrix()))
                label, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(label) + 1) * FEATURES, FEATURES, dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.float64)), lists], names=["label", "x"])

    return sample.repartition(8, "k").mapInArrow(run, "label double, x array<double>")


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES, variants: int = VARIANTS) -> list[dict] | None:
    """Trees as arrays; None without marked articles."""
    rows = training_nodes(pages, train_pages, variants).select("label", array_to_vector("x").alias("features")).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=64, stepSize=0.3, seed=5).fit(rows)
    finally:
        rows.unpersist()
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        flat: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}

        def walk(node, flat: dict = flat, weight: float = weight) -> int:
            i = len(flat["value"])
            for k, v in (("feature", 0), ("threshold", 0.0), ("left", i), ("right", i), ("value", weight * node.prediction())):
                flat[k].append(v)
            if node.getClass().getSimpleName() == "InternalNode":
                flat["feature"][i], flat["threshold"][i] = node.split().featureIndex(), node.split().threshold()
                flat["left"][i], flat["right"][i] = walk(node.leftChild()), walk(node.rightChild())
            return i

        walk(tree._java_obj.rootNode())
        out.append({k: np.array(v) for k, v in flat.items()})
    return out


def log_odds(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """Twice the margin of the boosted trees, the log odds of main text."""
    margin = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            at = np.where(x[rows, t["feature"][at]] <= t["threshold"][at], t["left"][at], t["right"][at])
        margin += t["value"][at]
    return 2 * margin


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Nodes to keep: the best set that holds with each node its ancestors. A dropped node scores 0, a kept one its log odds."""
    gain = odds.tolist()
    for i in range(len(parent) - 1, -1, -1):
        if gain[i] > 0 and parent[i] >= 0:
            gain[parent[i]] += gain[i]
    keep = np.zeros(len(parent), dtype=bool)
    for i, p in enumerate(parent):
        keep[i] = gain[i] > 0 and (p < 0 or keep[p])
    return keep


def extract(pages: DataFrame, trees: list[dict] | None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    ta.bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trees)  # TREES trees of depth DEPTH
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.row_slices(batch, "html", SLICE):
                nodes = Nodes()
                for i, html in enumerate(part.column(2).to_pylist()):
                    if html:
                        nodes.parse(i, html)
                keep = np.ones(len(nodes.parent), dtype=bool)
                if shared.value is not None and len(keep):
                    keep = decode(nodes.parent, log_odds(shared.value, nodes.matrix()))
                texts: list[list[str]] = [[] for _ in range(part.num_rows)]
                for i in np.flatnonzero(keep).tolist():
                    if nodes.text[i]:
                        texts[nodes.page[i]].append(nodes.text[i])
                out = [" ".join(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES, variants: int = VARIANTS) -> DataFrame:
    """page_id, url, text, n_chars: trees fitted on a sample of the pages, applied to all."""
    return extract(pages, fit(pages, train_pages, variants))
