"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of block elements with its text blocks as leaves (inline markup belongs to a block's text). Each
node has a label, main content or not, with a potential that depends on its tag, the words of its class and id, and the
text below it; parent and child are tied by potentials that depend on both tags. Messages passed upward and
then downward (sum-product) give each node's exact marginal; a block whose marginal is one half or more is content. The
potentials are fitted by maximum likelihood on labelled pages, whose expected counts come from the same messages. All
pages of a batch pass their messages together, level by level.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin_task, small_batches
from .importance import free_name

#: Labelled pages that the model is fitted on at most.
SAMPLE_PAGES = 500
#: Nodes whose messages pass together.
NODES = 200_000
STEPS, RATE, PENALTY = 120, 0.15, 0.002

# Tags of HTML, by what they do to the tree.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr input link meta base param area col embed".split())
RAW = "script|style|template|noscript|svg|math|iframe|object|canvas|audio|video|textarea|select|button|title|datalist|map"
PAGE = frozenset(("html", "head", "body"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An element's start closes an open one of these kinds, up to the nearest of the second list.
CLOSED_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",))}
#: Kinds of tags that share weights.
KINDS = {tag: i for i, tags in enumerate(("root", "text", "p", "div", "article", "main", "section", "nav menu", "header", "footer", "aside", "form fieldset", "ul ol dl", "li dt dd", "h1", "h2 h3 h4 h5 h6 hgroup", "table tbody thead tfoot tr", "td th", "blockquote pre address", "figure figcaption", "dialog details summary"), 0) for tag in tags.split()}
OTHER = 1 + max(KINDS.values())
#: Words of class, id and role, by what they tell.
HINTS = [set(x.split()) for x in ("nav navbar navigation menu breadcrumb breadcrumbs pager pagination tabs sitemap topnav subnav", "header masthead banner logo branding topbar", "footer colophon copyright legal bottom contentinfo", "sidebar aside widget widgets rail related recommended recommendations popular trending teaser complementary", "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted", "cookie cookies consent gdpr notice notification alert popup modal overlay toast disclaimer privacy", "newsletter subscribe subscription signup login signin register search form", "comment comments commentlist reply replies disqus respond discussion thread", "share sharing social tools toolbar buttons follow", "article content main post entry story articlebody body text prose page", "hidden none offscreen")]
_HINT = {word: 1 << i for i, words in enumerate(HINTS) for word in words}
MAIN_LABEL = "data-main"

_MARK = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-z][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(rf"(?:^|\s)(class|id|role|itemprop|style|hidden|{MAIN_LABEL})(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、]")


class Forest:
    """The trees of several pages; nodes in page order, parents before children."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.level: list[int] = []
        self.kind: list[int] = []
        self.hints: list[int] = []
        self.label: list[int] = []
        self.roots: list[int] = []
        self.leaves: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self._attributes: dict[str, tuple[int, int | None]] = {}

    def _read(self, attributes: str) -> tuple[int, int | None]:
        """Hints and the label of a tag's attributes."""
        if not attributes or attributes.isspace():
            return 0, None
        known = self._attributes.get(attributes)
        if known is None:
            hints, label = 0, None
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == MAIN_LABEL:
                    label = int(value == "1")
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hints |= _HINT["hidden"]
                elif name != "style":
                    for word in _CAMEL.split(value):
                        hints |= _HINT.get(word.lower(), 0)
            known = self._attributes[attributes] = hints, label
        return known

    def _node(self, parent: int, kind: int, hints: int, label: int) -> int:
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1 if len(self.parent) - 1 != parent else 0)
        self.kind.append(kind)
        self.hints.append(hints)
        self.label.append(label)
        return len(self.parent) - 1

    def add(self, html: str) -> None:
        """Parse a page; whatever is not closed ends with its parent or the page."""
        root = self._node(len(self.parent), KINDS["root"], 0, 0)
        self.roots.append(root)
        names, nodes, count = [""], [root], {}
        parts: list[str] = []
        linked, in_link, at = 0, 0, 0

        def flush() -> None:
            nonlocal linked, in_link
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    here = nodes[-1]
                    self.leaves.append(self._node(here, KINDS["text"], 0, self.label[here]))
                    self.texts.append(text)
                    self.linked.append(min(linked, len(text)))
                parts.clear()
            linked = 0

        def close(name: str) -> None:
            flush()
            while True:
                top = names.pop()
                nodes.pop()
                count[top] -= 1
                if top == name:
                    return

        for mark in _MARK.finditer(html):
            if mark.start() > at:
                text = html[at : mark.start()]
                text = entities.unescape(text) if "&" in text else text
                parts.append(text)
                if in_link:
                    linked += len(text)
            at = mark.end()
            name = mark[3]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    in_link = 0 if mark[2] else 1
                elif name == "br":
                    parts.append(" ")
                continue
            if name in PAGE:
                self.label[root] = self._read(mark[4])[1] or 0
                continue
            if mark[2]:
                if count.get(name):
                    close(name)
                    in_link = 0
                else:
                    flush()
                continue
            flush()
            if count.get("p") and name in CLOSES_P:
                close("p")
            if name in CLOSED_BY:
                ends, bounds = CLOSED_BY[name]
                i = len(names) - 1
                while i > 0 and names[i] not in bounds:
                    i -= 1
                outer = next((x for x in names[i + 1 :] if x in ends), None)
                while outer and count.get(outer) and outer in names[i + 1 :]:
                    close(outer)
            if name == "hr":
                continue
            hints, label = self._read(mark[4])
            here = nodes[-1]
            node = self._node(here, KINDS.get(name, OTHER), hints, self.label[here] if label is None else label)
            if not mark[4].endswith("/") or name in KINDS:
                names.append(name)
                nodes.append(node)
                count[name] = count.get(name, 0) + 1
                in_link = 0
        if at < len(html):
            parts.append(entities.unescape(html[at:]))
        flush()
        self.label[root] = 0


def _bins(x: np.ndarray, edges: Iterable[float]) -> np.ndarray:
    return np.searchsorted(np.array(list(edges)), x, "right")


class Graph:
    """A forest as arrays: levels, features and edges."""

    def __init__(self, forest: Forest) -> None:
        self.parent = np.array(forest.parent, np.int64)
        level = np.array(forest.level, np.int64)
        self.kind = np.array(forest.kind, np.int64)
        self.label = np.array(forest.label, np.int64)
        self.roots = np.array(forest.roots, np.int64)
        self.leaves = np.array(forest.leaves, np.int64)
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(1, level.max(initial=0) + 2))
        #: Nodes of each level below the root's.
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n, leaves = len(level), self.leaves
        sums = np.zeros((5, n))  # characters, characters in links, words, punctuation, blocks
        sums[0, leaves] = [len(t) for t in forest.texts]
        sums[1, leaves] = forest.linked
        sums[2, leaves] = [t.count(" ") + 1 for t in forest.texts]
        sums[3, leaves] = [len(_PUNCTUATION.findall(t)) for t in forest.texts]
        sums[4, leaves] = 1
        ends = np.zeros(n, np.int64)
        ends[leaves] = [1 + (t[-1] in ".!?…\"”»") + 2 * ("©" in t or "(c)" in t) for t in forest.texts]
        before = np.cumsum(sums[0]) - sums[0]
        for at in reversed(self.levels):
            for row in sums:
                np.add.at(row, self.parent[at], row[at])
        chars, linked, words, marks, blocks = sums
        page = np.searchsorted(self.roots, np.arange(n), "right") - 1
        total = np.maximum(chars[self.roots][page], 1) if n else chars
        is_leaf = np.zeros(n, np.int64)
        is_leaf[leaves] = 1
        safe = np.maximum(chars, 1)
        columns = [
            (self.kind, OTHER + 1),
            (np.where(is_leaf, self.kind[self.parent], OTHER + 1), OTHER + 2),
            (ends, 5),
        ]
        for values, edges in ((np.log2(chars + 1), range(1, 13)), (linked / safe, (0.001, 0.1, 0.3, 0.6, 0.9)), (marks / np.maximum(words, 1), (0.001, 0.05, 0.1, 0.2)), (chars / total, (0.01, 0.05, 0.2, 0.5, 0.8)), ((before - (before[self.roots][page] if n else 0)) / total, (0.02, 0.1, 0.5, 0.9, 0.98)), (blocks, (1, 2, 4, 8, 16)), (np.log2(chars / np.maximum(blocks, 1) + 1), range(2, 10))):
            bins = len(list(edges)) + 1
            columns.append((_bins(values, edges) + bins * is_leaf, 2 * bins))
        hints = np.array(forest.hints, np.int64)
        for i in range(len(HINTS)):
            columns.append((hints >> i & 1, 2))
        start = np.cumsum([0, *(size for _, size in columns)])
        #: One feature of each group holds for a node.
        self.features = np.stack([c + s for (c, _), s in zip(columns, start[:-1], strict=True)], axis=1) if n else np.empty((0, len(columns)), np.int64)
        self.width = int(start[-1])


@dataclass
class PageModel:
    node: np.ndarray  # weight of each feature for content
    child: np.ndarray  # kind of the child, label of the parent, label of the child
    parent: np.ndarray  # kind of the parent, the labels

    def beliefs(self, graph: Graph) -> tuple[np.ndarray, np.ndarray, float]:
        """Marginals of content, pair marginals of each node's edge to its parent, and the log of the partition sums.

        A root is never content.
        """
        n = len(graph.kind)
        up = np.zeros((n, 2))
        up[:, 1] = self.node[graph.features].sum(axis=1)
        up[graph.roots, 1] = -1e4
        edge = self.child[graph.kind] + self.parent[graph.kind[graph.parent]]
        message, down = np.zeros((n, 2)), np.zeros((n, 2))
        for at in reversed(graph.levels):
            message[at] = np.logaddexp(edge[at, :, 0] + up[at, None, 0], edge[at, :, 1] + up[at, None, 1])
            for y in (0, 1):
                np.add.at(up[:, y], graph.parent[at], message[at, y])
        pair = np.zeros((n, 2, 2))
        for at in graph.levels:
            above = graph.parent[at]
            outside = (up[above] + down[above] - message[at])[:, :, None] + edge[at]
            down[at] = np.logaddexp(outside[:, 0], outside[:, 1])
            joint = outside + up[at][:, None, :]
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pair[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
        whole = up + down
        p = 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -700, 700)))
        return p, pair, float(np.logaddexp(whole[graph.roots, 0], whole[graph.roots, 1]).sum())


def fit(graph: Graph, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> PageModel:
    """Maximum likelihood of the labels, penalised, by gradient steps with momentum and scale."""
    model = PageModel(np.zeros(graph.width), np.zeros((OTHER + 1, 2, 2)), np.zeros((OTHER + 1, 2, 2)))
    flat = np.setdiff1d(np.arange(len(graph.kind)), graph.roots)
    y, y_up = graph.label[flat], graph.label[graph.parent[flat]]
    kind, kind_up, features = graph.kind[flat], graph.kind[graph.parent[flat]], graph.features[flat]
    seen = np.zeros((len(flat), 2, 2))
    seen[np.arange(len(flat)), y_up, y] = 1
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (model.node, model.child, model.parent)]
    for step in range(1, steps + 1):
        p, pair, _ = model.beliefs(graph)
        off, off_pair = y - p[flat], seen - pair[flat]
        gradients = [np.bincount(features.ravel(), np.repeat(off, features.shape[1]), graph.width)]
        for k in (kind, kind_up):
            g = np.zeros((OTHER + 1, 2, 2))
            np.add.at(g, k, off_pair)
            gradients.append(g)
        for w, g, (m, v) in zip((model.node, model.child, model.parent), gradients, moments, strict=True):
            g = g / len(flat) - penalty * w / len(graph.roots)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / (1 + step / 50)
    return model


@functools.cache
def drawn_model() -> PageModel:
    """The model of SAMPLE_PAGES drawn pages, fitted once in a process."""
    return fit_page_model(drawn_pages(SAMPLE_PAGES))


def fit_page_model(pages: Iterable[str]) -> PageModel:
    """The model of labelled pages: elements marked ``data-main="1"`` (content) or ``"0"`` hold for all below them.

    At most SAMPLE_PAGES pages are used, the first ones.
    """
    forest = Forest()
    for html in itertools.islice(pages, SAMPLE_PAGES):
        forest.add(html)
    return fit(Graph(forest))


def main_texts(htmls: Iterable[str | None], model: PageModel) -> list[str]:
    """The main text of each page, blocks joined by line feeds."""
    out: list[str] = []
    forest, n = Forest(), 0

    def take() -> None:
        graph = Graph(forest)
        p = model.beliefs(graph)[0]
        found: list[list[str]] = [[] for _ in forest.roots]
        page = np.searchsorted(graph.roots, graph.leaves, "right") - 1
        for i, text, x in zip(page.tolist(), forest.texts, p[graph.leaves].tolist(), strict=True):
            if x >= 0.5:
                found[i].append(text)
        out.extend(map("\n".join, found))

    for html in htmls:
        forest.add(html or "")
        if len(forest.parent) >= NODES:
            take()
            forest = Forest()
    if forest.roots:
        take()
    return out


def extract_main_text(pages: DataFrame, model: PageModel, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` and ``main_text``, the page's article.

    Character references are decoded, white space within a block is one space, blocks are joined by line feeds in page
    order. A null or empty page and one without content have an empty text; long pages are read whole, and blocks that
    repeat are all kept. Repeated rows stay and get the same text. An input column ``main_text`` is replaced; an empty
    table stays empty.
    """
    small_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def extract(htmls: pa.Array) -> pa.Array:
        begin_task("pages")
        return pa.array(main_texts(htmls.to_pylist(), model), pa.string())

    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() != "main_text"]
    name = free_name(pages, "_main")
    return pages.withColumn(name, extract(F.col(f"`{html_col}`").cast("string"))).select(*own, F.col(name).alias("main_text"))


# Labelled pages


def drawn_pages(n: int, seed: int = 5) -> Iterator[str]:
    """Pages of many layouts, put together at random from parts whose labels are known."""
    rng = random.Random(seed)
    return (_Drawn(rng).page() for _ in range(n))


class _Drawn:
    """One page; parts draw their tags, class names and texts."""

    def __init__(self, rng: random.Random) -> None:
        self.r = rng
        self.plain = rng.random() < 0.25  # class names that tell nothing

    def words(self, n: int) -> str:
        r = self.r
        made = ["".join(r.choice(("ta", "re", "on", "the", "er", "in", "sa", "lo", "mi", "ná", "ung", "é", "qu")) for _ in range(r.randint(1, 4))) for _ in range(max(1, n))]
        return " ".join(made)

    def sentences(self, n: int) -> str:
        r = self.r
        if r.random() < 0.04:  # junk: one word again and again, or no sentence at all
            word = self.words(1) + self.pick("", ",", ".")
            return " ".join([word] * r.choice((20, 80, 300)) if r.random() < 0.6 else [self.words(r.choice((20, 80, 300)))])
        joint = r.choice((" ", " ", " ", " | ", ", ")) if r.random() < 0.2 else " "
        return " ".join(joint.join(self.words(r.randint(1, 14)).split()).capitalize() + r.choice((".", ".", ".", "!", "?", "")) for _ in range(n))

    def pick(self, *x: str) -> str:
        return self.r.choice(x)

    def maybe(self, p: float, part) -> str:  # noqa: ANN001
        return part() if self.r.random() < p else ""

    def wrap(self, kinds: str, inner: str, label: str = "") -> str:
        """``inner`` in an element of one of ``kinds`` (``tag`` or ``tag.class`` or ``tag#id``)."""
        tag, mark, name = re.match(r"(\w+)([.#]?)(.*)", self.pick(*kinds.split())).groups()
        if self.plain and tag in ("div", "section", "ul", "ol", "p"):
            mark, name = self.pick("", "."), self.pick("row", "col", "x1", "box", "inner", "wrapper")
        named = f' {"class" if mark == "." else "id"}="{name}{self.pick("", "", " clearfix", " col-8", " block")}"' if mark else ""
        return f"<{tag}{named}{label}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(self.r.randint(1, 3))}</a>{self.pick("</li>", "</li>", "")}' for i in range(n))

    def nav(self) -> str:
        inner = self.pick("<ul>", '<ul class="menu">', "<ol>") + self.links(self.r.randint(2, 9)) + "</ul>"
        return self.wrap("nav nav nav.main div.navbar div#nav div.menu div.breadcrumbs div#navigation", inner if self.r.random() < 0.8 else " | ".join(f'<a href="#">{self.words(1)}</a>' for _ in range(5)))

    def header(self) -> str:
        return self.wrap("header header div.header div#masthead div.topbar div#banner", self.maybe(0.7, lambda: self.wrap("div.logo p.logo h1 h2 a", self.words(2))) + self.maybe(0.5, lambda: self.wrap("p div.tagline", self.sentences(1))) + self.maybe(0.5, self.nav))

    def footer(self) -> str:
        return self.wrap("footer footer footer div.footer div#footer div#colophon p.copyright", self.pick("&copy; ", "&copy; 2020 ", "Copyright ", "") + self.words(2) + self.pick(" &middot; ", " | ", " ") + self.sentences(self.r.randint(0, 3)) + self.maybe(0.4, lambda: f"<ul>{self.links(3)}</ul>") + self.maybe(0.3, lambda: f"<p>{self.sentences(2)}</p>"))

    def ad(self) -> str:
        return self.wrap("div.ad div.ad div.ads div.advert aside.advertisement div.sponsored section.promo div#ad-top ins.adsbygoogle", self.maybe(0.3, lambda: "<p>Advertisement</p>") + self.pick("{}", "<p>{}</p>", '<a href="#">{}</a>').format(self.sentences(self.r.randint(1, 3))))

    def notice(self) -> str:
        return self.wrap("div.cookie-notice div#cookie-banner div.consent div.gdpr div.alert div.notice aside.notice div.popup dialog section.cookies div.disclaimer", self.pick("<p>{}</p>", "{}").format(self.sentences(self.r.randint(1, 4))) + self.maybe(0.5, lambda: "<button>OK</button>"))

    def form(self) -> str:
        return self.wrap("form form form.search form#login div.newsletter div.subscribe div.search-form", self.maybe(0.5, lambda: f"<h3>{self.words(3)}</h3>") + self.maybe(0.5, lambda: f"<p>{self.sentences(1)}</p>") + f'<label>{self.words(1)}</label><input name="q"><button>Go</button>')

    def side(self) -> str:
        block = lambda: self.wrap("div.widget section div div.related", self.maybe(0.8, lambda: f"<h3>{self.words(2)}</h3>") + (f"<ul>{self.links(self.r.randint(2, 7))}</ul>" if self.r.random() < 0.7 else f"<p>{self.sentences(self.r.randint(1, 3))}</p>"))
        return self.wrap("aside aside aside.sidebar div.sidebar div#sidebar div.right-rail div#secondary.widgets", "".join(block() for _ in range(self.r.randint(1, 4))) + self.maybe(0.3, self.ad))

    def comments(self) -> str:
        one = lambda: self.wrap("li.comment li.comment div.comment div.comment div.comment-body div.reply li li li div article.comment", self.maybe(0.5, lambda: self.wrap("p.author div.meta span h4 cite", self.words(2))) + "".join(f"<p>{self.sentences(self.r.randint(1, 5))}</p>" for _ in range(self.r.randint(1, 2))) + self.maybe(0.4, lambda: '<a href="#">Reply</a>'))
        inner = self.maybe(0.7, lambda: f"<h{self.r.randint(2, 4)}>{self.r.randint(1, 40)} {self.pick('comments', 'Comments', 'Kommentare', 'replies')}</h3>") + self.pick("{}", "{}", "<ol>{}</ol>", "<ul>{}</ul>").format("".join(one() for _ in range(self.r.randint(1, 6)))) + self.maybe(0.3, self.form)
        plain, self.plain = self.plain, False  # comments without any name can't be told from the article
        made = self.wrap("section.comments div.comments div#comments ol.commentlist div#disqus_thread section#comments section.comment-section div.replies div.discussion", inner, f' {MAIN_LABEL}="0"')
        self.plain = plain
        return made

    def share(self) -> str:
        return self.wrap("div.share div.social ul.share-buttons div.toolbar", self.links(self.r.randint(2, 5)))

    def inline(self, text: str) -> str:
        r, words = self.r, text.split(" ")
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(words))
            words[i] = self.pick("<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<strong>{}</strong>", "<b>{}", "{}<br>", "<code>{}</code>").format(words[i])
        return " ".join(words)

    def block(self) -> str:
        r, x = self.r, self.r.random()
        text = self.inline(self.sentences(r.choice((1, 1, 1, 2, 3, 5, 8, 12, 40))))
        if x < 0.72:
            return f"<p>{text}{self.pick('</p>', '</p>', '</p>', '')}" + self.maybe(0.05, lambda: "<p>" + self.words(1) + ".</p>")
        if x < 0.8:
            return f"<h{(h := r.randint(2, 4))}>{self.words(r.randint(1, 6))}</h{h}>"
        if x < 0.87:
            return self.pick("<ul>", "<ol>") + "".join(f"<li>{self.pick('{}', '<p>{}</p>').format(self.inline(self.sentences(1)))}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if x < 0.91:
            return self.pick("<blockquote>{}</blockquote>", "<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>").format(text)
        if x < 0.94:
            return f"<table>{''.join('<tr>' + ''.join(f'<td>{self.words(2)}</td>' for _ in range(3)) + '</tr>' for _ in range(3))}</table>"
        if x < 0.97:
            return f'<figure><img src="x.png"><figcaption>{self.sentences(1)}</figcaption></figure>'
        return f"<div>{text}</div>"

    def article(self) -> str:
        r = self.r
        main, other = f' {MAIN_LABEL}="1"', f' {MAIN_LABEL}="0"'
        off = lambda part: f"<div{other}>{part()}</div>" if r.random() < 0.2 else re.sub(r"^<(\w+)", rf"<\1{other}", part())
        as_divs = r.random() < 0.1
        blocks = [f"<div>{self.inline(self.sentences(r.randint(1, 5)))}</div>" if as_divs else self.block() for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20)))]
        if r.random() < 0.06:  # a line again and again
            blocks[r.randrange(len(blocks)) :] = [f"<p>{self.words(r.randint(1, 4))}.</p>"] * r.choice((20, 60, 120))
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            blocks.insert(r.randint(0, len(blocks)), off(r.choice((self.ad, self.ad, self.share, self.notice, self.form, self.side))))
        title = self.maybe(0.85, lambda: f"<h1>{self.sentences(1)}</h1>")
        inner = title + "".join(blocks)
        if r.random() < 0.2:
            inner = title + self.wrap("div.entry-content div.article-body div.text div#body section.body", "".join(blocks))
        if r.random() < 0.3:
            inner += off(r.choice((self.share, self.side, self.comments, self.form)))
        if r.random() < 0.1:  # blocks without an element of their own
            return re.sub(r"<(p|h\d|ul|ol|blockquote|pre|table|figure)>", rf"<\1{main}>", title + "".join(f"<p>{self.inline(self.sentences(r.randint(1, 6)))}</p>" for _ in range(r.randint(2, 9))))
        return self.wrap("article article article article article article.post main main div.article div.post div.content div#content section.story div.entry td div", inner, main)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.06:
            return self.article()
        if r.random() < 0.08:  # an article and nothing else
            blocks = "".join(f"<{t}>{self.sentences(r.randint(1, 6))}</{t}>" for t in r.choices(("p", "p", "div", "pre"), k=r.randint(1, 9)))
            return f'<body {MAIN_LABEL}="1">' + (self.sentences(r.randint(1, 9)) if r.random() < 0.3 else self.maybe(0.6, lambda: f"<h1>{self.words(r.randint(1, 6))}</h1>") + blocks)
        before = [self.maybe(0.5, self.header), self.maybe(0.7, self.nav), self.maybe(0.35, self.notice), self.maybe(0.5, self.ad), self.maybe(0.15, self.form)]
        r.shuffle(before)
        middle = [self.article(), self.maybe(0.3, self.side), self.maybe(0.45, self.comments)]
        if r.random() < 0.15:
            middle[:2] = reversed(middle[:2])
        inner = "".join(middle)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            inner = self.wrap("div.container div#main main div.row div.wrapper section div#page", inner)
        after = [self.maybe(0.2, self.ad), self.maybe(0.15, self.form), self.maybe(0.15, self.notice), self.maybe(0.8, self.footer)]
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><script>var x=1;</script></head><body>{''.join(before)}{inner}{''.join(after)}{self.pick('</body></html>', '')}"
