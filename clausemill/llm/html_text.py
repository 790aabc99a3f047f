"""Main text of web pages by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import small, texts

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "canvas", "xmp"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr picture source".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NEGATIVE_TAGS = set("nav header footer aside form button menu dialog fieldset head figure-ad".split())
_POSITIVE_TAGS = {"article", "main"}
_NEGATIVE_NAMES = set(
    """ad ads advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies disclaimer footer form gdpr header hidden login masthead menu menus modal nav navbar navigation
    newsletter notice notices alert pager pagination popup promo promoted promotion recommended related reply replies respond
    search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget widgets banner
    contentinfo complementary discussion disqus""".split()
)
_POSITIVE_NAMES = set("article articlebody content entry main post story text body".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2
OUTSIDE, CONTENT, BOILERPLATE = LABELS = (0, 1, 2)
#: Tags that are told apart (the last stands for all others) and those that a page without marks would write as div.
_TAGS = {t: i for i, t in enumerate("div article main nav header footer aside form section p h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre figure body head button menu dl dt dd".split())}
_MARKS = set("article main nav header footer aside form section button menu".split())
#: Tags that an article may give its text, whatever the pages at hand do.
_TEXT_TAGS = [_TAGS[t] for t in "p li h2 td blockquote pre h3 dd th div dt h4 figure ul table section".split()]
#: Names of classes, ids and roles fall into so many buckets.
NAMES = 512


class Page:
    """The block elements of a page as a tree, and its blocks of text in page order."""

    def __init__(self, source: str):
        self.parent, self.kind, self.tag, self.depth, self.names = [-1], [NEUTRAL], ["body"], [0], [()]
        self.hidden, self.children = [False], [0]
        self.chars, self.linked, self.stop = [0], [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        held: list[str] = []
        links = 0

        def close() -> None:
            text = " ".join("".join(held).split())
            held.clear()
            node = stack[-1][1]
            if text and not self.hidden[node]:
                self.blocks.append((node, text))
                self.chars[node] += len(text)
                self.stop[node] += text[-1] in ".!?:;\"'”»…"

        def put(raw: str) -> None:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                self.linked[stack[-1][1]] += len(text.strip())

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                put(source[at:])
                break
            if m.start() > at:
                put(source[at : m.start()])
            at = m.end()
            name, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
            if not name:
                continue
            if m[1] or m[4]:
                if name == "a":
                    links = max(0, links - 1)
                elif name == "br":
                    held.append(" ")
                elif name not in _INLINE:
                    close()
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            links = 0
                            break
                continue
            if name in _RAW:
                if not attributes.endswith("/") or name != "svg":
                    shut = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    at = shut.end() if shut else end
                continue
            if name == "br":
                held.append(" ")
                continue
            if name in _INLINE:
                links += name == "a"
                continue
            close()
            links = 0
            if name in _VOID:
                continue
            if name == "html":
                continue
            shuts = _CLOSES.get(name, {"p"})
            if stack[-1][0] == "p" or stack[-1][0] in shuts:
                stack.pop()
                if name in _CLOSES and stack[-1][0] in shuts:
                    stack.pop()
            if name == "body":
                stack = stack[:1]
            node = len(self.parent)
            self.parent.append(stack[-1][1])
            kind, names, hidden = described(name, attributes)
            up = stack[-1][1]
            self.kind.append(kind)
            self.tag.append(name)
            self.names.append(names)
            self.hidden.append(hidden or self.hidden[up])
            self.depth.append(self.depth[up] + 1)
            self.children.append(0)
            self.children[up] += 1
            self.chars.append(0)
            self.linked.append(0)
            self.stop.append(0)
            stack.append((name, node))
        close()

    def features(self, marks: bool = True) -> np.ndarray:
        """For each node its tag, what the word lists say of its names, and buckets of text length, share in links,
        ends of sentences, depth and children. Without marks, as the page would look if it had only div and p."""
        chars, linked, stop = np.array(self.chars), np.array(self.linked), np.array(self.stop)
        tag = [_TAGS.get("div" if not marks and t in _MARKS else t, len(_TAGS)) for t in self.tag]
        length = np.searchsorted([1, 25, 80, 250], chars, side="right")
        link = np.where(chars > 0, np.minimum(2, 3 * linked // np.maximum(chars, 1)), 0)
        return np.stack(
            [
                np.array(tag),
                np.array(self.kind) if marks else np.full(len(tag), NEUTRAL),
                length,
                link,
                np.minimum(stop, 2),
                np.minimum(np.array(self.depth), 7),
                np.searchsorted([1, 2, 5], np.array(self.children), side="right"),
            ],
            axis=1,
        )

    def rendered(self, labels: list[int], turn: int = 0) -> np.ndarray:
        """Features as the page would have them without marks, with the article's text put into one tag after the other,
        short and long, with and without ends of sentences: one template's tags are not all that articles have."""
        x = self.features(marks=False)
        at = np.flatnonzero((np.array(labels) == CONTENT) & (np.array(self.chars) > 0))
        nth = np.arange(len(at)) + turn
        x[at, 0] = np.array(_TEXT_TAGS)[nth % len(_TEXT_TAGS)]
        x[at, 2], x[at, 4] = 1 + nth % 4, nth % 3
        return x

    def seeds(self) -> list[int] | None:
        """Labels where the page marks its article: CONTENT inside it, BOILERPLATE in menus, forms and the like and all
        they hold, OUTSIDE elsewhere; None for a page that marks no article."""
        if POSITIVE not in self.kind:
            return None
        out = [OUTSIDE] * len(self.parent)
        for i in range(1, len(out)):
            up, kind = out[self.parent[i]], self.kind[i]
            out[i] = BOILERPLATE if up == BOILERPLATE or kind == NEGATIVE else CONTENT if kind == POSITIVE else up
        return out


def described(name: str, attributes: str) -> tuple[int, tuple[int, ...], bool]:
    """What the word lists say of an element, the buckets of its names, and whether it is not shown."""
    kind = NEGATIVE if name in _NEGATIVE_TAGS else POSITIVE if name in _POSITIVE_TAGS else NEUTRAL
    names: set[str] = set()
    if attributes.strip():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return kind, (), True
            if key in ("class", "id", "role", "itemprop"):
                names.update(re.findall(r"[a-z]+", value))
        if names & _NEGATIVE_NAMES:
            kind = NEGATIVE
        elif names & _POSITIVE_NAMES and kind == NEUTRAL and name != "body":
            kind = POSITIVE
    return kind, tuple(sorted(zlib.crc32(x.encode()) % NAMES for x in names)), False


#: Features of a node and their sizes, in the order of Page.features.
_FEATURES = (("tag", len(_TAGS) + 1), ("list", 3), ("length", 5), ("link", 3), ("stop", 3), ("depth", 8), ("children", 4))
#: Counts held before any page is seen: some label follows its parent's, and names on the word lists say what they mean.
_PRIOR = {("edge", up, up): 4.0 for up in LABELS} | {("list", BOILERPLATE, NEGATIVE): 8.0, ("list", CONTENT, POSITIVE): 8.0}
#: The same by what the lists say of the child, on pages that mark their article.
_PRIOR |= {(f"edge{NEUTRAL}", up, up): 8.0 for up in LABELS} | {(f"edge{NEGATIVE}", up, BOILERPLATE): 8.0 for up in LABELS}
_PRIOR |= {(f"edge{POSITIVE}", OUTSIDE, CONTENT): 8.0, (f"edge{POSITIVE}", CONTENT, CONTENT): 8.0, (f"edge{POSITIVE}", BOILERPLATE, BOILERPLATE): 8.0}
_ROOT = [0.98, 0.01, 0.01]


def tally(pages: Iterator[Page]) -> Counter:
    """Counts of features and names by label, and of labels by the parent's label, over pages that mark their article.

    Every page counts three times: as it is; without marks, so that text, links, depth and the order of things say where
    the article is when tags and names do not; and with its article rendered in other tags. Labels by the parent's are also
    counted by what the word lists say of the child.
    """
    out: Counter[tuple] = Counter()
    for page in pages:
        y = page.seeds()
        if y is None:
            continue
        for x in (page.features(), page.features(marks=False), page.rendered(y, len(page.blocks))):
            for f, (name, _) in enumerate(_FEATURES):
                for (a, b), n in Counter(zip(y, x[:, f].tolist())).items():
                    out[name, a, b] += n
        for i in range(1, len(y)):
            out["edge", y[page.parent[i]], y[i]] += 2
            out[f"edge{page.kind[i]}", y[page.parent[i]], y[i]] += 1
            for b in page.names[i]:
                out["name", y[i], b] += 1
    return out


class TreeModel:
    """Potentials of nodes given their label, and of a node's label given its parent's, from counts.

    On a page that marks its article the latter also depend on what the word lists say of the node: there labels hardly
    ever change without a mark, so what lies in an article is its text, whatever its tag, unless a mark says otherwise.
    Nodes of a page are no independent witnesses (a list has many items), so there each counts as its share of the page.
    """

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        got = lambda name, a, b, more: counts.get((name, a, b), 0) + _PRIOR.get((name, a, b), 0) + more
        table = lambda name, columns, more: (t := np.array([[got(name, a, b, more) for b in range(columns)] for a in LABELS])) / t.sum(axis=1, keepdims=True)
        self.node = [np.log(table(name, size, 1.0)) for name, size in _FEATURES]
        self.name = np.log(table("name", NAMES, 0.1))
        self.edge = table("edge", 3, 0.05).tolist()
        self.by_kind = [table(f"edge{kind}", 3, 1e-6).tolist() for kind in (NEGATIVE, NEUTRAL, POSITIVE)]

    def local(self, page: Page, marks: bool = True) -> np.ndarray:
        x = page.features(marks)
        out = sum(t[:, x[:, f]] for f, t in enumerate(self.node)).T
        if marks:
            for i, names in enumerate(page.names):
                for b in names:
                    out[i] += self.name[:, b]
        return out

    def marginals(self, page: Page, marks: bool = True) -> list[float]:
        """P(CONTENT) of each node: messages go up from the leaves, then down from the root."""
        local = self.local(page, marks)
        if marks and POSITIVE in page.kind:
            local /= len(page.parent)
        local = np.exp(np.maximum(local - local.max(axis=1, keepdims=True), -60)).tolist()
        n, parent = len(page.parent), page.parent
        edges = [self.by_kind[kind] for kind in page.kind] if marks and POSITIVE in page.kind else [self.edge] * n
        up = [list(v) for v in local]
        message: list[list[float]] = [[1.0, 1.0, 1.0]] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            u, at, e = up[i], up[parent[i]], edges[i]
            m = [r[0] * u[0] + r[1] * u[1] + r[2] * u[2] for r in e]
            s = m[0] + m[1] + m[2]
            message[i] = m = [v / s for v in m]
            got = [max(1e-60, at[0] * m[0]), max(1e-60, at[1] * m[1]), max(1e-60, at[2] * m[2])]
            s = got[0] + got[1] + got[2]
            at[:] = [v / s for v in got]
        down: list[list[float]] = [_ROOT] * n
        out = []
        for i in range(n):
            if i:
                p, m, e = parent[i], message[i], edges[i]
                d = [down[p][j] * up[p][j] / m[j] for j in LABELS]
                s = d[0] + d[1] + d[2]
                down[i] = [(d[0] * e[0][j] + d[1] * e[1][j] + d[2] * e[2][j]) / s for j in LABELS]
            both = [down[i][j] * up[i][j] for j in LABELS]
            out.append(both[CONTENT] / sum(both))
        return out


def main_text(page: Page, model: TreeModel) -> str:
    p = model.marginals(page)
    return "\n".join(text for node, text in page.blocks if p[node] >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text.

    Every page is read twice. First, pages that mark their article (article, main or a telling class) serve as
    labelled ones: tasks count features and names of nodes and pairs of labels, with and without the marks, and Spark
    sums the counts, a table of fixed size. Then the marginals of each page's nodes choose its blocks: white space
    becomes one space, blocks are joined by a line feed, nothing else is dropped or cut. Elements that are not shown
    (hidden, display: none) are left out.

    A null html is empty; an empty page has an empty text. Unclosed and stray tags, truncated pages and very long ones
    are read as they come. Rows that repeat a page_id are read each. Without labelled pages the built-in counts decide.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter[tuple] = Counter()
        for batch in small(batches):
            got += tally(Page(x.decode("utf-8", "replace")) for x in texts(batch, "html"))
        name, a, b = zip(*got) if got else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(got.values()), pa.int64())], ["name", "a", "b", "n"])

    counted = rows.select("html").mapInArrow(count, "name string, a int, b int, n long").groupBy("name", "a", "b").agg(F.sum("n").alias("n"))
    model = pages.sparkSession.sparkContext.broadcast(TreeModel({(r["name"], r["a"], r["b"]): r["n"] for r in counted.collect()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = [main_text(Page(x.decode("utf-8", "replace")), model.value) for x in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string())], ["page_id", "url", "text"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
