"""The main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into text blocks where block-level markup begins or ends. A block is described by its words, its link
density, those of its two neighbours, and by what the markup around it is called. A decision tree, trained on a small
labelled table that ``labelled`` makes by rule, tells main text from the rest; the blocks it keeps are joined in page
order.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.common import batches as by_bytes

# Elements of HTML by how they bear on text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no markup, and no text of the page either.
RAW = frozenset("iframe script style textarea title xmp noembed noframes".split())
#: Text in these is for use, not for reading.
UNREAD = frozenset("audio button canvas datalist noscript object option select svg template video".split())
#: An opening tag ends the open element of these, unless one of the second lies between.
ENDS = {
    **dict.fromkeys(BLOCKS, (("p",), ("button", "table"))), "li": (("li",), ("ol", "ul", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
}

# What authors call the parts of a page, as the starts of words, or as whole words.
ASIDE = re.compile(r"(?:comment|disqus|respond|repl(?:y|ies)|discuss|sidebar|side$|aside|related|recommend|teaser|widget|footer|foot$|contentinfo|complementary)")
FRAME = re.compile(
    r"(?:advert|sponsor|promo|navig|breadcrumb|crumbs?$|pagin|pager|menu|masthead|banner|cookie|consent|gdpr|privacy|newsletter|subscri|signup|sign$|login|share|sharing|social|popup|modal|overlay"
    r"|toolbar|topbar|copyright|legal|ads?$|nav(?:bar|list)?$|notices?$|alerts?$|forms?$|search|skip|tags?$|hidden|tools?$)"
)
GOOD = re.compile(r"(?:article|content|entry|main|post|story|text|prose|body)")
#: After one of these words, a name says what a page has elsewhere.
ELSEWHERE = frozenset(("has", "no", "with", "without"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>|</[^>]*>", re.DOTALL)
_NAMED = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_STOPS = (".", "!", "?", "…", "。", ":", '."', ".”", ".»")

#: Where a block stands: in what stands beside the article, in a frame of the page, in nothing named though the page
#: names its article, in nothing named of a page without such, in the article.
BESIDE, FRAMED, OUTSIDE, NOWHERE, ARTICLE = range(5)

#: The description of a block.
FEATURES = ("where", "words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "sentence")

_NAMES: dict[tuple[str, str], tuple[int, bool]] = {}


def _named(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element's tag and attributes say it is, and whether that is the article beyond doubt."""
    known = _NAMES.get((tag, attributes))
    if known:
        return known
    words, sure = [], tag in ("article", "main")
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("style", "hidden", "aria-hidden"):
            words += ["hidden"] * (name == "hidden" or (name == "aria-hidden" and value == "true") or "display:none" in value.replace(" ", "").lower())
        else:
            sure |= (name == "role" and value == "main") or value == "articleBody"
            for one in value.split():
                parts = [p.lower() for p in _PARTS.findall(one)]
                words += [p for i, p in enumerate(parts) if not ELSEWHERE.intersection(parts[:i])]
    if tag in ("aside", "footer") or any(map(ASIDE.match, words)):
        out = BESIDE, False
    elif tag in ("nav", "form", "menu", "header", "dialog") or any(map(FRAME.match, words)) or "header" in words:
        out = FRAMED, False
    else:
        out = (ARTICLE if sure or any(map(GOOD.match, words)) else NOWHERE), sure
    if len(_NAMES) < 10_000:
        _NAMES[tag, attributes] = out
    return out


def _inside(where: int, tag: str, attributes: str) -> int:
    """Where the text of an element stands that is itself ``where``."""
    if tag in ("body", "html", "a", "b", "i", "em", "strong", "span") and not (tag == "span" and attributes):
        return where
    named, sure = _named(tag, attributes)
    if where == ARTICLE and (tag in ("header", "h1", "h2", "h3", "h4", "h5", "h6") or (named == FRAMED and "header" in attributes and tag == "div")):
        return where
    if named == ARTICLE and where in (FRAMED, BESIDE):
        return ARTICLE if tag == "main" or (sure and where == FRAMED) else where
    if named == FRAMED and where == BESIDE:
        return where
    return where if named == NOWHERE else named


def blocks(page: str) -> list[tuple[str, int, float, int, bool, bool]]:
    """The text blocks of a page in order: text, words, link density, where it stands, whether it is a heading, and a list item.

    Character references are decoded; white space inside a block becomes one space. Comments, scripts, styles and
    controls are left out; markup that the page's end cuts off is none.
    """
    found: list[tuple[str, int, float, int, bool, bool]] = []
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    text: list[str] = []
    linked: list[str] = []
    where, unread, seen_where = NOWHERE, 0, NOWHERE

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = references.unescape("".join(text)).split()
            if words:
                chars = sum(map(len, words))
                links = sum(map(len, references.unescape(" ".join(linked)).split()))
                tag = next((t for t, _ in reversed(stack) if t in BLOCKS), "")
                found.append((" ".join(words), len(words), min(1.0, links / chars), seen_where, tag[:1] == "h" and tag[1:].isdigit(), held.get("li", 0) > 0))
            text, linked = [], []

    def say(part: str) -> None:
        nonlocal seen_where
        if part and not unread:
            if not text or part.strip():
                seen_where = where
            text.append(part)
            if held.get("a"):
                linked.append(part)

    def pop() -> None:
        nonlocal where, unread
        tag, where = stack.pop()
        held[tag] -= 1
        unread -= tag in UNREAD

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        if m[1] or m[4]:
            if held.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            say(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        names, walls = ENDS.get(tag, ((), ()))
        if any(map(held.get, names)) or (tag in BLOCKS and held.get("p")):
            if tag in BLOCKS and tag not in ("p", "li", "td", "th", "tr", "dd", "dt"):
                names, walls = ("p",), ("button", "table")
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in walls:
                    break
                if stack[depth][0] in names:
                    while len(stack) > depth:
                        pop()
                    break
        attributes = m[3] or m[6] or ""
        if tag == "a" and held.get("a"):  # links don't nest
            held["a"] -= 1
            stack[max(i for i, x in enumerate(stack) if x[0] == "a")] = ("", where)
            held[""] = held.get("", 0) + 1
        stack.append((tag, where))
        held[tag] = held.get(tag, 0) + 1
        unread += tag in UNREAD
        if attributes or tag in BLOCKS or tag in ("main", "dialog"):
            where = _inside(where, tag, attributes)
    say(_CUT.sub("", page[at:]))
    flush()
    return found


def features(page: list[tuple[str, int, float, int, bool, bool]]) -> np.ndarray:
    """A row of ``FEATURES`` for each block of one page; before the first and after the last stands a block without words."""
    out = np.zeros((len(page), len(FEATURES)), np.float32)
    if page:
        words, links = np.array([b[1] for b in page], np.float32), np.array([b[2] for b in page], np.float32)
        where = np.array([b[3] for b in page])
        if (where == ARTICLE).any():
            where[where == NOWHERE] = OUTSIDE
        out[:, 0], out[:, 1], out[:, 2] = where, words, links
        out[1:, 3], out[1:, 4], out[:-1, 5], out[:-1, 6] = words[:-1], links[:-1], words[1:], links[1:]
        out[:, 7], out[:, 8] = [b[4] for b in page], [b[5] for b in page]
        out[:, 9] = [b[0].endswith(_STOPS) for b in page]
    return out


class Tree:
    """A binary decision tree by Gini impurity, as arrays: a node's feature (-1: leaf), threshold, children and verdict."""

    def __init__(self, depth: int = 8, least: int = 4):
        self.depth, self.least = depth, least
        self.nodes: list[list] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y.astype(bool), 0)
        self.feature, self.threshold, self.low, self.high, self.verdict = (np.array(c) for c in zip(*self.nodes))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append([-1, 0.0, 0, 0, bool(y.mean() > 0.5)])
        split = self._split(x, y) if depth < self.depth and 0 < y.sum() < len(y) else None
        if split:
            k, at = split
            low = x[:, k] <= at
            self.nodes[me][:4] = [k, at, self._grow(x[low], y[low], depth + 1), self._grow(x[~low], y[~low], depth + 1)]
        return me

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        """The feature and threshold of the purest halves; the first of equal ones."""
        n, best, found = len(y), 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, t = x[order, k], np.cumsum(y[order])
            left = np.arange(1, n)
            ones, rest = t[:-1], t[-1] - t[:-1]
            cost = 2 * ones * (left - ones) / left + 2 * rest * (n - left - rest) / (n - left)
            cost[(v[1:] == v[:-1]) | (left < self.least) | (n - left < self.least)] = np.inf
            if len(cost) and cost.min() < best:
                i = int(cost.argmin())
                best, found = cost[i], (k, float((v[i] + v[i + 1]) / 2))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            k = self.feature[at]
            low = x[np.arange(len(x)), np.maximum(k, 0)] <= self.threshold[at]
            at = np.where(k < 0, at, np.where(low, self.low[at], self.high[at]))
        return self.verdict[at]


#: Pages of the labelled table, and the seed of their making.
LABELLED_PAGES, SEED = 300, 11


def labelled(n: int = LABELLED_PAGES, seed: int = SEED) -> Iterator[tuple[str, list[bool]]]:
    """Pages and, for each text block in order, whether it is main text.

    Layouts are mixed by rule: parts named by elements, by classes or not at all; articles of one to many paragraphs
    with headings, lists, quotes, tables and advertisements between; menus, notices, forms, comments around them.
    """
    r = random.Random(seed)

    def words(low: int, high: int, stop: str = ".") -> str:
        return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(low, high))) + stop

    link = lambda: f'<a href="/{r.randrange(999)}">{words(1, 4, "")}</a>'
    prose = lambda: words(*r.choice(((1, 6), (5, 25), (20, 60), (40, 150))), r.choice((".", ".", "?", "")))

    for i in range(n):
        out: list[str] = []
        labels: list[bool] = []

        def put(label: bool, *parts: str, out=out, labels=labels) -> None:
            out.extend(parts)
            labels.append(label)

        def wrap(kind: tuple[str, str], body: Callable[[], None], out=out) -> None:
            out.append(f"<{kind[0]}{kind[1]}>")
            body()
            out.append(f"</{kind[0]}>")

        style = i % 4  # by elements, by classes, by classes but for the article, not at all
        plain = style > 1

        def call(tag: str, name: str, style=style) -> tuple[str, str]:
            if style == 0:
                return tag, ""
            return "div", "" if style == 3 or (style == 2 and tag == "article") else f' {r.choice(("class", "id"))}="{name}"'

        def menu() -> None:
            if r.random() < 0.7:
                for _ in range(r.randrange(2, 9)):
                    put(False, "<li>", link(), "</li>")
            else:
                put(False, "<div>", " | ".join(link() for _ in range(r.randrange(2, 9))), "</div>")

        def article(plain=plain) -> None:
            if plain or r.random() < 0.6:
                put(True, "<h1>", words(2, 12, ""), "</h1>")
            if plain:
                put(True, "<p>", words(25, 90), "</p>")
            for _ in range(r.choice((1, 2, 4, 8, 14))):
                kind = r.random()
                if kind < 0.7:
                    put(True, "<p>", words(12, 90) if plain else prose(), f" {link()} {words(2, 9)}" if r.random() < 0.2 else "", "</p>")
                elif kind < 0.78:
                    put(True, "<h2>", words(1, 7, ""), "</h2>")
                    put(True, "<p>", words(20, 80), "</p>")
                elif kind < 0.84 and not plain:
                    for _ in range(r.randrange(2, 5)):
                        put(True, "<li>", words(1, 20, r.choice((".", ""))), "</li>")
                elif kind < 0.88:
                    put(True, "<blockquote>", words(10, 40), "</blockquote>")
                elif kind < 0.92 and not plain:
                    put(True, "<li>", link(), "</li>")
                elif kind < 0.96 and not plain:
                    for _ in range(3):
                        put(True, "<td>", words(1, 4, ""), "</td>")
                elif not plain:
                    put(False, f'<div class="{r.choice(("ad", "advert", "promo", "share", "related"))}">', words(2, 20, ""), "</div>")
            if plain:
                put(True, "<p>", words(15, 60), "</p>")
            elif r.random() < 0.5:
                put(True, "<li>", words(1, 9, ""), "</li>")

        def comments(style=style) -> None:
            put(False, "<h3>", words(1, 3, ""), "</h3>")
            for _ in range(r.randrange(1, 5)):
                put(False, '<div class="comment">' if style else '<article class="comment"><div class="content">', words(2, 60), "</div>" if style else "</div></article>")

        def side() -> None:
            put(False, "<h3>", words(1, 4, ""), "</h3>")
            put(False, "<p>", words(4, 50), "</p>")
            menu()

        bare = r.random() < 0.3  # nothing before
        if not bare:
            wrap(call("nav", "menu"), menu)
        if not bare and r.random() < 0.5:
            put(False, '<div class="ad">' if style < 3 else "<div>", words(2, 8, "") if plain else words(2, 14), "</div>")
        if not bare and r.random() < 0.4 and style < 3:
            wrap(call("header", "header"), lambda: (put(False, "<h2>", words(1, 4, ""), "</h2>"), put(False, "<p>", words(3, 9), "</p>")))
        if not bare and r.random() < 0.5 and style < 2:
            put(False, "<div>" if r.random() < 0.5 else '<div class="cookie-notice">', words(5, 40), "</div>")
        first, last = not bare and r.random() < 0.3, r.random() < 0.3  # a sidebar before, nothing after
        if first and style < 3:
            wrap(call("aside", "sidebar"), side)
        wrap(call("article", r.choice(("content", "post", "entry-content", "main", "article-body"))), article)
        if last:
            yield "<!DOCTYPE html><html><body>" + "".join(out), labels
            continue
        if style < 3 and r.random() < 0.4:
            wrap(("section", ' class="comments"'), comments)
        if not first and style < 3 and r.random() < 0.4:
            wrap(call("aside", "sidebar"), side)
        if r.random() < 0.2:
            wrap(("form", ""), lambda: put(False, "<label>", words(1, 5, ""), '</label><input name="q"><button>Go</button>'))
        if r.random() < 0.6:
            wrap(call("footer", "footer"), lambda style=style: put(False, "<p>", words(2, 6, "") if style == 3 else "&copy; " + words(2, 30), "</p>"))
        yield "<!DOCTYPE html><html><body>" + "".join(out) + "</body></html>", labels


def trained(n: int = LABELLED_PAGES, seed: int = SEED) -> Tree:
    """The tree of the labelled table, the same each time."""
    pages = [(features(blocks(page)), np.array(labels)) for page, labels in labelled(n, seed)]
    return Tree().fit(np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages]))


#: Characters of pages whose blocks a task holds at once, about; a longer page stands alone.
AT_ONCE = 8 << 20

COLUMNS = "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long"


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url``, the main ``text`` of each row's ``html``, its code points, and the blocks found and kept.

    A null or empty page, or one without main text, gives an empty text. Repeated rows are pages each; an empty table
    gives none; other columns may have any name. Whole pages are read, of any length. No row is shuffled.
    """
    tree = trained()
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in COLUMNS.split(", ")])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, sources = batch.column("page_id"), batch.column("url"), batch.column("html").to_pylist()
            for start, stop in by_bytes(sources, AT_ONCE):
                found = [blocks(x) if x else [] for x in sources[start:stop]]
                keep = tree.predict(np.concatenate([features(x) for x in found]))
                texts, kept, at = [], [], 0
                for page in found:
                    good = [b[0] for b, k in zip(page, keep[at : at + len(page)]) if k]
                    at += len(page)
                    texts.append("\n".join(good))
                    kept.append(len(good))
                n = stop - start
                yield pa.record_batch([ids.slice(start, n), urls.slice(start, n), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(kept, pa.int64())], schema=schema)

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return own.mapInArrow(extracted, COLUMNS)
