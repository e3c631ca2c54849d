"""Main text of web pages by composite text density.

A page becomes a DOM whose nodes carry, over their whole subtree, the characters,
tags, characters inside links and link tags. The composite density of a node is
its characters per tag times a logarithm that falls with the share of links, and
the base of that logarithm grows with the page's own share of links. The subtree
whose children's densities have the largest sum holds the main text. The least
density on its path to the body is the threshold: other subtrees that hang off
that path and reach the threshold belong to the text as well.

Elements that can't be an article's text by what they are (scripts, menus, page
headers and footers, sidebars, forms, notices, adverts, reader comments: by tag,
role, or words of class and id) take no part. If the chosen subtree lies in an
``article`` or ``main`` element, all of that element is taken. Headings that hang
off the path are kept, as they title the text, and so are sections beside a chosen
section, unless they are mostly links.

Every page is one row of one task, read once from left to right, with flat arrays
instead of recursion, so Spark's scan is all the distribution there is to do.
Nesting beyond 512 levels is flattened, as browsers do; no text is lost by it.

Defined cases: null or empty html has empty text; html without markup is one
block; text directly in an element on the path is kept, in the body only from the
threshold up; a tag that never ends is dropped with all that it swallows; a cut-off
character reference stays as written; white space is what Unicode calls so; ``br``
is white space; repeated rows and null ids or addresses are rows like any other;
extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shuffle import bounded_batches, tidy

MAX_DEPTH = 512

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag ends these open elements, up to the nearest of the bounds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "caption"), ("table",)),
    "option": (("option",), ("select", "optgroup", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
}
WALLS = frozenset("table td th caption template object".split())

# Elements, roles and name words that are not main text.
DROPPED = frozenset(
    "head script style title noscript template nav footer aside form button select input textarea iframe object embed canvas "
    "audio video svg math menu dialog noembed noframes xmp datalist map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adslot adbox sponsor sponsored sponsors promo promos promotion "
    "banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login popup modal overlay paywall "
    "sidebar sidebars menu menus navbar nav navigation breadcrumb breadcrumbs pagination pager footer share sharing social related "
    "recommended recommendations widget widgets toolbar masthead skip".split())
COMMENT_WORDS = frozenset("comment comments commentlist commenters disqus replies respond discussion".split())
HEADER_WORDS = frozenset("header topbar".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*\"[^\"]*+(?:\"|\Z)|=\s*'[^']*+(?:'|\Z)|=|[\"'])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Why a node takes no part: not at all, by its tag, by a word, as reader comments.
_NO, _BY_TAG, _BY_WORD, _COMMENTS = range(4)


def _noise(tag: str, attributes: str) -> int:
    if tag in DROPPED:
        return _BY_TAG
    if not attributes or tag in ("html", "body"):
        return _NO
    a = {k.lower(): references.unescape(x or y or z) for k, x, y, z in _ATTRIBUTE.findall(attributes)}
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(a.get(k, ""))}
    if words & COMMENT_WORDS:
        return _COMMENTS
    if tag in ("article", "main") or tag in HEADINGS:
        return _NO
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return _BY_TAG
    if a.get("role", "").lower() in ROLES or words & NOISE_WORDS or (words & HEADER_WORDS and tag != "header"):
        return _BY_WORD
    return _NO


class Page:
    """Nodes of one page in document order, and its runs of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise = ["body"], [-1], [_NO]
        self.runs: list[tuple[int, str]] = []      # (node, text); text None: a block starts or ends
        self._stack, self._open = [0], {"body": 1}
        self._read(source)

    # ------------------------------------------------------------ tree

    def _push(self, tag: str, attributes: str) -> None:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self._stack[-1])
        self.noise.append(_noise(tag, attributes))
        if tag not in VOID and len(self._stack) < MAX_DEPTH:
            self._stack.append(node)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _pop_to(self, place: int) -> None:
        for node in self._stack[place:]:
            self._open[self.tag[node]] -= 1
        del self._stack[place:]

    def _find(self, tags: tuple, walls, inline: bool = False) -> int:
        """Place on the stack of the nearest open element of ``tags``; 0 if a wall
        (or, for an inline element, a block) lies before it."""
        if not any(self._open.get(t) for t in tags):
            return 0
        for place in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[place]]
            if tag in tags:
                return place
            if tag in walls or (inline and tag in BLOCK):
                return 0
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in CLOSES_P and (place := self._find(("p",), WALLS)):
            self._pop_to(place)
        if tag in HEADINGS and self.tag[self._stack[-1]] in HEADINGS:
            self._pop_to(len(self._stack) - 1)
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            while place := self._find(ended, bounds):
                self._pop_to(place)
        if tag == "a" and (place := self._find(("a",), WALLS, True)):
            self._pop_to(place)
        self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        tags = tuple(HEADINGS) if tag in HEADINGS else (tag,)
        if place := self._find(tags, () if tag in WALLS else WALLS, tag not in BLOCK):
            self._pop_to(place)

    def _read(self, source: str) -> None:
        at = 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self.runs.append((self._stack[-1], source[at:m.start()]))
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            tag = name.lower()
            if not m.group(4):
                break                              # the page ends inside this tag
            if tag in BLOCK:
                self.runs.append((self._stack[-1], None))
            elif tag == "br":
                self.runs.append((self._stack[-1], " "))
            if m.group(1):
                self._end(tag)
                continue
            self._start(tag, m.group(3))
            if tag in RAW:                         # its content is not markup
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                if close is None:
                    at = len(source)
                    break
                self.runs.append((len(self.tag) - 1, source[at:close.start()]))
                at = close.start()
        else:
            if at < len(source):
                self.runs.append((self._stack[-1], source[at:]))

    # ------------------------------------------------------------ densities

    def _inherited(self, own) -> list:
        """Per node: does ``own`` hold for it or for an element around it."""
        out = []
        for node, p in enumerate(self.parent):
            out.append(own(node) or (p >= 0 and out[p]))
        return out

    def _silence(self) -> list[bool]:
        """Nodes that take no part, with all below them."""
        tag, parent, noise = self.tag, self.parent, self.noise
        article = self._inherited(lambda i: tag[i] in ("article", "main") and noise[i] == _NO)
        titled = [False] * len(tag)                # holds a heading
        wraps = [False] * len(tag)                 # holds the page's main element or first heading
        holds = [False] * len(tag)                 # holds an article or main element
        for i in range(len(tag) - 1, 0, -1):
            p = parent[i]
            titled[p] |= titled[i] or tag[i] in HEADINGS
            wraps[p] |= wraps[i] or tag[i] in ("main", "h1")
            holds[p] |= holds[i] or (tag[i] in ("article", "main") and noise[i] == _NO)

        def quiet(i: int) -> bool:
            if tag[i] == "header":
                return not (holds[i] or (article[i] and titled[i]))
            if tag[i] == "form":
                return not (holds[i] or wraps[i])
            if noise[i] == _BY_WORD:               # the word names the layout of a wrapper
                return not wraps[i]
            return noise[i] != _NO

        return self._inherited(quiet)

    def main_text(self) -> str:
        tag, parent = self.tag, self.parent
        n = len(tag)
        silent = self._silence()
        linked = self._inherited(lambda i: tag[i] == "a")
        hidden = self._inherited(lambda i: tag[i] in ("head", "script", "style", "title", "noscript", "template"))
        own, chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        page_chars = page_links = 0
        texts = []
        for node, raw in self.runs:
            text = None if raw is None else references.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if text and not hidden[node]:
                size = len("".join(text.split()))
                page_chars += size
                page_links += size if linked[node] else 0
                if not silent[node]:
                    own[node] += size
                    chars[node] += size
                    link_chars[node] += size if linked[node] else 0
        for i in range(n - 1, 0, -1):
            if silent[i]:
                continue
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
        share = page_links / page_chars if page_chars else 0.0

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            plain = c / (t or 1)
            spread = c / ((c - lc) or 1) * lc + share * c
            if not spread:                         # a page without links
                return plain
            return plain * math.log(c / (lc or 1) * (t or 1) / (lt or 1)) / math.log(math.log(spread + math.e) + 1)

        dense, total, below = [0.0] * n, [0.0] * n, [False] * n
        for i in range(n - 1, -1, -1):
            if silent[i]:
                continue
            lt = link_tags[i] + (tag[i] == "a")
            dense[i] = density(chars[i], tags[i] + 1, link_chars[i], lt)
            if own[i]:                             # its own text counts as a child
                total[i] += density(own[i], 1, own[i] if linked[i] else 0, int(linked[i]))
            if i:
                total[parent[i]] += dense[i]
        best = max((i for i in range(n) if not silent[i] and (tag[i] in BLOCK or not i)), key=lambda i: (total[i], -i))
        path, i = [], best
        while i >= 0:
            path.append(i)
            i = parent[i]
        threshold = min(dense[i] for i in path[:-1] or path)
        whole = [i for i in path if tag[i] in ("article", "main")]
        top = whole[-1] if whole else best
        on_path = set(path[path.index(top) + 1:])
        parts = {(parent[i], tag[i]) for i in path if tag[i] == "section"}

        taken = [False] * n                        # all of the node is text
        for i in range(n):
            if silent[i]:
                continue
            p = parent[i]
            taken[i] = (i == top or (p >= 0 and taken[p])
                        or (p in on_path and i not in on_path and chars[i] > 0
                            and (dense[i] >= threshold or ((tag[i] in HEADINGS or (p, tag[i]) in parts) and 2 * link_chars[i] < chars[i]))))
        blocks, held = [], []
        for (node, _), text in zip(self.runs, texts):
            if text is None:
                blocks.append("".join(held))
                held = []
            elif taken[node] or (node in on_path and not silent[node] and (node or text.isspace() or own[0] >= threshold)):
                held.append(text)
        blocks.append("".join(held))
        return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(source: str | None) -> str:
    """Main text of one page."""
    return Page(source).main_text() if source else ""


def main_texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(source.as_py()) for source in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(tidy(task), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))
