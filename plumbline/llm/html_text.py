"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at block elements. A block's features are its words and
link density, those of the blocks before and after it, what it stands in, and how the element
around it is named and filled. A decision tree tells main text from the rest; it is grown
from the labelled blocks below.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|template)(?![\w:-])[^>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<more>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>"
    r"|<(?P<loose_end>/?)(?P<loose>[a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
RAW_STARTS = {x: re.compile(rf"<{x}(?![\w:-])", re.I) for x in ("script", "style", "textarea", "title", "template")}
RAW_ENDS = {x: re.compile(rf"</{x}\s*+>", re.I) for x in RAW_STARTS}
HEAD_END = re.compile(r"</head\s*+>", re.I)
BODY = re.compile(r"<body(?![\w:-])", re.I)
#: Left out with what they hold if they are closed, else the tag alone.
SKIPPED = frozenset("noscript svg select iframe object canvas button".split())
CLASSES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
HOLDERS = frozenset(
    "address article aside blockquote body center details div dl fieldset figure footer form "
    "header html main menu nav ol section table td th ul li".split()
)
FURNITURE = frozenset("aside fieldset footer form menu nav".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: What a page with it is called, not what the element holds: has-sidebar, with-comments.
LAYOUT = re.compile(r"(?<![^\s_-])(?:has|with|without|no)[_-]\S*", re.I)
#: Words of class, id and role. A name counts if its words are all here or in PARTS:
#: related-posts does, related-work doesn't. CERTAIN names tell what an element is, DOUBTFUL
#: ones only say so together with its text; READERS are certain in an id of a section too.
READERS = frozenset("comment comments commentary disqus replies reply respond".split())
CERTAIN = READERS | frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts aside banner breadcrumb "
    "breadcrumbs complementary consent contentinfo cookie cookies copyright disclaimer footer gdpr "
    "masthead modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted recommended related sidebar signup sponsor sponsored subscribe topbar".split()
)
DOUBTFUL = frozenset("alert dialog legal login menu search share sharing skip social teaser toolbar widget".split())
PARTS = frozenset(
    "active area article articles bar block body bottom box btn button buttons card container "
    "content count entry feed fixed floating form global google group header heading hidden holder "
    "icons inline inner item items layout left link links list main meta mobile module "
    "open outer overlay page panel post posts primary reader readers region right row secondary "
    "section site slot sticky stories sub tag text thread title to top unit user wrap wrapper".split()
)
HEADER_WORDS = frozenset(("header", "heading", "masthead"))
#: Elements whose tag says content: a doubtful name inside an article doesn't change it.
CONTENT = frozenset("blockquote details dl figure ol table".split())
BY_ID, BY_DOUBT, BY_NAME = 1, 2, 3

#: words, link density, the same of the block before and after; inside: 1 within an
#: article, 0 on a page without one, -1 outside of the article; furniture by tag; how much
#: the name of the element around it speaks for furniture, see name_weight; main text.
LABELLED = """
9 0.00 0 0.00 120 0.00 1 0 0.00 1
9 0.00 6 1.00 9 0.00 1 0 0.00 1
1 0.00 9 0.00 80 0.00 1 0 0.00 1
1 0.00 1 0.00 1 0.00 1 0 0.00 1
3 0.00 40 0.05 2 0.00 1 0 0.00 1
80 0.00 1 0.00 45 0.02 1 0 0.00 1
45 0.10 80 0.00 12 0.40 1 0 0.00 1
12 0.40 45 0.10 60 0.00 1 0 0.00 1
5 1.00 60 0.00 60 0.00 1 0 0.00 1
2 0.50 70 0.00 3 0.00 1 0 0.00 1
200 0.01 30 0.00 8 0.00 1 0 0.00 1
8 0.00 200 0.01 6 0.30 1 0 0.00 1
60 0.00 5 1.00 0 0.00 1 0 0.00 1
3 0.00 40 0.00 1 1.00 1 0 0.00 1
10 0.00 20 0.00 4 1.00 1 0 0.00 1
16 0.20 1 1.00 1 1.00 1 0 0.00 1
1 1.00 5 0.00 1 1.00 1 0 0.00 1
1 1.00 1 1.00 1 1.00 1 0 0.00 1
4 1.00 1 1.00 30 0.00 1 0 0.00 1
2 0.00 2 1.00 0 0.00 1 0 0.00 1
1 1.00 0 0.00 1 1.00 1 1 0.00 0
6 0.00 70 0.00 30 0.10 1 1 0.00 0
40 0.00 6 0.00 12 0.20 1 1 0.00 0
25 0.00 90 0.00 2 1.00 1 1 0.00 0
1 1.00 0 0.00 1 1.00 -1 1 0.00 0
1 1.00 1 1.00 14 0.00 -1 1 0.00 0
14 0.00 1 1.00 9 0.00 -1 1 0.00 0
20 0.05 60 0.00 0 0.00 -1 1 0.00 0
5 0.00 14 0.00 9 0.00 -1 0 0.00 0
60 0.00 1 1.00 9 0.00 -1 0 0.00 0
4 0.50 80 0.00 3 1.00 -1 0 0.00 0
35 0.10 90 0.00 12 0.00 -1 0 0.00 0
1 1.00 0 0.00 1 1.00 0 1 0.00 0
30 0.00 2 1.00 60 0.00 0 1 0.00 0
18 0.10 40 0.00 0 0.00 0 1 0.00 0
70 0.00 2 1.00 8 0.00 0 1 0.00 0
1 1.00 0 0.00 1 1.00 0 0 0.00 0
2 1.00 1 1.00 2 1.00 0 0 0.00 0
3 0.90 1 1.00 50 0.00 0 0 0.00 0
6 0.60 3 1.00 3 1.00 0 0 0.00 0
4 0.50 40 0.00 1 1.00 0 0 0.00 0
2 0.00 1 1.00 1 1.00 0 0 0.00 0
5 0.00 2 1.00 4 1.00 0 0 0.00 0
7 0.40 5 0.80 2 1.00 0 0 0.00 0
9 0.00 2 1.00 60 0.00 0 0 0.00 1
60 0.00 9 0.00 45 0.02 0 0 0.00 1
45 0.02 60 0.00 20 0.05 0 0 0.00 1
20 0.05 45 0.02 4 0.50 0 0 0.00 1
3 0.00 60 0.00 70 0.00 0 0 0.00 1
110 0.00 3 0.00 2 0.00 0 0 0.00 1
2 0.00 110 0.00 40 0.00 0 0 0.00 1
15 0.20 40 0.00 30 0.00 0 0 0.00 1
30 0.10 15 0.20 5 1.00 0 0 0.00 1
50 0.00 3 1.00 3 1.00 0 0 0.00 1
25 0.00 0 0.00 0 0.00 0 0 0.00 1
12 0.90 3 1.00 4 1.00 0 0 0.00 0
30 0.95 2 1.00 5 1.00 0 0 0.00 0
20 0.80 6 0.60 3 1.00 0 0 0.00 0
1 1.00 50 0.00 1 1.00 0 0 0.00 0
2 1.00 80 0.00 0 0.00 0 0 0.00 0
3 0.00 70 0.00 60 0.00 0 0 0.00 1
6 0.00 80 0.00 50 0.00 0 0 0.00 1
2 0.00 1 1.00 7 0.00 0 0 0.00 1
5 0.00 0 0.00 0 0.00 0 0 0.00 1
7 0.00 9 0.00 0 0.00 0 0 0.00 1
7 0.00 0 0.00 9 0.00 0 0 0.00 1
7 0.00 1 1.00 9 0.00 0 0 0.00 1
1 0.00 0 0.00 40 0.00 0 0 0.00 1
1 0.00 2 1.00 40 0.00 0 0 0.00 1
3 0.00 0 0.00 7 0.00 0 0 0.00 1
4 0.00 60 0.00 0 0.00 0 0 0.00 1
4 0.00 30 0.00 1 1.00 0 0 0.00 1
6 0.15 20 0.00 3 0.00 0 0 0.00 1
1 0.00 1 0.00 1 0.00 0 0 0.00 1
2 0.00 5 0.00 6 0.00 0 0 0.00 1
3 0.00 2 0.00 2 0.00 0 0 0.00 1
30 0.00 12 0.00 0 0.00 1 0 0.05 1
6 0.00 2 0.00 40 0.00 1 0 0.17 1
2 0.00 40 0.00 6 0.00 1 0 0.17 1
14 0.20 2 0.00 40 0.00 1 0 0.12 1
1 0.00 40 0.00 6 0.00 1 0 0.50 1
3 1.00 40 0.00 6 1.00 1 0 0.71 0
2 0.00 40 0.00 6 1.00 1 0 0.56 0
30 0.00 12 0.00 0 0.00 1 0 0.33 1
2 0.00 40 0.00 30 0.00 1 0 0.38 1
40 0.10 2 0.00 40 0.00 1 0 0.34 1
12 0.30 20 0.00 40 0.00 1 0 0.50 1
1 0.00 40 0.00 6 0.00 1 0 0.91 0
4 0.00 40 0.00 6 0.00 1 0 0.71 0
7 0.00 1 0.00 40 0.00 1 0 0.59 0
12 1.00 40 0.00 60 0.00 1 0 1.00 0
3 1.00 40 0.00 6 1.00 1 0 0.96 0
20 0.60 2 0.00 40 0.00 1 0 0.62 0
1 0.00 40 0.00 6 0.00 1 0 1.00 0
40 0.00 6 0.00 60 0.10 1 0 1.00 0
25 0.00 90 0.00 2 1.00 1 0 1.00 0
90 0.00 60 0.00 80 0.00 1 0 1.00 0
3 1.00 9 0.00 2 1.00 1 0 1.00 0
1 0.00 40 0.00 6 0.00 0 0 0.91 0
14 0.00 0 0.00 40 0.00 0 0 0.42 1
40 0.00 3 0.00 40 0.00 0 0 0.26 1
6 0.00 3 0.00 40 0.00 0 0 0.62 0
9 1.00 3 0.00 40 0.00 0 0 0.92 0
30 0.00 40 0.00 6 0.00 0 0 1.00 0
3 0.00 40 0.00 6 0.00 0 0 1.00 0
60 0.00 40 0.00 6 0.00 -1 0 0.14 0
60 0.00 40 0.00 6 0.00 -1 0 1.00 0
40 0.00 1 0.00 40 0.00 0 0 1.00 0
80 0.00 40 0.00 40 0.00 1 0 0.14 1
60 0.00 3 0.00 90 0.00 1 0 0.20 1
12 1.00 40 0.05 30 0.00 1 0 0.34 1
3 1.00 0 0.00 30 0.00 1 0 0.43 1
12 1.00 40 0.05 30 0.00 1 0 0.05 1
2 1.00 0 0.00 30 0.00 1 0 0.11 1
3 0.00 4 0.00 2 1.00 1 0 0.00 1
1 0.00 0 0.00 3 1.00 1 0 0.00 1
6 0.20 9 0.00 12 1.00 1 0 0.00 1
5 0.00 2 1.00 4 1.00 1 0 0.00 1
1 0.00 1 1.00 1 1.00 1 0 0.00 1
3 1.00 0 0.00 60 0.00 1 0 0.00 1
1 1.00 0 0.00 1 1.00 1 0 0.00 1
9 0.60 0 0.00 0 0.00 1 0 0.00 1
20 1.00 0 0.00 7 0.00 1 0 0.00 1
2 1.00 0 0.00 40 0.00 1 0 1.00 0
2 0.00 40 0.00 6 1.00 1 0 0.94 0
20 0.00 40 0.00 6 1.00 1 0 0.71 0
2 1.00 0 0.00 6 1.00 1 0 0.94 0
2 1.00 0 0.00 6 1.00 1 0 0.62 0
2 1.00 0 0.00 60 0.00 -1 0 0.00 0
2 0.00 0 0.00 60 0.00 -1 0 0.00 0
60 0.00 0 0.00 60 0.00 -1 0 0.00 0
4 0.50 40 0.00 6 0.00 1 0 0.77 0
1 1.00 0 0.00 6 0.00 1 0 0.83 0
12 1.00 40 0.05 30 0.00 0 0 0.34 1
20 0.00 40 0.05 30 0.00 1 0 1.00 0
9 0.00 0 0.00 30 0.00 1 0 1.00 0
30 0.10 4 0.00 8 0.00 0 0 1.00 0
9 0.00 20 0.00 8 0.00 -1 0 1.00 0
9 0.00 20 0.00 8 0.00 1 1 1.00 0
60 0.00 20 0.00 80 0.00 1 1 0.24 0
60 0.00 20 0.00 80 0.00 1 1 0.00 0
60 0.00 20 0.00 80 0.00 0 1 0.00 0
60 0.00 20 0.00 80 0.00 0 1 0.24 0
60 0.00 20 0.00 80 0.00 -1 0 0.24 0
14 0.00 20 0.00 80 0.00 -1 1 0.06 0
30 0.00 20 0.00 80 0.00 1 0 0.37 1
30 0.00 20 0.00 80 0.00 1 0 0.06 1
6 0.00 9 0.00 3 1.00 1 0 0.08 1
25 0.10 1 0.00 2 1.00 1 0 0.11 1
1 0.00 0 0.00 1 1.00 1 0 0.25 1
3 0.40 20 0.00 2 1.00 1 0 0.11 1
2 0.40 0 0.00 4 1.00 1 0 0.00 1
9 0.50 30 0.00 1 1.00 1 0 0.00 1
2 0.50 0 0.00 3 1.00 1 0 0.71 0
9 1.00 1 0.00 3 1.00 1 0 0.77 0
2 0.40 2 1.00 3 1.00 1 0 0.71 0
9 0.00 3 0.00 4 0.00 0 0 1.00 0
2 0.60 9 0.00 8 0.00 1 0 0.33 1
1 1.00 20 0.00 8 0.00 1 0 0.25 1
5 1.00 2 0.00 3 1.00 1 0 0.40 1
3 0.40 2 0.00 3 1.00 1 0 0.40 1
8 0.00 2 0.00 3 1.00 1 0 0.20 1
2 0.10 2 0.00 3 1.00 1 0 0.33 1
1 1.00 2 1.00 3 1.00 1 0 0.91 0
12 0.00 40 0.00 6 0.00 -1 0 0.45 0
30 0.00 9 0.00 60 0.00 -1 0 0.33 0
9 0.10 9 0.00 60 0.00 -1 0 0.42 0
25 0.60 9 0.00 60 0.00 -1 0 0.25 0
8 0.00 0 0.00 0 0.00 -1 0 0.50 0
8 1.00 0 0.00 0 0.00 1 0 0.00 1
2 0.00 9 0.00 6 1.00 1 0 0.50 1
1 0.00 40 0.00 1 1.00 1 0 0.33 1
14 0.00 9 0.00 30 0.00 1 1 0.42 0
30 0.00 9 0.00 30 0.00 0 1 0.33 0
9 0.20 9 0.00 30 0.00 1 1 0.25 0
45 0.00 9 0.00 30 0.00 0 1 0.20 0
12 0.00 9 0.00 30 0.00 1 1 0.00 0
3 0.00 9 0.00 3 0.00 0 1 0.00 0
6 0.00 60 0.00 9 0.00 0 1 0.14 0
1 0.00 60 0.00 3 1.00 1 0 0.00 1
1 0.50 9 0.00 3 1.00 1 0 0.50 1
5 0.20 30 0.00 2 1.00 1 0 0.20 1
60 0.00 1 1.00 2 1.00 0 0 0.00 1
20 0.00 0 0.00 1 1.00 0 0 0.00 1
12 0.10 2 1.00 3 1.00 0 0 0.00 1
"""
FEATURES = (
    "words", "link_density", "words_before", "link_density_before",
    "words_after", "link_density_after", "inside", "furniture",
    "named",
)
DEPTH = 12


def grow(rows: list[list[float]], depth: int = DEPTH):
    """A tree (feature, limit, up to it, above it) or the share of main text in a leaf."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share

    def impurity(part: list[list[float]]) -> float:
        p = sum(r[-1] for r in part) / len(part)
        return len(part) * p * (1 - p)

    best = None
    for j in range(len(FEATURES)):
        values = sorted({r[j] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            left, right = [r for r in rows if r[j] <= limit], [r for r in rows if r[j] > limit]
            found = (impurity(left) + impurity(right), j, limit)
            if best is None or found < best[0]:
                best = (found, left, right)
    if best is None:
        return share
    (_, j, limit), left, right = best
    return j, limit, grow(left, depth - 1), grow(right, depth - 1)


def labelled() -> list[list[float]]:
    return [[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()]


TREE = grow(labelled())


def is_main(features: list[float], tree=TREE) -> bool:
    while isinstance(tree, tuple):
        j, limit, low, high = tree
        tree = low if features[j] <= limit else high
    return tree >= 0.5


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    furniture: bool
    #: How much the name of the element around it speaks for furniture.
    named: float = 0.0


@dataclass(eq=False)
class _Holder:
    name: str
    article: bool
    above: _Holder | None = None
    #: Furniture by its own or an outer tag; how it is named; outer holders that are named so.
    tagged: bool = False
    named: int = 0
    n_named: int = 0
    spared: bool = False
    #: The most certainly named holder around a block, and what it holds in all.
    namer: _Holder | None = None
    blocks: int = 0
    words: int = 0
    linked: int = 0


def how_named(name: str, more: str, in_article: bool) -> int:
    """What class, id and role of an element say of it: 0, BY_ID, BY_DOUBT or BY_NAME."""
    most = 0
    for m in CLASSES.finditer(more):
        by_id = m[0][:2].lower() == "id" and name == "section" and in_article
        for one in LAYOUT.sub("", m[1] or m[2] or m[3] or "").split():
            words = {w for w in re.split(r"[^a-z]+", CAMEL.sub("-", one).lower()) if len(w) > 2 or w == "ad"}
            certain = CERTAIN - HEADER_WORDS if in_article else CERTAIN | HEADER_WORDS
            if not words or not words <= CERTAIN | DOUBTFUL | PARTS or words <= PARTS - certain:
                continue
            if words & READERS or (words & certain and not by_id):
                most = BY_NAME
            elif words & (certain | DOUBTFUL) and not (in_article and name in CONTENT):
                most = max(most, BY_ID if by_id else BY_DOUBT)
    return most


def name_weight(named: int, free_words: float) -> float:
    """0 to 1 for how an element is named and its words a block outside of links.

    Running text speaks against a doubtful name, any text against the id of a section.
    """
    return {0: 0.0, BY_ID: 1 / (1 + free_words), BY_DOUBT: 10 / (10 + free_words), BY_NAME: 1.0}[named]


@dataclass
class _Page:
    found: list[tuple[str, int, int, _Holder]] = field(default_factory=list)
    stack: list[_Holder] = field(default_factory=list)
    holders: list[_Holder] = field(default_factory=list)
    outermost: list[_Holder] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    links: int = 0

    def text(self, x: str) -> None:
        if x:
            self.parts.append((x, self.links > 0))

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(x for x, _ in self.parts)).split())
        if text:
            linked = sum(len(html.unescape(x).split()) for x, in_link in self.parts if in_link)
            top = self.stack[-1] if self.stack else _Holder("", False)
            words = text.count(" ") + 1
            self.found.append((text, words, min(linked, words), top))
        self.parts = []

    def open(self, name: str, more: str) -> None:
        above = self.stack[-1] if self.stack else _Holder("", False)
        article = above.article or name in ("article", "main")
        own = name in FURNITURE or (name == "header" and not above.article)
        outermost = name == "article" and not any(h.name == "article" for h in self.stack)
        named = 0 if outermost or name in ("body", "html", "main") else how_named(name, more, above.article)
        holder = _Holder(name, article, above, above.tagged or own or bool(HIDDEN.search(more)), named)
        holder.n_named = above.n_named + (above.named > 0)
        if article and not above.article:
            self.outermost.append(holder)
        self.stack.append(holder)
        self.holders.append(holder)

    def blocks(self) -> list[Block]:
        """The blocks, when all holders are known.

        A name doesn't make furniture of what holds the page's article: if every outermost
        article stands in holders with such names, those around the least enclosed ones
        are layout.
        """
        articles = [h for h in self.outermost if not h.tagged]
        least = min((h.n_named for h in articles), default=0)
        for h in articles:
            if least and h.n_named == least:
                above = h.above
                while above is not None and not above.spared:
                    above.spared, above.named = True, 0
                    above = above.above
        for _, words, linked, h in self.found:
            h.blocks, h.words, h.linked = h.blocks + 1, h.words + words, h.linked + linked
        for h in reversed(self.holders):
            up = h.above
            up.blocks, up.words, up.linked = up.blocks + h.blocks, up.words + h.words, up.linked + h.linked
        for h in self.holders:
            outer = h.above.namer
            h.namer = h if h.named and (outer is None or h.named > outer.named) else outer
        out = []
        for text, words, linked, h in self.found:
            block = Block(text, words, linked, h.article, h.tagged)
            if by := h.namer:
                block.named = name_weight(by.named, (by.words - by.linked) / by.blocks)
            out.append(block)
        return out

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                return
            if self.stack[i].name in ("article", "main", "body") and name not in ("html", "body", "main"):
                return  # a stray end tag doesn't leave the article


def raw_end(page: str, name: str, at: int, ends: dict[str, int]) -> int:
    """Where a raw element ends whose content begins at ``at``; ends remembers the next end tags.

    Without an end tag of its own it ends with the head or before the body, else with the page.
    """
    if ends.get(name, -1) < at:
        m = RAW_ENDS[name].search(page, at)
        ends[name] = m.end() if m else len(page) + 1
    end = ends[name]
    head = HEAD_END.search(page, at, min(end, len(page)))
    if head and (end > len(page) or RAW_STARTS[name].search(page, head.end(), end)):
        return head.start()
    if end <= len(page):
        return end
    body = BODY.search(page, at)
    return body.start() if body else len(page)


def tokens_of(page: str) -> list[tuple[int, int, re.Match]]:
    """(first, end, match) of a page's markup; a raw or skipped element is one with its content."""
    found: list[tuple[int, int, re.Match]] = []
    opened: dict[str, list[int]] = {name: [] for name in SKIPPED}
    ends: dict[str, int] = {}
    at = 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name = (m["name"] or m["loose"] or "").lower()
        if m["raw"]:
            # inside a drawing a raw element may close itself
            if not (opened["svg"] and m[0].endswith("/>")):
                at = raw_end(page, m["raw"].lower(), at, ends)
        elif name in SKIPPED:
            if m["end"] or m["loose_end"]:
                if opened[name]:
                    k = opened[name].pop()
                    found[k] = (found[k][0], at, found[k][2])
            elif not (name == "svg" and m[0].endswith("/>")):
                opened[name].append(len(found))
        found.append((m.start(), at, m))
    return found


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out = _Page()
    at = 0
    for first, end, m in tokens_of(page):
        if first < at:
            continue
        out.text(page[at:first])
        at = end
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "a":
            out.links = max(0, out.links - 1) if m["end"] else out.links + 1
        if name in BLOCKS:
            out.end_block()
            out.links = 0
            if name in HOLDERS and not m["more"].endswith("/"):
                if m["end"]:
                    out.close(name)
                else:
                    out.open(name, m["more"])
    out.text(page[at:])
    out.end_block()
    return out.blocks()


def main_text(page: str) -> str:
    """The blocks that the tree takes for main text, one a line."""
    blocks = blocks_of(page)
    has_article = any(b.in_article and not b.furniture and b.named < 1 for b in blocks)
    ends = Block("", 0, 0, False, False)

    def density(b: Block) -> float:
        return b.linked / b.words if b.words else 0.0

    out = []
    for before, b, after in zip([ends, *blocks], blocks, [*blocks[1:], ends], strict=False):
        inside = 1 if b.in_article else -1 if has_article else 0
        features = [
            b.words, density(b), before.words, density(before), after.words, density(after),
            inside, int(b.furniture), b.named,
        ]
        if is_main(features):
            out.append(b.text)
    return "\n".join(out)


def extracted(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null html is empty, and its text is empty; an empty table gives an empty table. Very long
    pages are read whole, in time that grows with their length. Character references are decoded, white
    space inside a block becomes one space, blocks are joined by line feeds. Scripts,
    styles, comments and form controls are markup, not text. Other columns are not
    looked at; repeated rows come out as often as they went in.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow_schema = to_arrow_schema(schema)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                schema=arrow_schema,
            )

    return rows.mapInArrow(extract, schema)
