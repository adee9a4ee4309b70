"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is read into a flat list of blocks (runs of text between block-level tags). Each block has
its word count, its link density, the same of its two neighbours, and what kind of element it
stands in. A decision tree grown from a small labelled table of such blocks says which blocks
are main text. The table as it is decides by the kind of element and the block's own link density:
no split uses word counts or neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("script style noscript template iframe object svg canvas math head title select textarea button datalist audio video map applet noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is about the site, not the article.
SITE_TAGS = frozenset("nav footer header aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
# Words in class, id or role that name parts of a page other than the article.
SITE_WORDS = frozenset("ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended trending comment comments disqus reply replies respond feedback toolbar skip copyright legal disclaimer form search complementary contentinfo dialog".split())
REPLY_WORDS = frozenset("comment comments reply replies related recommended promo promoted teaser sponsored ad".split())
MAIN_WORDS = frozenset("article post story content entry main articlebody storybody".split())
PARAGRAPH_CLOSERS = BLOCK_TAGS - {"body", "html", "head"}


class _Blocks(HTMLParser):
    """Blocks as [words, linked words, text, kind]; kind: 1 inside an article, 2 inside a part of the site, 0 neither."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Open elements and what they stand for: 's' silent, 'X' site by its tag, 'x' site by a name, 'M' and 'm' main, ''
        self.stack: list[tuple[str, str]] = []
        self.silent = self.links = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.blocks: list[tuple[int, int, str, int]] = []

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            linked = min(len(words), len(" ".join(self.linked).split()))
            self.blocks.append((len(words), linked, " ".join(words), self._place()))
        self.parts, self.linked = [], []

    def _place(self) -> int:
        kinds = [k for _, k in self.stack if k and k != "s"]
        if "M" in kinds:  # an article element inside a named part is still the article; parts inside it are not
            last = len(kinds) - 1 - kinds[::-1].index("M")
            return 2 if "X" in kinds or "x" in kinds[last:] else 1
        return 2 if "X" in kinds or "x" in kinds else 1 if "m" in kinds else 0

    @staticmethod
    def _names(attrs) -> set[str]:
        found: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id", "role", "itemprop") and v:
                for word in v.lower().split():
                    found.add(word)
                    found.update(word.replace("_", "-").split("-"))
        return found

    def _kind(self, tag: str, attrs) -> str:
        if tag in SILENT_TAGS or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return "s"
        names = self._names(attrs) if attrs else set()
        if tag in SITE_TAGS:
            return "X"
        if tag in MAIN_TAGS:
            return "x" if names & REPLY_WORDS else "M"
        if tag in BLOCK_TAGS and tag not in ("body", "html"):
            if names & SITE_WORDS:
                return "x"
            if names & MAIN_WORDS:
                return "m"
        return ""

    def _close_to(self, at: int) -> None:
        while len(self.stack) > at:
            tag, kind = self.stack.pop()
            self.silent -= kind == "s"
            self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in PARAGRAPH_CLOSERS:  # a block closes an open paragraph and the inline elements in it
                at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in BLOCK_TAGS), None)
                if at is not None and self.stack[at][0] == "p":
                    self._close_to(at)
        if tag in VOID_TAGS:
            return
        kind = self._kind(tag, attrs)
        self.silent += kind == "s"
        self.links += tag == "a"
        self.stack.append((tag, kind))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID_TAGS or tag in BLOCK_TAGS:
            self.handle_starttag(tag, attrs)
            if tag not in VOID_TAGS:
                self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None:
            return
        # An inline end tag does not close blocks that were opened after it.
        if tag not in BLOCK_TAGS and tag not in SILENT_TAGS and any(t in BLOCK_TAGS for t, _ in self.stack[at + 1 :]):
            return
        self._close_to(at)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked.append(data)


def blocks_of(html: str) -> list[tuple[int, int, str, int]]:
    p = _Blocks()
    p.feed(html)
    p.close()
    p.flush()
    return p.blocks


FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_article", "in_site_part", "page_has_article"]


def features(blocks: list[tuple[int, int, str, int]]) -> list[list[float]]:
    w = [float(b[0]) for b in blocks]
    d = [b[1] / b[0] for b in blocks]
    has = float(any(b[3] == 1 for b in blocks))
    n = len(blocks)
    return [[w[i], d[i], w[i - 1] if i else 0.0, d[i - 1] if i else 0.0, w[i + 1] if i + 1 < n else 0.0, d[i + 1] if i + 1 < n else 0.0, float(b[3] == 1), float(b[3] == 2), has] for i, b in enumerate(blocks)]


# Labelled blocks in the order of FEATURES, then 1 for main text. Written by hand from kinds of blocks on typical pages.
LABELLED = [
    # article element: headings, long and short paragraphs, lists of links inside the text
    (9, 0.0, 6, 1.0, 80, 0.0, 1, 0, 1, 1), (80, 0.0, 9, 0.0, 60, 0.05, 1, 0, 1, 1), (60, 0.05, 80, 0.0, 1, 0.0, 1, 0, 1, 1), (1, 0.0, 60, 0.0, 45, 0.0, 1, 0, 1, 1),
    (45, 0.0, 1, 0.0, 7, 0.2, 1, 0, 1, 1), (3, 1.0, 50, 0.0, 30, 0.0, 1, 0, 1, 1), (12, 0.5, 3, 1.0, 40, 0.0, 1, 0, 1, 1), (300, 0.1, 12, 0.5, 8, 0.0, 1, 0, 1, 1),
    # site parts on such pages, some long and without links
    (6, 1.0, 0, 0.0, 6, 1.0, 0, 1, 1, 0), (25, 0.0, 6, 1.0, 9, 0.0, 0, 1, 1, 0), (90, 0.0, 60, 0.0, 8, 0.1, 0, 1, 1, 0), (8, 0.1, 45, 0.0, 0, 0.0, 0, 1, 1, 0),
    (14, 0.3, 30, 0.0, 14, 0.3, 0, 1, 1, 0), (40, 0.0, 14, 0.3, 35, 0.0, 0, 1, 1, 0), (2, 0.0, 80, 0.0, 3, 1.0, 0, 1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0),
    # neither, while the page has an article: loose notices, credits, menus
    (12, 0.0, 6, 1.0, 9, 0.0, 0, 0, 1, 0), (5, 1.0, 5, 1.0, 12, 0.0, 0, 0, 1, 0), (30, 0.0, 60, 0.0, 8, 0.0, 0, 0, 1, 0), (70, 0.1, 9, 0.0, 9, 0.0, 0, 0, 1, 0),
    (25, 0.0, 3, 0.0, 30, 0.0, 0, 0, 1, 0), (3, 0.0, 40, 0.0, 0, 0.0, 0, 0, 1, 0), (110, 0.0, 70, 0.0, 60, 0.0, 0, 0, 1, 0), (45, 0.2, 8, 0.0, 70, 0.0, 0, 0, 1, 0),
    # pages without an article element: paragraphs, headings, short lines among text
    (70, 0.0, 9, 0.0, 60, 0.0, 0, 0, 0, 1), (60, 0.1, 70, 0.0, 4, 0.0, 0, 0, 0, 1), (4, 0.0, 60, 0.1, 55, 0.0, 0, 0, 0, 1), (25, 0.0, 55, 0.0, 40, 0.0, 0, 0, 0, 1),
    (9, 0.0, 5, 1.0, 70, 0.0, 0, 0, 0, 1), (18, 0.2, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (35, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 1), (14, 0.0, 22, 0.0, 13, 0.0, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (1, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0, 1), (150, 0.3, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (6, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1),
    # link lists and site parts on such pages
    (4, 1.0, 4, 1.0, 4, 1.0, 0, 0, 0, 0), (12, 0.9, 4, 1.0, 60, 0.0, 0, 0, 0, 0), (5, 1.0, 70, 0.0, 3, 1.0, 0, 0, 0, 0), (3, 0.7, 5, 1.0, 4, 0.7, 0, 0, 0, 0),
    (30, 0.8, 60, 0.0, 20, 0.9, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 5, 1.0, 0, 0, 0, 0), (80, 0.0, 60, 0.0, 5, 1.0, 0, 1, 0, 0), (7, 0.2, 3, 1.0, 0, 0.0, 0, 1, 0, 0),
    (25, 0.0, 9, 0.0, 30, 0.0, 0, 1, 0, 0), (60, 0.0, 2, 0.0, 70, 0.0, 0, 1, 0, 0), (3, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0), (12, 0.1, 0, 0.0, 40, 0.0, 0, 1, 0, 0),
]


def grow(rows: list[tuple], depth: int = 8):
    """CART on Gini impurity: ('leaf', share of ones) or ('split', feature, threshold, low side, high side)."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return ("leaf", ones / len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low = [r for r in rows if r[f] <= (a + b) / 2]
            high = [r for r in rows if r[f] > (a + b) / 2]
            cost = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in (low, high))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2, low, high)
    if best is None:
        return ("leaf", ones / len(rows))
    return ("split", best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1))


@lru_cache(maxsize=1)
def tree():
    return grow(LABELLED)


def is_main(node, x: list[float]) -> bool:
    while node[0] == "split":
        node = node[3] if x[node[1]] <= node[2] else node[4]
    return node[1] >= 0.5


def extract(html: str | None, model=None) -> str:
    """Main text of one page; empty for a null or empty page."""
    found = blocks_of(html or "")
    node = model or tree()
    return "\n\n".join(b[2] for b, x in zip(found, features(found)) if is_main(node, x))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """One row per page: id, the columns in `carry` unchanged, text, n_chars (code points of the text).

    Whole pages, one by one; no shuffle. A null or empty page and a page without main text give
    an empty text. Broken markup is read as far as it goes: open elements end with the page, end
    tags without a start are passed over. Repeated rows and null ids come out as they went in;
    other columns are ignored.
    """
    kept = pages.select(id_col, *(carry or [])).schema.fields
    out_type = StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
    out_arrow = to_arrow_schema(out_type)
    html_at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tree()
        for b in batches:
            texts = [extract(h.as_py(), model) for h in b.column(html_at)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:html_at], *made], names=out_arrow.names)

    return pages.select(id_col, *(carry or []), F.col(html_col).alias("_html")).mapInArrow(run, out_type)
