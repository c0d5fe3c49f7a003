"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text between block-level tags. Each block is described by its words and its share of
words inside links, those of the blocks before and after it, and the marks of the regions around it: what its enclosing elements,
their roles and the words in their class and id say. A decision tree over these features, trained on the small
labelled table below, tells the blocks of the article from the rest. Pages are parsed inside the tasks, one page
at a time; the tree becomes a column expression, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, packed, table

# Names of HTML elements by their part in a page.
#: Their content is no text.
SILENT = frozenset("script style noscript template svg math canvas object iframe audio video select textarea button datalist map head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Regions that hold no article; a form is one too.
CHROME = frozenset("nav aside footer header form menu dialog fieldset search".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open paragraph, or an open element of the same kind.
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section table ul".split()
)
ENDS_SAME = frozenset("li dt dd option tr td th".split())
MAIN_ROLES = frozenset("main article".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id: beginnings that name a region of no article, whole words that do, and words of an article.
BAD_STARTS = (
    "advert", "sponsor", "promo", "comment", "cookie", "consent", "gdpr", "newsletter", "subscri", "sidebar", "nav", "menu", "breadcrumb", "foot", "masthead",
    "topbar", "share", "sharing", "social", "related", "recommend", "popup", "modal", "login", "signup", "signin", "search", "widget", "pagination", "pager", "disqus",
)
BAD_WORDS = frozenset(
    "ad ads adv header banner notice notices alert aside form discussion responses replies reply respond trending popular toolbar overlay toast paywall copyright colophon legal disclaimer skip tabs rail feedback".split()
)
GOOD_WORDS = frozenset("article articlebody content entry post story main maincontent body text".split())
ARTICLE_WORDS = frozenset("article entry post story main".split())

#: region: 1 inside the page's article, 0 on a page that marks none, -1 in another region or beside the article.
FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "region", "heading", "in_list")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>"'=]+|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>|<[!?/][^>]*>|<[A-Za-z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Region:
    """An open element and what it says about the text inside; silent and link hold for all that it holds."""

    __slots__ = ("tag", "bad", "chrome", "good", "silent", "main", "link", "holds_main", "parent")

    def __init__(self, tag: str, parent: "_Region | None", attributes: str):
        self.tag, self.parent, self.holds_main = tag, parent, False
        self.silent = tag in SILENT or parent is not None and parent.silent
        self.link = tag == "a" or parent is not None and parent.link
        self.chrome = tag in CHROME
        self.main = tag in ("article", "main")
        self.bad = self.good = False
        if attributes.strip(" \t\r\n/") and tag not in ("html", "body"):
            found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
            role = found.get("role", "").strip().lower()
            self.main |= role in MAIN_ROLES
            self.chrome |= role in CHROME_ROLES
            self.silent |= "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
            names = {w.lower() for key in ("class", "id") for w in _NAME.findall(found.get(key, ""))}
            named = bool(names & GOOD_WORDS)
            self.bad = any(w in BAD_WORDS or w.startswith(BAD_STARTS) for w in names if not (named and w == "header"))
            self.bad &= not (self.main and names & ARTICLE_WORDS)
            self.good = named and not self.bad

    def around(self) -> Iterator["_Region"]:
        """The element and those around it, innermost first."""
        region = self
        while region is not None:
            yield region
            region = region.parent


def blocks_of(page: str | None) -> list[dict]:
    """The text blocks of a page in order: text, and each of FEATURES as a float.

    Character references are decoded, white space inside a block becomes one space. A class or id that names
    another region counts only on elements that do not hold the page's first article, main or so named element.
    A tag that the page ends in is dropped.
    """
    page = page or ""
    root = top = _Region("", None, "")
    held: list[str] = []
    blocks: list[tuple[str, int, int, _Region]] = []
    words = linked = at = 0
    first = named = spare = None  # an article or main; an element so named; an article in an element named otherwise
    while at < len(page):
        tag = _TAG.search(page, at)
        end = tag.start() if tag else len(page)
        if end > at and not top.silent:
            piece = html.unescape(page[at:end])
            held.append(piece)
            n = len(piece.split())
            words += n
            linked += n if top.link else 0
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name == "br":
            held.append("\n")
            continue
        inline = name in INLINE
        if not inline:
            text = " ".join("".join(held).split())
            if text:
                blocks.append((text, words, linked, top))
            held, words, linked = [], 0, 0
        if tag[1]:  # an end tag closes up to its start tag; one without a start tag is passed over
            for region in top.around():
                if region.tag == name:
                    top = region.parent
                    break
                if inline and region.tag not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if name in _RAW:
            stop = _RAW[name].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        top = _Region(name, _implied(name, top), tag[3])
        if first is None and (top.main or top.good) and not top.bad and not any(r.chrome for r in top.around()):
            doubtful = any(r.bad for r in top.around())
            if not top.main:
                named = named or (None if doubtful else top)
            elif not doubtful:
                first = top
            else:
                spare = spare or top
    text = " ".join("".join(held).split())
    if text:
        blocks.append((text, words, linked, top))
    article = first or named or spare or root
    for region in article.around():
        region.holds_main = region is not article
    return _described(blocks, article is not root, use_named=article is named)


#: Elements whose content is text up to their end tag.
_RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


def _implied(name: str, top: _Region) -> _Region:
    """The element that a start tag comes into, after those that it ends by itself."""
    if name in ENDS_P:
        region = next(r for r in top.around() if r.tag not in INLINE)
        return region.parent if region.tag == "p" else top
    if name in ENDS_SAME:
        region = next(r for r in top.around() if r.tag in ("", "ul", "ol", "dl", "table", "select", "menu", name))
        return region.parent if region.tag == name else top
    return top


def _described(blocks: list[tuple[str, int, int, _Region]], has_main: bool, use_named: bool) -> list[dict]:
    """Features from the elements around each block; the header of an article is none around its headings."""
    out = []
    for text, words, linked, region in blocks:
        heading = in_list = inside = other = header = False
        for r in region.around():
            heading |= r.tag in HEADINGS
            in_list |= r.tag == "li"
            if r.tag == "header" and heading:
                header = True
            else:
                other |= r.chrome
            other |= r.bad and not r.holds_main
            if r.main or use_named and r.good:
                inside, header = True, False
        place = -1.0 if other or header or has_main and not inside else float(inside)
        out.append({"text": text, "words": float(words), "linked": linked / words if words else 0.0, "region": place, "heading": float(heading), "in_list": float(in_list)})
    for i, block in enumerate(out):
        for side, j in (("before", i - 1), ("after", i + 1)):
            other = out[j] if 0 <= j < len(out) else None
            block[f"words_{side}"], block[f"linked_{side}"] = (other["words"], other["linked"]) if other else (0.0, 0.0)
    return out


# The labelled table. A page is a list of (elements around the block, words, of them linked, label): label 1 is the
# article. Elements are written as in a style sheet, outermost first; neighbours follow from the order.
LABELLED = [
    [("nav ul li", 1, 1, 0), ("nav ul li", 2, 2, 0), ("nav ul li", 1, 1, 0), ("div.ad", 9, 0, 0), ("article h1", 8, 0, 1), ("article p", 60, 0, 1), ("article p", 3, 0, 1), ("article p", 140, 4, 1), ("article p", 1, 0, 1), ("footer", 12, 0, 0)],
    [("header h1", 3, 3, 0), ("header p", 7, 0, 0), ("nav ul li", 1, 1, 0), ("main h1", 6, 0, 1), ("main p", 45, 2, 1), ("main ul li", 4, 0, 1), ("main ul li", 9, 9, 1), ("main blockquote", 22, 0, 1), ("main aside p", 18, 0, 0), ("main p", 2, 0, 1), ("section.comments h2", 2, 0, 0), ("section.comments p", 35, 0, 0), ("footer p", 9, 4, 0)],
    [("div#menu a", 5, 5, 0), ("div.cookie-notice p", 24, 3, 0), ("div.post h2", 5, 0, 1), ("div.post p", 80, 0, 1), ("div.post p", 6, 0, 1), ("div.post p", 33, 12, 1), ("div.sidebar h3", 2, 0, 0), ("div.sidebar p", 40, 6, 0), ("div#footer p", 15, 3, 0)],
    [("div", 6, 6, 0), ("div", 4, 4, 0), ("h1", 7, 0, 1), ("p", 55, 0, 1), ("p", 70, 3, 1), ("p", 31, 0, 1), ("p", 48, 2, 1), ("div", 5, 5, 0), ("div", 3, 3, 0)],
    [("div", 2, 2, 0), ("div", 3, 3, 0), ("div", 2, 1, 0), ("h2", 4, 0, 1), ("div", 90, 0, 1), ("div", 14, 0, 1), ("div", 65, 5, 1), ("div", 12, 12, 0), ("div", 8, 7, 0)],
    [("form p", 6, 0, 0), ("p", 26, 0, 1), ("p", 5, 0, 1), ("p", 30, 0, 1), ("p", 12, 1, 1), ("ul li", 3, 3, 0), ("ul li", 2, 2, 0), ("ul li", 4, 4, 0), ("p", 2, 2, 0)],
    [("div.banner", 11, 0, 0), ("article header h1", 9, 0, 1), ("article p", 20, 0, 1), ("article div.share", 4, 3, 0), ("article form p", 8, 0, 0), ("article p", 50, 1, 1), ("article ul li", 2, 2, 1), ("article table td", 1, 0, 1), ("article footer p", 6, 2, 0), ("div.comments article p", 25, 0, 0), ("aside p", 30, 1, 0), ("p", 17, 0, 0), ("p", 40, 0, 0)],
    [("p", 14, 0, 0), ("main p", 30, 0, 1), ("main p", 8, 8, 1), ("main div.ad", 30, 0, 0), ("div", 22, 0, 0), ("h2", 3, 0, 0), ("h3", 2, 2, 0), ("ul li", 7, 0, 0)],
    [("div", 2, 0, 0), ("div", 6, 6, 0), ("p", 40, 0, 1), ("p", 4, 0, 1), ("p", 66, 0, 1), ("div", 7, 7, 0), ("div", 8, 0, 0)],
    [("p", 3, 0, 0), ("p", 5, 5, 0), ("p", 4, 4, 0), ("h2", 6, 0, 1), ("p", 25, 0, 1), ("p", 2, 0, 1), ("p", 50, 1, 1), ("p", 9, 0, 1), ("p", 6, 6, 0), ("p", 5, 0, 0)],
    [("p", 90, 0, 1), ("p", 4, 0, 1), ("p", 6, 6, 0), ("p", 3, 0, 0), ("p", 4, 4, 0)],
    [("td", 4, 4, 0), ("td", 5, 0, 0), ("td", 3, 3, 0), ("td", 70, 0, 1), ("td", 5, 0, 1), ("td", 7, 2, 1), ("td", 44, 0, 1), ("td", 2, 2, 0), ("td", 6, 1, 0)],
    [("article h1", 2, 0, 1), ("article ul li", 3, 3, 1), ("article p", 2, 0, 1), ("article ul li", 2, 2, 1), ("article p", 4, 0, 1), ("article p", 1, 0, 1), ("article ul li", 5, 5, 1), ("article h2", 3, 0, 1), ("article p", 7, 0, 1)],
    [("div.content p", 3, 3, 1), ("div.content p", 6, 0, 1), ("div.content ol li", 4, 4, 1), ("div.content p", 1, 0, 1), ("div.content ol li", 8, 8, 1), ("div.content p", 3, 0, 1), ("div.menu a", 3, 3, 0), ("p", 5, 0, 0)],
    [("article p", 1, 0, 1), ("article p", 1, 1, 1)],
    [("p", 3, 0, 1)],
    [("h1", 4, 0, 1), ("p", 9, 0, 1)],
]


def labelled_page(rows: list) -> str:
    """An HTML page whose blocks are those of `rows`; neighbouring blocks share the elements that they have in common."""
    out, open_ = [], []
    for path, n, linked, _ in rows:
        steps = path.split()
        shared = 0
        while shared < min(len(open_), len(steps) - 1) and open_[shared] == steps[shared]:
            shared += 1
        out += [f"</{s.split('.')[0].split('#')[0]}>" for s in reversed(open_[shared:])]
        for s in steps[shared:]:
            tag, _, kind = s.partition(".")
            tag, _, key = tag.partition("#")
            out.append(f"<{tag}{f' class={kind}' if kind else ''}{f' id={key}' if key else ''}>")
        plain = " ".join(["word"] * (n - linked))
        out.append(f"{plain} <a href=x>{' '.join(['link'] * linked)}</a>" if linked else plain)
        open_ = steps
    return "".join(out)


def training_rows(spark: SparkSession, labelled: list = LABELLED) -> DataFrame:
    """label double and FEATURES of every block of the labelled table."""
    rows = []
    for page in labelled:
        blocks = blocks_of(labelled_page(page))
        if len(blocks) != len(page):
            raise ValueError(f"the labelled page gives {len(blocks)} blocks for {len(page)} rows: {page}")
        rows += [(float(r[3]), *[b[f] for f in FEATURES]) for r, b in zip(page, blocks, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ("label", *FEATURES)))


def fit(rows: DataFrame, depth: int = 8):
    """The decision tree of `training_rows` (or of any table with the same columns), as nested
    ("feature", threshold, low side, high side) and leaves 0.0 or 1.0."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(data.select("label", "features"))

    def told(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        return FEATURES[node.split().featureIndex()], float(node.split().threshold()), told(node.leftChild()), told(node.rightChild())

    return told(model._java_obj.rootNode())


def decided(tree, block: Column) -> Column:
    """The tree's label of a block, as one expression."""
    if isinstance(tree, float):
        return F.lit(tree == 1.0)
    name, threshold, low, high = tree
    return F.when(block[name] <= threshold, decided(low, block)).otherwise(decided(high, block))


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), *[(f, pa.float64()) for f in FEATURES]]))


def with_blocks(pages: DataFrame, html_col: str = "html", out: str = "blocks") -> DataFrame:
    """`pages` without `html_col`, with `out`: array<struct<text, FEATURES>> of the text blocks of each page."""
    kept = [c for c in pages.columns if c != html_col]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([blocks_of(x) for x in batch.column(1).to_pylist()], _BLOCKS)
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "blocks"])

    inner = ", ".join(["text: string", *[f"{f}: double" for f in FEATURES]])
    parsed = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, blocks array<struct<{inner}>>")
    return parsed.select("row.*", F.col("blocks").alias(out))


def main_text(pages: DataFrame, html_col: str = "html", out: str = "text", tree=None) -> DataFrame:
    """`pages` without `html_col`, with `out` string: the text of the blocks that the tree takes for the article, joined by a space.

    Null or empty pages, and pages without such a block, give an empty text. Whole pages are read, however long;
    repeated rows stay, an empty table gives an empty result; a column that is called `out` is replaced, others stay.
    """
    tree = fit(training_rows(pages.sparkSession)) if tree is None else tree
    found = free_name(pages, "blocks")
    parsed = with_blocks(pages.drop(*[c for c in pages.columns if c == out and c != html_col]), html_col, found)
    kept = F.filter(found, lambda b: decided(tree, b))
    return parsed.withColumn(out, F.array_join(F.transform(kept, lambda b: b["text"]), " ")).drop(found)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op13_main_text": op13_main_text}
#: HTML has no SQL; tests/llm compare with articles taken out by hand and by a plain reading of the given pages.
ORACLE_SQL: dict[str, str] = {}
