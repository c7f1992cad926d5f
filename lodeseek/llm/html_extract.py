"""HTML extraction: flat text blocks with word counts and link densities of their neighbours, sorted by a decision tree.

Each page is cut into blocks at block-level tags. A block's row has its own, the previous and the next block's number
of words and link density, and what the tags around it are named. The tree is trained by Spark on the small labelled
table of html_training.py and applied as one column expression.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_training import PAGES
from .shared import read_table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW_TAGS = frozenset("script style noscript template svg annotation annotation-xml iframe select textarea title".split())
#: Tags, roles and parts of class names or ids of what surrounds an article, and of what holds one.
AROUND_TAGS = frozenset("nav aside footer form button dialog menu head label".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar note".split())
AROUND_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert banner bottom breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright "
    "discussion disqus foot footer form gdpr header hidden legal links login masthead menu meta modal nav navbar navigation newsletter notice notification "
    "outbrain overlay pager pagination paywall popular popup privacy promo promotion promoted recommend recommended related replies reply respond responses rss search share "
    "sharing sidebar sidemenu signup skip skyscraper social sponsor sponsored subscribe taboola tagcloud tags teaser toolbar topbar trending warning widget widgets".split()
)
#: Parts of a name beside those of AROUND_NAMES. A name with any other part ("has-sidebar", "comments-open") tells of a state.
PLAIN_NAMES = frozenset(
    "area article articles bar block body box btn button center col column container content cookies entry fixed global group holder icon inner item items js left list main "
    "module news outer page panel post posts primary right row secondary section site story sub text the title top wide wp wrap wrapper".split()
)
#: Inside an article these are part of its text.
ADMONITIONS = frozenset("alert note notice warning".split())
MAIN_TAGS, MAIN_ROLES = frozenset(["article", "main"]), frozenset(["main", "article"])
MAIN_NAMES = frozenset("article content entry main post story".split())

# a value in quotes may hold a >; quotes elsewhere are no quotes, nor are those that never close
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "around", "main", "page_has_main", "heading", "item"]


#: Why an element stands around: by its tag, role or hiding, or only by its name or as a form, which may hold the page.
BY_TAG, BY_NAME = 2, 1


def _named(name: str, attributes: str, inside: bool = False) -> tuple[int, bool]:
    """Whether a tag stands around an article (BY_TAG, BY_NAME or 0), and whether it holds one; inside: it is in one itself."""
    around, main = name in AROUND_TAGS or name == "header", name in MAIN_TAGS
    if name in ("html", "body"):
        return 0, False
    if not attributes.strip():
        return (BY_NAME if name == "form" else BY_TAG) if around else 0, main
    given = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    found, names = set(), set()
    for token in (t for k in ("class", "id") for t in given.get(k, "").split()):
        parts = {w.lower() for w in _NAME.findall(token)}
        names |= parts
        if parts & AROUND_NAMES and parts <= AROUND_NAMES | PLAIN_NAMES:
            found |= parts & AROUND_NAMES
    role = given.get("role", "").lower()
    hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I)
    main = main or role in MAIN_ROLES or bool(names & MAIN_NAMES)
    if main and found <= {"header", "meta", "byline", "tags", "links"}:
        found = set()
    if inside and found <= ADMONITIONS:
        found = set()
    if name == "main" or (name == "article" and (not inside or names & MAIN_NAMES)):
        found = set()  # an article in another may be a remark on it
    if (around and name != "form") or (role in AROUND_ROLES and not (inside and role in ADMONITIONS)) or hidden:
        return BY_TAG, main
    return BY_NAME if around or found else 0, main


def _holding_all(found: list, kinds: list[int]) -> set[int]:
    """Elements, around by name only, that hold the page: its article is in them, and none without them.

    found: blocks with the elements around them that stand around, and whether they show an article: they are in a main
    element or under h1. Outermost first, each is tried as if it weren't around; what holds a page is among the largest.
    """
    held: set[int] = set()
    if any(sign and not elements for _, elements, sign in found):
        return held
    sizes: Counter = Counter()
    for block, elements, _ in found:
        for x in elements:
            sizes[x] += block[1] - block[2]
    for e in sorted(x for x, _ in sizes.most_common(20)):
        if kinds[e] != BY_NAME:
            continue
        inside = outside = signs = long = 0
        without = False
        for block, elements, sign in found:
            plain = block[1] - block[2]
            others = [x for x in elements if x != e and x not in held]
            if e not in elements:
                if not others:
                    outside += plain
                    without = without or sign
            elif not any(kinds[x] == BY_TAG or x < e for x in others):
                inside += plain
                signs += sign
                long += plain >= 10
        if not without and inside > outside and (signs or (not outside and long >= 3)):
            held.add(e)
    return held


def blocks(page: str | None) -> list[tuple[str, int, int, int, int, int, int, int]]:
    """(text, words, linked words, around, main, heading, item, offset) of each block of a whole page, in order."""
    page = page or ""
    found: list = []
    elements: list[tuple[list[int], bool]] = []
    stack: list[tuple[str, int, bool]] = []  # name, number of the element if it stands around, else -1, holds an article
    kinds: list[int] = []
    opened: Counter = Counter()  # open elements by name
    around_open: list[int] = []
    block_open: list[str] = []
    main = 0
    pieces: list[tuple[str, bool]] = []
    tag_of_block, block_at, at, n = "", 0, 0, len(page)
    lower, last, quotes = "", page.rfind(">"), True

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                words = len(text.split())
                linked = sum(len(t.split()) for t, is_link in pieces if is_link)
                found.append((text, words, min(linked, words), 0, int(main > 0), int(tag_of_block[:1] == "h" and tag_of_block[1:].isdigit()), int(tag_of_block in ("li", "td", "th", "dd", "dt")), block_at))
                elements.append((around_open.copy(), main > 0 or opened["h1"] > 0))
        pieces = []

    def pop() -> str:
        nonlocal main
        name, element, m = stack.pop()
        main -= m
        opened[name] -= 1
        if element >= 0:
            around_open.pop()
        if name in BLOCK_TAGS:
            block_open.pop()
        return name

    while at < n:
        to = page.find("<", at)
        if to != at:
            text = page[at : n if to < 0 else to]
            if not pieces:
                block_at = at
            pieces.append((html_lib.unescape(text) if "&" in text else text, opened["a"] > 0))
            if to < 0:
                break
            at = to
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = None
        if at < last and page[at + 1 : at + 2] != " ":
            m = _TAG.match(page, at) if quotes else None
            if not m and (m := _LOOSE.match(page, at)):
                quotes = False  # a tag's quotes took in the rest of the page: from here on they mean nothing
        if not m:
            pieces.append(("<", opened["a"] > 0))
            at += 1
            continue
        closing, name, attributes = m[1], m[2].lower(), m[3]
        at = m.end()
        if name in RAW_TAGS and not closing:
            if not attributes.endswith("/"):
                lower = lower or page.lower()
                lower = lower if len(lower) == n else re.sub("[A-Z]", lambda x: x[0].lower(), page)
                end = lower.find(f"</{name}", at)
                end = -1 if end < 0 else page.find(">", end)
                at = n if end < 0 else end + 1
            continue
        if name in BLOCK_TAGS:
            flush()
        elif name in ("br", "mtd"):
            pieces.append((" ", opened["a"] > 0))
        if closing:
            while opened[name] and pop() != name:
                pass
            tag_of_block = block_open[-1] if block_open else ""
            continue
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        if name in BLOCK_TAGS and opened["p"]:  # a block ends an open paragraph
            while pop() != "p":
                pass
        if name == "body":
            while opened["head"]:
                pop()
        if name in ("a", "li", "option", "dt", "dd", "tr") and stack and stack[-1][0] == name:
            pop()
        a, mn = _named(name, attributes, main > 0)
        if name == "header" and main and not (a and attributes.strip() and _named("div", attributes)[0]):
            a = 0  # an article's own head
        stack.append((name, len(kinds) if a else -1, mn))
        if a:
            around_open.append(len(kinds))
            kinds.append(a)
        main += mn
        opened[name] += 1
        if name in BLOCK_TAGS:
            block_open.append(name)
            tag_of_block = name
    flush()
    held = _holding_all([(b, *e) for b, e in zip(found, elements, strict=True)], kinds) if BY_NAME in kinds else set()
    return [(*b[:3], int(any(x not in held for x in e)), *b[4:]) for b, (e, _) in zip(found, elements, strict=True)]


_KINDS = "struct<text:string,words:double,links:double,words_before:double,links_before:double,words_after:double,links_after:double,around:double,main:double,page_has_main:double,heading:double,item:double,at:bigint>"


def with_neighbours(found: list) -> list[dict]:
    density = [b[2] / b[1] for b in found]
    free = [b for b in found if not b[3]]
    has_main = float(2 * sum(b[1] for b in free if b[4]) > sum(b[1] for b in free))  # most of what isn't around
    out = []
    for i, b in enumerate(found):
        before, after = i - 1 if i else None, i + 1 if i + 1 < len(found) else None
        out.append({
            "text": b[0], "words": float(b[1]), "links": density[i],
            "words_before": float(found[before][1]) if before is not None else 0.0, "links_before": density[before] if before is not None else 0.0,
            "words_after": float(found[after][1]) if after is not None else 0.0, "links_after": density[after] if after is not None else 0.0,
            "around": float(b[3]), "main": float(b[4]), "page_has_main": has_main, "heading": float(b[5]), "item": float(b[6]), "at": b[7],
        })
    return out


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with _blocks in place of html: an array with a row of text and features for each block of the whole page."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = _parse_datatype_string(f"array<{_KINDS}>")
    arrow = pa.list_(pa.struct([(f.name, pa.string() if f.name == "text" else pa.int64() if f.name == "at" else pa.float64()) for f in kind.elementType.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                kept = [i for i, c in enumerate(batch.schema.names) if c != html]
                cut = pa.array([with_neighbours(blocks(x)) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()], arrow)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), cut], names=[*(batch.schema.names[i] for i in kept), "_blocks"])

    return pages.mapInArrow(run, StructType([*(f for f in pages.schema.fields if f.name != html), StructField("_blocks", kind)]))


def labelled(spark: SparkSession) -> DataFrame:
    """The training table: a row for each block of the pages in html_training.py, label 1 for main text."""
    rows = []
    for page in PAGES:
        ends, at = [], 0
        for part, keep in page:
            at += len(part)
            ends.append((at, keep))
        for b in with_neighbours(blocks("".join(p for p, _ in page))):
            rows.append((*(b[f] for f in FEATURES), float(next(keep for end, keep in ends if b["at"] < end))))
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label double")


def fitted(spark: SparkSession, depth: int = 8):
    """The tree that Spark fits to the table: True or False, or (feature, threshold, tree up to it, tree beyond it)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled(spark)).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=2, seed=1).fit(table)

    def of(node) -> object:
        if node.subtreeDepth() == 0:
            return bool(node.prediction())
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), of(node.leftChild()), of(node.rightChild())

    return of(model._call_java("rootNode"))


def train(spark: SparkSession, depth: int = 8):
    """A function from a block's struct to a boolean column: the fitted tree as nested comparisons."""
    tree = fitted(spark, depth)

    def column(block: Column, t: object = tree) -> Column:
        if isinstance(t, bool):
            return F.lit(t)
        name, threshold, left, right = t
        return F.when(block[name] <= threshold, column(block, left)).otherwise(column(block, right))

    return column


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without html, with _text: the blocks of main text joined by line feeds, empty if there are none.

    A column named _text is replaced.

    White space inside a block is one blank, character references are decoded. Null and empty pages give an empty text;
    unclosed tags end with what surrounds them, an unclosed comment or script with the page; text without any tag is a
    block; rows that repeat are read alike, and other columns pass unread.
    """
    is_main = train(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html, "_text")]
    cut = with_blocks(pages.select(F.struct(*others).alias("_row"), F.col(html).alias("_html")), "_html")
    text = F.array_join(F.transform(F.filter("_blocks", lambda b: is_main(b)), lambda b: b["text"]), "\n")
    return cut.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c != html and c != "_text"], F.coalesce(text, F.lit("")).alias("_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
