"""Lines of Markdown to elements: headings, paragraphs, captions, tables, footnotes and equations, for a whole corpus.

Blocks that run over several lines are found inside each row: every line is one letter, and a pattern cuts the string
of letters. Everything else is running windows over a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# The patterns that tell what a line is, in order of priority.
SKIP = "(?U)^(扫描二维码|©\\s|基金项目|引用本文|\\[)"
EQUATION, DETAILS, DETAILS_END = "^\\$\\$", "^<details>", "^</details>"
TABLE, TABLE_END = "(?U)^<table[>\\s]", "(?i)</table>"
IMAGE = "^!\\[.*\\]\\(.+\\)"
HEADING = "(?U)^#{1,4}\\s*(\\d+(?:\\.\\d+)*)\\s+(.+)$"
CAPTION = "(?U)^表\\s*(\\d+)\\s*(.*?)$"
CAPTION_EN = "(?Ui)^Table\\s*(\\d+)\\s*(.*?)$"
SUBHEADING = "(?U)^(\\d{1,2}(?:\\.\\d{1,2})+)\\s+([一-鿿][一-鿿\\w\\s]*)[：:。]?$"
FOOTNOTE = "(?U)^注[：:]\\s*(.*)"
REFERENCES = ["(?U)表\\s*(\\d+)\\s*[、，,和&及与]\\s*表?\\s*(\\d+)", "(?U)表\\s*(\\d+)\\s*[～~\\-—]\\s*表?\\s*(\\d+)", "(?U)表\\s*(\\d+)", "(?Ui)Table\\s*(\\d+)"]
SEGMENTS = "T|t[a-z]*(?:[A-Z]|$)|[eE][^eE]*(?:[eE]|$)|[dD][^zZ]*(?:[zZ]|$)|."
DEEPEST = 4


def _letter(line: Column) -> Column:
    kind = F.when(line.rlike(EQUATION), "e").when(line.rlike(DETAILS), "d").when(line.rlike(DETAILS_END), "z").when(line.rlike(TABLE), "t").otherwise("x")
    return F.when(line.rlike(TABLE_END), F.upper(kind)).otherwise(kind)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, raw, line, seg, block, kind): seg numbers the blocks, block is their kind t, e, d, or x outside."""
    raw = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("doc_id", raw.alias("_raw"), F.transform(raw, strip).alias("_line"))
    rows = rows.withColumn("_segs", F.regexp_extract_all(F.array_join(F.transform("_line", _letter), ""), F.lit(SEGMENTS), F.lit(0)))
    each = F.flatten(F.transform("_segs", lambda s, i: F.transform(F.sequence(F.lit(1), F.length(s)), lambda _: F.struct(i.alias("seg"), F.lower(F.substring(s, 1, 1)).alias("block")))))
    rows = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("_raw").alias("raw"), F.col("_line").alias("line"), each.alias("s"))).alias("ord", "v"))
    block = F.when(F.col("v.s.block").isin("t", "e", "d"), F.col("v.s.block")).otherwise("x")
    out = rows.select("doc_id", "ord", F.col("v.raw").alias("raw"), F.col("v.line").alias("line"), F.col("v.s.seg").alias("seg"), block.alias("block"))
    x = F.col("line")
    kind = (
        F.when(F.col("block") == "t", "table").when(F.col("block") == "e", "equation").when(F.col("block") == "d", "details").when(x == "", "blank").when(x.rlike(SKIP), "skip").when(x.rlike(IMAGE), "image")
        .when(x.rlike(HEADING), "heading").when(x.rlike(CAPTION), "caption").when(x.rlike(CAPTION_EN), "caption_en").when(x.rlike(SUBHEADING), "subheading").when(x.rlike(FOOTNOTE), "footnote").otherwise("text")
    )
    return out.withColumn("kind", kind)


def _number(digits: Column) -> Column:
    """An integer of digits of either width; null if there are too many."""
    return F.translate(digits, "０１２３４５６７８９", "0123456789").try_cast("int")


def elements(docs: DataFrame) -> DataFrame:
    """(doc_id, at, type, text, number, number_str, depth, html) ordered by at within a document.

    A paragraph stands where it ends: at the line that closes it. A footnote counts only directly after a caption or
    table, else it is text. Null and empty texts have no elements; documents are told apart by doc_id.
    """
    rows = lines(docs)
    by_line = Window.partitionBy("doc_id").orderBy("ord")
    before, upto = by_line.rowsBetween(Window.unboundedPreceding, -1), by_line.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)  # from the end, as a frame that ends there is gone through anew for each row
    opens = F.lag("seg").over(by_line).isNull() | (F.lag("seg").over(by_line) != F.col("seg"))
    rows = rows.withColumn("_opens", opens)
    kind = F.col("kind")
    event = F.when(kind.isin("text", "footnote"), "text").when(kind.isin("heading", "subheading"), "heading").when(kind.isin("caption", "caption_en", "table", "equation"), kind)
    rows = rows.withColumn("_event", event)
    after_table = F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit("")).isin("caption", "caption_en", "table") & (kind == "footnote")
    rows = rows.withColumn("_flush", kind.isin("blank", "heading", "subheading", "caption") | (kind.isin("table", "equation", "details") & F.col("_opens")) | after_table)
    # a paragraph that a blank or a details block closes is the last element, even after an English caption
    held = F.coalesce(F.max(F.when(F.col("_event") == "text", F.col("ord"))).over(before), F.lit(-1)) > F.coalesce(F.max(F.when(F.col("_flush"), F.col("ord"))).over(before), F.lit(-1))
    rows = rows.withColumn("_event", F.when(kind.isin("blank", "details") & held, "text").otherwise(F.col("_event")))
    after_table = F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit("")).isin("caption", "caption_en", "table") & (kind == "footnote")
    rows = rows.withColumn("kind", F.when((kind == "footnote") & ~after_table, "text").otherwise(kind))
    rows = rows.withColumn("_flush", F.col("kind").isin("blank", "heading", "subheading", "caption", "footnote") | (F.col("kind").isin("table", "equation", "details") & F.col("_opens")))
    rows = rows.withColumn("_para", F.sum(F.col("_flush").cast("int")).over(upto)).withColumn("_end", F.min(F.when(F.col("_flush"), F.col("ord"))).over(after))

    # one group for each element, in the partitioning of the windows: a paragraph, a block, or a line of its own
    kind = F.col("kind")
    in_block = kind.isin("table", "equation")
    of = F.when(kind == "text", "p").when(in_block, "b").otherwise("s")
    rows = rows.where(kind.isin("text", "table", "equation", "heading", "subheading", "caption", "caption_en", "footnote"))
    rows = rows.withColumns({"_of": of, "_n": F.when(kind == "text", F.col("_para")).when(in_block, F.col("seg").cast("long")).otherwise(F.col("ord").cast("long"))})
    shown = F.struct("ord", F.when(in_block, F.col("raw")).otherwise(F.col("line")).alias("x"))
    found = rows.groupBy("doc_id", "_of", "_n").agg(F.array_sort(F.collect_list(shown)).alias("xs"), F.first("kind").alias("kind"), F.min("_end").alias("_end"))
    in_block = kind.isin("table", "equation")
    plain = F.transform("xs", lambda v: v["x"])
    found = found.withColumn("x", F.when(in_block, F.array_join(plain, "\n")).otherwise(F.array_join(plain, " ")))
    x = F.col("x")
    found = found.withColumn("x", F.when(in_block & ~((kind == "table") & (F.size("xs") == 1) & x.rlike(TABLE_END)), strip(x)).when(kind == "text", strip(x)).otherwise(x)).where("x <> ''")
    part = lambda p, g: F.regexp_extract(x, p, g)
    is_heading, is_sub, is_en = kind == "heading", kind == "subheading", kind == "caption_en"
    found = found.withColumn("num", F.when(is_heading, part(HEADING, 1)).when(is_sub, part(SUBHEADING, 1)))
    found = found.withColumn("no", _number(F.when(is_en, part(CAPTION_EN, 1)).when(kind == "caption", part(CAPTION, 1))))
    title = strip(F.when(is_heading, part(HEADING, 2)).otherwise(part(SUBHEADING, 2)))
    rest = strip(F.when(is_en, part(CAPTION_EN, 2)).otherwise(part(CAPTION, 2)))
    label = F.concat(F.when(is_en, "Table ").otherwise("表"), F.col("no").cast("string"), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))
    text = F.when(is_heading | is_sub, F.concat("num", F.lit(" "), title)).when(kind == "footnote", F.concat(F.lit("注："), strip(part(FOOTNOTE, 1)))).when(kind.isin("caption", "caption_en"), label).otherwise(x)
    at = F.when(kind == "text", F.struct(F.coalesce("_end", F.lit(2**31 - 1)).alias("ord"), F.lit(0).alias("after"))).otherwise(F.struct(F.col("xs")[0]["ord"].alias("ord"), F.lit(1).alias("after")))
    return found.select(
        "doc_id", at.alias("at"), F.when(is_sub, "heading").when(kind == "text", "paragraph").otherwise(kind).alias("type"), text.alias("text"), F.col("no").alias("number"),
        F.col("num").alias("number_str"), F.when(is_heading | is_sub, F.least(F.size(F.split("num", "\\.")), F.lit(DEEPEST))).alias("depth"), F.when(kind == "table", x).alias("html"),
    )


def with_path(found: DataFrame) -> DataFrame:
    """elements with heading_stack: the headings above each, a heading itself included.

    One running last value for each depth; a slot holds only if it was set after every shallower heading.
    """
    upto = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    slots = [F.last(F.when(F.col("depth") == d, F.struct("at", "text")), ignorenulls=True).over(upto) for d in range(1, DEEPEST + 1)]
    out = found.withColumns({f"_s{d}": s for d, s in enumerate(slots, 1)})
    shown = []
    for d in range(1, DEEPEST + 1):
        shallower = [F.col(f"_s{k}.at") for k in range(1, d)]
        fresh = F.lit(True)
        for s in shallower:
            fresh = fresh & (s.isNull() | (F.col(f"_s{d}.at") > s))
        shown.append(F.when(F.col(f"_s{d}").isNotNull() & fresh, F.col(f"_s{d}.text")))
    return out.withColumn("heading_stack", F.filter(F.array(*shown), lambda x: x.isNotNull())).drop(*[f"_s{d}" for d in range(1, DEEPEST + 1)])


def table_references(text: Column) -> Column:
    """Sorted numbers of the tables that a text names; a range gives its end points only."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, groups in zip(REFERENCES, ((1, 2), (1, 2), (1,), (1,)), strict=True) for g in groups]
    numbers = F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(*found), _number), lambda n: n.isNotNull())))
    return F.when(text.isNull() | text.contains("表") | text.rlike("(?i)table"), numbers).otherwise(F.array().cast("array<int>"))  # most texts name none
