"""Rules of lines, elements and chunks, one small document each, and folds against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text
from lodeseek.functions.text import strip
from lodeseek.operators import chunks, lines

CASES = {
    "headings": ("# 1 One\n## 1.2 Two\n#### 1.2.3.4.5 Deep\n# Title\n##### 9 No", [("heading", "1 One"), ("heading", "1.2 Two"), ("heading", "1.2.3.4.5 Deep"), ("paragraph", "# Title ##### 9 No")]),
    "subheading": ("3.2.1 优秀级：\n3.2 分析", [("heading", "3.2.1 优秀级"), ("heading", "3.2 分析")]),
    "across_image": ("a\n![x](y)\n[1] ref\n© 2020\nb\n\nc", [("paragraph", "a b"), ("paragraph", "c")]),
    "english_caption": ("a\nTable 1 rest\nb", [("caption_en", "Table 1 rest"), ("paragraph", "a b")]),
    "one_line_table": ("a\n<table><tr></tr></table>\nb", [("paragraph", "a"), ("table", "<table><tr></tr></table>"), ("paragraph", "b")]),
    "long_table": ("<table >\n# 1 x\n</TABLE> end\nb", [("table", "<table >\n# 1 x\n</TABLE> end"), ("paragraph", "b")]),
    "open_table": ("a\n<table>\nrow", [("paragraph", "a"), ("table", "<table>\nrow")]),
    "equation": ("a\n$$\nx\n$$\nb", [("paragraph", "a"), ("equation", "$$\nx\n$$"), ("paragraph", "b")]),
    "one_line_equation": ("$$ x $$\nlost\n$$ y\nb", [("equation", "$$ x $$\nlost\n$$ y"), ("paragraph", "b")]),
    "details": ("a\n<details>\nx\n</details>\nb", [("paragraph", "a"), ("paragraph", "b")]),
    "open_details": ("a\n<details> x </details>\nlost", [("paragraph", "a")]),
    "footnote": ("表 2 cap\n注: one\n注：two", [("caption", "表2 cap"), ("footnote", "注：one"), ("paragraph", "注：two")]),
    "footnote_after_text": ("a\n注：x", [("paragraph", "a 注：x")]),
    "footnote_after_english": ("Table 3\n注：x", [("caption_en", "Table 3"), ("footnote", "注：x")]),
    "quirk": ("a\nTable 3\n\n注：x", [("caption_en", "Table 3"), ("paragraph", "a"), ("paragraph", "注：x")]),
    "blanks": ("　\t \n 　a　\nb\t", [("paragraph", "a b")]),
    "digits": ("表１ x", [("caption", "表1 x")]),
    "empty": ("", []),
}


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_elements(spark):
    found = lines.elements(_docs(spark, [(k, t) for k, (t, _) in CASES.items()] + [("null", None)])).orderBy("doc_id", "at").collect()
    got = {k: [(r.type, r.text) for r in found if r.doc_id == k] for k in CASES}
    assert got == {k: v for k, (_, v) in CASES.items()}


def test_depths_and_paths(spark):
    docs = _docs(spark, [("d", "x\n# 1 A\na\n## 1.1 B\nb\n#### 1.1.1.1 C\nc\n## 1.2 D\nd\n# 2 E\ne\n### 2.1.1 F\nf")])
    rows = lines.with_path(lines.elements(docs)).where("type = 'paragraph'").orderBy("at").collect()
    assert [(r.text, r.heading_stack) for r in rows] == [("x", []), ("a", ["1 A"]), ("b", ["1 A", "1.1 B"]), ("c", ["1 A", "1.1 B", "1.1.1.1 C"]), ("d", ["1 A", "1.2 D"]), ("e", ["2 E"]), ("f", ["2 E", "2.1.1 F"])]


@pytest.mark.parametrize(("said", "refs"), [("见表2、3、5", [2, 3]), ("表2～5", [2, 5]), ("(表 7)", [7]), ("see table 4 and Table 4", [4]), ("none", []), ("表2和表3", [2, 3])])
def test_table_references(spark, said, refs):
    assert spark.range(1).select(lines.table_references(F.lit(said)).alias("r")).first().r == refs


def test_tables(spark):
    docs = _docs(spark, [("d", "<table>lost</table>\n# 1 A\n见表1\n\n表1 first\nTable 1 en\n<table>x</table>\n注：n\n# 2 B\n表2 no html\n表1 again\n<table><tr>y</tr></table>\n表0 zero\n见表 1")])
    rows = {r.table_number: r for r in chunks.tables(lines.elements(docs)).collect()}
    assert sorted(rows) == [0, 1, 2]
    assert (rows[1].caption, rows[1].caption_en, rows[1].html, rows[1].footnote) == ("表1 again", None, "<table><tr>y</tr></table>", None)
    assert rows[1].heading_stack == ["1 A"] and rows[1].conclusions == ["见表1", "见表 1"]
    assert rows[0].heading_stack == [] and rows[2].heading_stack == ["2 B"]


def test_side_footnotes(spark):
    kind = "doc_id string, pages array<array<struct<type:string,content:struct<table_caption:array<struct<content:string>>,table_footnote:array<struct<content:string>>>>>>"
    cap, note = lambda *t: [(x,) for x in t], lambda *t: [(x,) for x in t]
    pages = [[("table", (cap("表1 a", "表2 b"), note(" one ", "two"))), ("text", (cap("表3"), note("x")))], [("table", (cap("表1"), note("later"))), ("table", (cap("表4"), note(" ")))]]
    side = spark.createDataFrame([("d", pages)], kind)
    docs = _docs(spark, [("d", "表1 a\n注：own\n# 1 h\n表2 b")])
    rows = {r.table_number: r.footnote for r in chunks.tables(lines.elements(docs), side).collect()}
    assert rows == {1: "注：own", 2: "one two"}


def test_section_chunks(spark):
    a, b, c = "a" * 1500, "b" * 600 + "表3", "c" * 2500
    docs = _docs(spark, [("d", f"intro\n# 1 A\n{a}\n\n{b}\n\n{c}\n# 1 A\nagain 表9")])
    rows = {r.chunk_id: r for r in chunks.section_chunks(lines.elements(docs)).collect()}
    assert sorted(rows) == ["d__L1__1", "d__L1__1_p1", "d__L1__1_p2", "d__L1__1_p3", "d__L1__body"]
    assert rows["d__L1__body"].content == "intro" and rows["d__L1__1"].content == f"【章节】1 A\n\n{a}"
    assert rows["d__L1__1"].refers_to_tables == [3] and rows["d__L1__1_p2"].content.endswith(c)
    strict = {r.chunk_id: r.refers_to_tables for r in chunks.section_chunks(lines.elements(docs), strict_refs=True).collect()}
    assert strict["d__L1__1"] == [] and strict["d__L1__1_p1"] == [3]


def test_packing_is_the_plain_fold(spark):
    rng = random.Random(1)
    rows = [(s, i, "x" * rng.choice([0, 1, 3, 7, 18, 19, 20, 21, 30])) for s in range(60) for i in range(rng.randrange(1, 12))]
    got = {(r.s, r.at): r.part for r in chunks.pack(spark.createDataFrame(rows, "s int, at int, text string"), ["s"], 20).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        held, part = [], 0
        for _, i, t in sorted(r for r in rows if r[0] == s):
            if held and len("\n\n".join([*held, t])) > 20:
                held, part = [], part + 1
            held.append(t)
            want[s, i] = part
    assert got == want


def test_segments_are_the_plain_fold(spark):
    rng = random.Random(2)
    kinds = ["a", "$$", "<details>", "</details>", "<table>", "x</table>", "<table></table>", ""]
    docs = [(str(i), "\n".join(rng.choice(kinds) for _ in range(rng.randrange(1, 30)))) for i in range(200)]
    got = {}
    for r in lines.lines(_docs(spark, docs)).collect():
        got.setdefault(r.doc_id, {})[r.ord] = r.block
    for d, t in docs:
        state, want = "x", []
        for line in t.split("\n"):
            if state == "x":
                state = "e" if line.startswith("$$") else "d" if line.startswith("<details>") else "t" if re.match(r"<table[>\s]", line) else "x"
                want.append(state)
                if state == "t" and "</table>" in line:
                    state = "x"
            else:
                want.append(state)
                if (state == "t" and "</table>" in line) or (state == "e" and line.startswith("$$")) or (state == "d" and line.startswith("</details>")):
                    state = "x"
        assert [got[d][i] for i in range(len(want))] == want


def test_whole_documents(spark):
    rows = [("p1", "# 1 A\n见表1\n\n表1 t\n<table><tr></tr></table>", "题", "摘", "一；二,三", "10.1"), ("p2", "", "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, title_cn string, abstract_cn string, keywords_cn string, doi string")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in chunks.META if c not in docs.columns})
    out = {r.chunk_id: r for r in chunks.chunk_documents(docs).collect()}
    assert sorted(out) == ["p1__L0", "p1__L1__1", "p1__L2__table_1", "p2__L0"]
    assert out["p1__L0"].content == "【标题】题\n\n【摘要】摘\n\n【关键词】一；二,三" and out["p1__L0"].keywords_cn == ["一", "二", "三"]
    assert out["p1__L2__table_1"].content == "【章节】1 A\n\n【作者结论】见表1\n\n【表1 t】" and out["p1__L1__1"].metadata.title_cn == "题"
    generic = docs.select("doc_id", "text", F.lit("file").alias("title"))
    assert {r.chunk_id: r.content for r in chunks.chunk_documents(generic, form="generic").collect()}["p1__L0"] == "file\n\n1 A\n\n见表1"
    ids = spark.createDataFrame([("0123456789", ""), ("ab", "x")], "md5 string, article_id string")
    assert [r.doc_id for r in chunks.document_ids(ids).collect()] == ["01234567", "x"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(text.tokens(F.lit("Ab 高血压x1 病"))) == ["ab", "高血", "血压", "x1", "病"]
    assert one(text.keywords(F.lit("a; b，；c,"))) == ["a", "b", "c"] and one(text.keywords(F.lit(None).cast("string"))) == []
    assert one(text.strip(F.lit("　 a b\t"))) == "a b" and one(text.cut(F.lit("abcd"), 3)) == "abc..."
    assert (one(text.stem(F.lit("/x/a.b.pdf"))), one(text.extension(F.lit("/x/A.PDF"))), one(text.slug(F.lit(" My-Kb ")))) == ("a.b", "pdf", "my_kb")


def test_packing_is_greedy_and_linear(spark):
    """Against a fold, on random sections; and a section of very many paragraphs in work that grows with their number."""
    import random
    import time

    rng = random.Random(4)
    rows = [(d, at, "x" * rng.choice([0, 1, 5, 30, 200])) for d in range(20) for at in range(rng.randrange(40))]
    want = {}
    for d in range(20):
        part, used = -1, 0
        for _, at, text in sorted(r for r in rows if r[0] == d):
            new = part < 0 or used + 2 + len(text) > 100
            part, used = (part + 1, len(text)) if new else (part, used + 2 + len(text))
            want[d, at] = part
    frame = spark.createDataFrame(rows, "doc_id int, at int, text string")
    assert {(r.doc_id, r.at): r.part for r in chunks.pack(frame, ["doc_id"], 100).collect()} == want

    def seconds(n):
        began = time.process_time()
        parts = chunks._parts([n % 700 for n in range(n)], 2000)
        assert len(parts) == n and (parts[1:] >= parts[:-1]).all()
        return time.process_time() - began

    seconds(1000)
    assert seconds(1_000_000) < 5
    assert chunks._parts([], 100).tolist() == [] and chunks._parts([500], 100).tolist() == [0]


def test_elements_look_back_only(spark):
    """No window frame that ends at the last row, which is gone through anew for each row; stripping sees every Unicode blank."""
    docs = spark.createDataFrame([(1, "# 1 A\nx\n y \n\nz"), (2, "only"), (3, "a\nb\n# 1.1 B\n\n")], "doc_id int, text string")
    found = lines.elements(docs)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    assert [(r.doc_id, r.text) for r in found.orderBy("doc_id", "at").collect()] == [(1, "1 A"), (1, "x y"), (1, "z"), (2, "only"), (3, "a b"), (3, "1.1 B")]
    given = ["a", "ab\r", " a b", "a\u3000", "\u00a0", "", None, "a\u2028", "\u2028b c", "a\nb", "é x\t", "a é"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").orderBy("i").select(strip(F.col("t")).alias("t")).collect()]
    assert got == ["a", "ab", "a b", "a", "", "", None, "a", "b c", "a\nb", "é x", "a é"]


def test_references_are_searched_in_texts_that_may_have_them(spark):
    given = ["TABLE 3 and tAbLe４", "见表2、5", "no number", "", None, "the tab le 7"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", lines.table_references(F.col("t")).alias("refs"))
    assert [r.refs for r in rows.orderBy("i").collect()] == [[3, 4], [2, 5], [], [], None, []]
    assert "Contains(" in rows._jdf.queryExecution().optimizedPlan().toString()
