"""Ranking, answers, stores, the ledger, files, plug-ins and streams on small fixtures."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import answers, ledger, plugins, ranking, reports, store, text_index, text_segments, vector_cells, vector_index
from lodeseek.operators.keyed_table import KeyedTable
from lodeseek.sources import files
from lodeseek.sources.shared import stored
from lodeseek.streaming import folds, indexing, tasks

HITS = "query_id int, chunk_id string, rank int"


def test_fusion(spark):
    text = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], HITS)
    vector = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], HITS)
    rows = ranking.rrf(text, vector, k=20).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c"]
    assert rows[0].score_rrf == pytest.approx(1 / 21 + 1 / 22, abs=1e-6)
    swapped = {r.chunk_id: r.score_rrf for r in ranking.rrf(vector, text, k=20).collect()}
    assert swapped == {r.chunk_id: r.score_rrf for r in rows}
    assert ranking.rrf(text.limit(0), vector.limit(0)).count() == 0


def test_rerank_keeps_all(spark):
    hits = spark.createDataFrame([(1, f"c{i}", i, "x y", "" if i == 2 else f"x {'y' * (i % 2)}") for i in range(1, 9)], "query_id int, chunk_id string, rank int, query string, content string")
    rows = ranking.rerank(hits, plugins.lexical_overlap, 3).orderBy("rank_rerank").collect()
    assert len(rows) == 8 and rows[-1].chunk_id == "c2" and sum(r.score_rerank > 0 for r in rows) == 3
    failing = ranking.rerank(hits, plugins.score_with(lambda: lambda q, t: 1 / 0), 3).orderBy("rank_rerank").collect()
    assert [r.rank for r in failing] == [1, 3, 4, 5, 6, 7, 8, 2] and all(r.score_rerank == 0 for r in failing)


def test_context_prompt_and_citations(spark):
    kind = "query_id int, chunk_id string, doc_id string, rank int, score double, content string, title_cn string, journal string, title string, heading_stack array<string>"
    hits = spark.createDataFrame([(1, "a", "d1", 1, 0.9, "x\ny" * 300, "T", "", "", ["1 A", "1.1 B"]), (1, "b", "d1", 2, 0.8, "", "", "", "", []), (1, "c", "d2", 3, 0.7, "short", "", "", "own", [])], kind)
    got = answers.context(hits).first()
    assert got.n_used == 2 and got.context.startswith("[1] 标题: 《T》 | 来源: 中国全科医学 | 章节: 1 A → 1.1 B\n    内容: x y") and got.context.endswith("...\n\n[2] own\n    内容: short")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query string")
    said = {r.query_id: r for r in answers.prompts(asked, answers.context(hits)).collect()}
    assert said[2].prompt is None and said[2].answer == "未找到相关文献" and said[1].prompt.endswith("：q")
    papers = spark.createDataFrame([("d2", "paper", "J")], "doc_id string, title_cn string, journal string")
    cited = answers.citations(hits, papers).orderBy("id").collect()
    assert [(r.doc_id, r.title, r.source) for r in cited] == [("d1", "T", "中国全科医学"), ("d2", "paper", "J")] and len(cited[0].snippet) == 203
    marked = answers.markers(spark.createDataFrame([(1, "see [1, 2] and [doc-7]"), (2, "none")], "query_id int, content string"))
    assert [(r.query_id, r.citation) for r in marked.orderBy("query_id", "pos").collect()] == [(1, 1), (1, 2), (1, 7), (2, None)]


def test_chinese_and_keyword_fields(spark):
    rows = spark.createDataFrame([(1, "高血压患者", "高血压"), (2, "糖尿病", "x"), (3, None, "高血压管理")], "chunk_id int, content string, keywords_cn string")
    asked = spark.createDataFrame([(9, "高血压")], "query_id int, query string")
    fields = {"content": "text", "keywords_cn": "keyword"}
    hits = text_index.bm25(asked, rows, fields, text_segments.build(rows, fields)).collect()
    assert [r.chunk_id for r in hits] == [1]


def test_cells_find_most(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.where("chunk_id < 30").withColumnRenamed("chunk_id", "query_id")
    exact = {(r.query_id, r.chunk_id) for r in vector_index.exact_top_k(asked, vectors, 10).collect()}
    cells = vector_cells.VectorCells(spark, str(tmp_path / "cells"))
    cells.create(vectors, 16)
    near = {(r.query_id, r.chunk_id) for r in cells.top_k(asked, 10, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9
    every = {(r.query_id, r.chunk_id) for r in cells.top_k(asked, 10, 16).collect()}
    assert every == exact
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [2.0, 0.0])], "chunk_id long, embedding array<float>")
    got = vector_index.exact_top_k(mixed.where("chunk_id in (1, 4)").withColumnRenamed("chunk_id", "query_id"), mixed, 2).collect()
    assert [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0, 1), (1, 7, 1.0, 2)]
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0])], "chunk_id int, embedding array<double>")
    assert [r.chunk_id for r in vector_index.wrong_dimension(bad, 2).orderBy("chunk_id").collect()] == [2, 3] and vector_index.prepared(bad).count() == 1


def test_hybrid_search_of_a_target(spark, tmp_path):
    from lodeseek.operators import search

    chunks = spark.createDataFrame([(1, "red apple pie", "en"), (2, "green apple", "fr"), (3, "blue sky over the sea", "en"), (4, None, "en")], "chunk_id long, content string, lang string")
    vectors = stored(plugins.embed(chunks, plugins.hashing_encoder), "vectors")
    asked = spark.createDataFrame([(7, "apple"), (8, "")], "query_id long, query string")
    of_queries = search.query_vectors(asked)
    assert sorted(r.query_id for r in of_queries.collect()) == [7, 8]  # that of 8 is zero, which finds nothing
    target = search.Target(text_segments.build(chunks, {"content": "text"}), chunks, vectors, {"content": "text"})
    got = search.hybrid(asked, of_queries, target).orderBy("rank").collect()
    assert {r.query_id for r in got} == {7} and [r.chunk_id for r in got if r.rank_text] == [2, 1] and len(got) == 3
    only = search.hybrid(asked, of_queries, target, {"lang": "en", "none": 1}).collect()
    assert {r.chunk_id for r in only} == {1, 3}
    cells = vector_cells.VectorCells(spark, str(tmp_path / "cells"))
    cells.create(vectors, 2)
    near = search.Target(target.index, chunks, None, target.fields, cells)
    assert [r.chunk_id for r in search.hybrid(asked, of_queries, near, n_probe=2).orderBy("rank").collect()] == [r.chunk_id for r in got]
    assert {r.chunk_id for r in search.hybrid(asked, of_queries, near, {"lang": "en"}, n_probe=2).collect()} == {1, 3}


def test_stores(spark, tmp_path):
    base = spark.createDataFrame([(1, 1, "old"), (2, 5, "kept")], "chunk_id int, version int, content string")
    new = spark.createDataFrame([(1, 1, "new"), (2, 4, "late"), (3, 1, "added"), (3, 1, "added")], base.schema)
    assert {r.chunk_id: r.content for r in store.upsert(base, new).collect()} == {1: "new", 2: "kept", 3: "added"}
    good, bad = store.split_valid(spark.createDataFrame([('{"k": 1}',), ("{",), (None,)], "j string"), "j", "k int")
    assert good.count() == 1 and bad.count() == 2


def test_exports_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("m1", "u1"), ("m2", ""), ("m3", None), ("m4", "u4")], "md5 string, uuid string")
    path = str(tmp_path / "out")
    counts = lambda df: {r.outcome: r.n for r in df.collect()}
    assert counts(store.export(rows.where("md5 < 'm4'"), path)) == {"uploaded": 1, "no_uuid": 2}
    assert counts(store.export(rows, path)) == {"uploaded": 1, "exists": 1, "no_uuid": 2}
    assert counts(store.export(rows, path)) == {"exists": 2, "no_uuid": 2}
    assert sorted((r.md5, r.uuid) for r in spark.read.json(path).collect()) == [("m1", "u1"), ("m4", "u4")]
    titles = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b")], "m string, t string").select(store.vector_title(F.col("m"), F.col("t")).alias("x"))
    assert [r.x for r in titles.collect()] == ["a", "b", "b"]


def test_quota_is_best_fit(spark):
    docs = spark.createDataFrame([("d", m, p) for m, p in [("a", 900), ("b", 500), ("c", 400), ("d", 600), ("e", 50)]], "quota_day string, md5 string, pages bigint")
    keys = spark.createDataFrame([("d", "k1", 1000), ("d", "k2", 1000)], "quota_day string, key string, remaining int")
    assert {r.md5: r.key for r in ledger.allocate(docs, keys).collect()} == {"a": "k1", "d": "k2", "b": None, "c": "k2", "e": "k1"}


def test_files_without_pages_count_as_one_page(spark):
    docs = spark.createDataFrame([("d", f"{i:03}", i % 2) for i in range(100)], "quota_day string, md5 string, pages bigint")
    keys = spark.createDataFrame([("d", "k1", 30)], "quota_day string, key string, remaining int")
    got = ledger.allocate(docs, keys).collect()
    assert len(got) == 100 and [r.md5 for r in sorted(got, key=lambda r: r.md5) if r.key] == [f"{i:03}" for i in range(30)]


def test_quota_gathers_only_what_may_fit(spark, monkeypatch):
    import random

    rng = random.Random(2)
    docs = [(d, f"{i:05}", rng.choice([1, 2, 3, 7, 40, 90, 200])) for d in ("d", "e", None) for i in range(1500)] + [("f", "x", 1), ("d", "none", None), ("d", "same", 7), ("d", "same", 7)]
    keys = [("d", "k1", 100), ("d", "k2", 60), ("e", "k1", 150), (None, "k1", 30), ("g", "k1", 5)]
    want = []
    for day in ("d", "e", None, "f"):
        left = {k: n for d, k, n in keys if d == day}
        for _, m, p in sorted((x for x in docs if x[0] == day), key=lambda x: (-(x[2] or 0), x[1])):
            best = min((k for k, r in left.items() if p and r >= p), key=lambda k: (left[k], k), default=None)
            if best:
                left[best] -= p
            want.append((day, m, p, best))
    files_of = spark.createDataFrame(docs, "quota_day string, md5 string, pages bigint")
    keys_of = spark.createDataFrame(keys, "quota_day string, key string, remaining int")
    out = ledger.allocate(files_of, keys_of)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    gathered = []
    plan = type(out.groupBy("quota_day").cogroup(keys_of.groupBy("quota_day")))
    monkeypatch.setattr(plan, "applyInPandas", lambda self, f, schema: gathered.append(self._gd1._df) or spark.createDataFrame([], schema))
    ledger.allocate(files_of, keys_of)
    assert gathered[0].groupBy("quota_day").count().agg(F.max("count")).first()[0] < 600


def test_batch_failures_are_of_rows(spark):
    from __spark_entry__ import oracle_sql, queries

    from .conftest import DATA
    from .helpers import assert_same

    rows = spark.createDataFrame([("b", "x"), ("b", "y"), ("b", "y"), ("c", "z"), ("d", "w")], "batch_id string, md5 string")
    errors = spark.createDataFrame([("b", "HTTP 1: 找不到任务"), ("b", "Token 过期"), ("b", "A quota"), ("c", "slow"), ("c", "token expired, not found"), ("e", "没有权限")], "batch_id string, message string")
    got = sorted(map(tuple, ledger.batch_failures(rows, errors).collect()))
    assert got == [("b", m, "failed", "HTTP 1: 找不到任务") for m in ("x", "y", "y")]
    assert_same(queries()["batch_failures"](spark, DATA), DATA, oracle_sql()["batch_failures"])
    assert queries()["quota_alloc"](spark, DATA).count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "json").mkdir()
    for n in ("a", "b"):
        (tmp_path / "pdf" / f"{n}.pdf").write_bytes(n.encode())
    (tmp_path / "json" / "a.json").write_text(json.dumps({"doi": "10.1", "title_cn": "题"}))
    there, lacking = files.paired(files.document_files(spark, str(tmp_path)), files.metadata_files(spark, str(tmp_path)))
    assert [(r.stem, r.doi, r.journal) for r in there.collect()] == [("a", "10.1", "")] and [r.stem for r in lacking.collect()] == ["b"]
    (tmp_path / "parsed" / "m1").mkdir(parents=True)
    (tmp_path / "parsed" / "m1" / "full.md").write_bytes("x\ny\xff".encode("latin-1"))
    (tmp_path / "parsed" / "m1" / "u-1_content_list_v2.json").write_text('[[{"type": "table"}]]')
    (tmp_path / "parsed" / "m2").mkdir()
    (tmp_path / "parsed" / "m2" / "other.txt").write_text("x")
    got = files.parsed_documents(spark, str(tmp_path / "parsed")).collect()
    assert len(got) == 1 and (got[0].md5, got[0].uuid, got[0].text[:3], got[0].pages[0][0].type) == ("m1", "u-1", "x\ny", "table"), got
    (tmp_path / "meta" / "m1").mkdir(parents=True)
    (tmp_path / "meta" / "m1" / "b.json").write_text(json.dumps({"doi": "10.2"}))
    (tmp_path / "meta" / "m1" / "a.json").write_text(json.dumps({"doi": "10.1", "journal": "J"}))
    assert [(r.md5, r.doi, r.journal) for r in files.parsed_documents(spark, str(tmp_path / "parsed"), str(tmp_path / "meta")).collect()] == [("m1", "10.1", "J")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f.json").write_text(json.dumps({"md5": "m", "uuid": "u", "chunks": [{"chunk_id": "1", "content": "x"}, {"chunk_id": "2"}]}))
    (tmp_path / "c" / ".checkpoint.json").write_text("{}")
    assert sorted(r.chunk_id for r in files.chunk_files(spark, str(tmp_path / "c")).collect()) == ["1", "2"]
    assert files.listing(spark, str(tmp_path / "parsed")).count() == 3
    log = spark.createDataFrame([(1, 1, 'data: {"t": "text", "c": "a"}'), (1, 2, "data: {"), (1, 3, ": ping"), (1, 4, 'data: {"k": 1}')], "message_id int, seq int, value string")
    assert [r.c for r in files.answer_events(log).collect()] == ["a"]


def test_bundle_members(spark):
    names = ["x/full.md", "images/a.png", "a.PNG", "b.bmp", "c.svg", "d.json", "sub/", "", "full.md", "e"]
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate(names)], "bundle string, seq int, path string")
    got = {(r.seq, r.name, r.kind, r.content_type) for r in files.bundle_members(rows).collect()}
    plain = "application/octet-stream"
    assert got == {
        (0, "full.md", "superseded", "text/markdown"), (1, "a.png", "image", "image/png"), (2, "a.PNG", "other", plain), (3, "b.bmp", "image", "image/bmp"),
        (4, "c.svg", "other", plain), (5, "d.json", "other", plain), (8, "full.md", "full_md", "text/markdown"), (9, "e", "other", plain),
    }


def test_paths_by_the_beginning_of_md5(spark):
    tasks = spark.createDataFrame([(1, "aa11", "b1", "p1"), (2, "aa22", "b1", "p2"), (3, None, None, "p3")], "id int, md5 string, batch_id string, raw_path string")
    objects = spark.createDataFrame([("zz/x.pdf",)], "path string")
    papers = spark.createDataFrame([(9, "zz")], "doc_id int, md5 string")
    wanted = spark.createDataFrame([("aa22",), ("aa2",), ("aa",), ("b1",), ("zz",), ("9",), ("3",), ("none",)], "key string")
    got = {r.key: (r.path, r.via) for r in ledger.resolve_paths(wanted, tasks, objects, papers).collect()}
    assert got == {"aa22": ("p2", "by_md5"), "aa2": ("p2", "by_prefix"), "aa": ("p1", "by_prefix"), "b1": ("p1", "by_batch_id"), "zz": ("zz/x.pdf", "by_object"), "9": ("zz/x.pdf", "by_paper"), "3": ("p3", "by_id"), "none": (None, None)}


def test_poll_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"data_id": "d1", "file_name": "f", "state": "done"}, {"data_id": "", "file_name": "f2", "state": "running"}, {"data_id": "d3"}, {"state": "done"}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    out, at = str(tmp_path / "out"), str(tmp_path / "cp")
    files.poll_stream(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination(120)
    assert sorted((r.data_id, r.state) for r in spark.read.parquet(out).collect()) == [("d1", "done"), ("f2", "running")]


def test_a_task_folder_must_be_shared():
    from types import SimpleNamespace

    from lodeseek.sources.shared import shared_dir

    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(unset)


def test_plugins(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, "a b")], "chunk_id int, content string")
    got = {r.chunk_id: r.embedding for r in plugins.embed(rows, plugins.hashing_encoder).collect()}
    assert sorted(got) == [1, 3] and got[1] == got[3] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5)
    asked = spark.createDataFrame([(1, "p"), (2, None)], "query_id int, prompt string")
    assert [r.answer for r in plugins.complete(asked, lambda: lambda ps: [p * 2 for p in ps]).collect()] == ["pp"]
    assert plugins.complete(asked, lambda: lambda ps: 1 / 0).first().answer.startswith("ZeroDivisionError")


def test_message_page_bounds(spark):
    rows = spark.createDataFrame([("c", i, dt.datetime(2024, 1, 1, 0, i)) for i in range(5)], "conv_id string, ord int, created_at timestamp")
    page = reports.message_page(rows, spark.createDataFrame([("c", "2024-01-01 00:03:00")], "conv_id string, before string"), 0).collect()
    assert [(r.ord, r.place) for r in page] == [(2, 1)]


T0 = dt.datetime(2024, 1, 1)
POLLS = [("a", "running", "", 0), ("a", "done", "", 60), ("a", "failed", "late", 90), ("b", "running", "", 0), ("c", "failed", "bad", 30), ("z", "running", "", 9000)]


def test_task_state_stream_is_its_batch_twin(spark, tmp_path):
    rows = [(m, s, e, T0 + dt.timedelta(seconds=t), i) for i, (m, s, e, t) in enumerate(POLLS)]
    events = spark.createDataFrame(rows, "md5 string, state string, err_msg string, ts timestamp, seq int")
    for i, part in enumerate((events.where("md5 <> 'z'"), events.where("md5 = 'z'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out: list = []
    q = tasks.task_state_stream(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: out.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.md5: (r.status, r.error_msg) for r in folds.task_states(events, now=T0 + dt.timedelta(seconds=8000)).collect()}
    assert {r.md5: (r.status, r.error_msg) for r in out} == {k: v for k, v in batch.items() if v[0] != "processing"}
    assert batch == {"a": ("parsed", None), "b": ("failed", "timeout"), "c": ("failed", "bad"), "z": ("processing", None)}


def test_continuous_indexing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"doc_id": "d1", "title": "one", "text": "# 1 A\nhello"}) + "\n" + json.dumps({"doc_id": "d2", "title": "two", "text": "x"}))
    run = lambda: indexing.start(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    (folder / "2.json").write_text(json.dumps({"doc_id": "d1", "title": "one", "text": "# 1 A\nnew text"}))
    run()
    found = {r.chunk_id: r.content for r in KeyedTable(spark, str(tmp_path / "out/chunks")).read().collect()}
    assert found["d1__L1__1"] == "【章节】1 A\n\nnew text" and found["d2__L1__body"] == "x" and len(found) == 4
    assert KeyedTable(spark, str(tmp_path / "out/vectors")).read().count() == 4
    index = text_segments.TextIndex(spark, str(tmp_path / "out/index"), indexing.FIELDS).open()
    words = {r.token for r in index.postings.collect()}
    assert "new" in words and "hello" not in words  # what the document had before is gone
    steps = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out/steps"))
    assert {(r.step, r.status) for r in steps.collect()} == {(s, "done") for s in ("chunking", "embedding", "es_write", "milvus", "ready")}


def test_phrases_of_several_words(spark):
    """Against a walk from left to right; parts of longer phrases, phrases that overlap, and odd rows."""
    import random

    from lodeseek.operators.phrases import occurrences

    rng, words = random.Random(6), list("abcde")
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(25)))) for i in range(60)] + [(98, None), (99, "")]
    given = {" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4]))) for _ in range(25)} - {"a", "b"}
    want = []
    for i, t in texts:
        at, w = 0, (t or "").split()
        while at < len(w):
            n = next((n for n in (4, 3, 2, 1) if at + n <= len(w) and " ".join(w[at : at + n]) in given), 0)
            if n:
                want.append((i, at, n, " ".join(w[at : at + n])))
            at += n or 1
    frame = spark.createDataFrame(texts, "id int, text string")
    phrases = spark.createDataFrame([(p,) for p in [*given, *list(given)[:3], "", None]] + [(next(iter(given)).upper(),)], "phrase string")
    assert sorted(map(tuple, occurrences(frame, phrases, "id").collect())) == sorted(want)
    assert occurrences(frame, phrases.limit(0), "id").collect() == [] and occurrences(frame.limit(0), phrases, "id").collect() == []
    asked = spark.createDataFrame([(1, "acute heart failure in adults"), (2, "heart"), (3, "lung")], "query_id int, query string")
    terms = spark.createDataFrame([("heart", "heart failure", "high"), ("heart", "heart", "low"), ("lung", "x", "high")], "domain string, term string, coverage string")
    assert {r.query_id: (r.domain, r.coverage) for r in plugins.coverage(asked, terms).collect()} == {1: ("heart", "high"), 2: ("heart", "low"), 3: ("", "out_of_domain")}
    synonyms = spark.createDataFrame([("heart failure", ["cardiac insufficiency"]), ("heart", ["cor"])], "phrase string, terms array<string>")
    assert {r.query_id: r.query for r in plugins.expanded(asked, synonyms).collect()} == {1: "acute heart failure in adults cardiac insufficiency", 2: "heart", 3: "lung"}


def test_text_hits_by_chunk_equal_those_by_posting(spark, monkeypatch):
    """Both ways give the same hits, in passes, with filters, ties and text ids; by chunk no postings are shuffled."""
    rows = [(f"c{i:03}", " ".join(f"w{i * k % 11}" for k in range(i % 13)), ["x", "y", ""][i % 3], i % 2) for i in range(200)] + [("d", None, None, 1)]
    rows = spark.createDataFrame(rows, "chunk_id string, content string, keywords_cn string, side int")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "x"), (3, "w3 nothing"), (4, "w0 w10 w5"), (5, "")], "query_id int, query string")
    fields = {"content": "text", "keywords_cn": "keyword"}
    index = text_segments.build(rows, fields)
    for options in ({}, {"k": 7}, {"filters": {"side": 1, "unknown": 2}}, {"must": "keywords_cn"}):
        monkeypatch.setattr(text_index, "FEW_POSTINGS", 10**9)
        want = sorted(map(tuple, text_index.bm25(asked, rows, fields, index, **options).collect()))
        monkeypatch.setattr(text_index, "FEW_POSTINGS", 0)
        for terms, cells in ((200_000, 250_000), (4, 30)):
            monkeypatch.setattr(text_index, "FEW_TERMS", terms)
            monkeypatch.setattr(text_index, "CELLS", cells)
            hits = text_index.bm25(asked, rows, fields, index, **options)
            assert sorted(map(tuple, hits.collect())) == want and want
    plan = text_index.bm25(asked, rows, fields, index)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan


def test_payload_is_of_shown_chunks_only(spark, tmp_path):
    """Chunks that no hit shows are left out before the join, and a hit without a chunk stays."""
    spark.range(5000).selectExpr("id as chunk_id", "repeat('x', id % 50) as content").write.parquet(str(tmp_path / "chunks"))
    spark.createDataFrame([(1, 3), (1, 7000), (2, 3)], "query_id long, chunk_id long").write.parquet(str(tmp_path / "hits"))
    out = ranking.with_payload(spark.read.parquet(str(tmp_path / "hits")), spark.read.parquet(str(tmp_path / "chunks")), ["content"])
    assert sorted((r.query_id, r.chunk_id, r.content) for r in out.collect()) == [(1, 3, "xxx"), (1, 7000, None), (2, 3, "xxx")]
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_phrases_in_passes_shuffle_no_text(spark, monkeypatch):
    """Several passes find what one does, and what a task looks up at once may end inside a batch; only phrases are shuffled."""
    from lodeseek.operators import phrases as module

    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 30)), f"w{i % 7} w{i * 2 % 7} w{i * 3 % 7}"[: 2 + 3 * (i % 3)]) for i in range(90)]
    frame = spark.createDataFrame(rows, "id int, text string, phrase string")
    once = module.occurrences(frame, frame, "id")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, once.collect()))
    monkeypatch.setattr(module, "PHRASES_A_PASS", 4)
    assert sorted(map(tuple, module.occurrences(frame, frame, "id").collect())) == want and len(want) > 100
    assert list(module._cuts(np.array([0, 999_999, 1_000_000, 3_000_000, 3_000_001]))) == [(0, 2), (2, 3), (3, 4)]


def test_a_catalogue_reads_one_level(spark, tmp_path):
    rows = [("m1", 1, "one", "j", "L0", "c"), ("m1", 1, "", "j", "L1", "d"), ("m2", 2, None, "j", "L0", "e"), ("m2", 2, "", "j", "L2", "f")]
    files.store_chunks(spark.createDataFrame(rows, "md5 string, doc_id int, title_cn string, journal string, level string, content string"), str(tmp_path / "c"))
    papers = files.chunk_catalogue(spark, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in papers.collect()) == [("m1", 1, "one", "j"), ("m2", 2, None, "j")]
    plan = papers._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "content" not in plan.split("ReadSchema")[1].split("\n")[0]
