"""Tables and indexes that follow upserts and deletions, against ones built anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import text_index, text_segments, vector_cells, vector_index
from lodeseek.operators.keyed_table import KeyedTable
from lodeseek.sources.snapshots import Snapshots, tail_to_merge

FIELDS = {"content": "text", "keywords_cn": "keyword"}
WORDS = [f"w{i}" for i in range(12)]


def _files(spark, snapshots):
    return {p["path"]: p["bytes"] for p in snapshots.parts()}


def test_sizes_of_parts_stay_geometric():
    sizes = []
    for _ in range(1000):
        sizes.append(1)
        at = tail_to_merge(sizes)
        sizes[at:] = [sum(sizes[at:])] if at < len(sizes) else []
        assert all(s >= 2 * sum(sizes[i + 1 :]) for i, s in enumerate(sizes))
    assert sum(sizes) == 1000 and len(sizes) <= 10
    assert tail_to_merge([]) == 0 and tail_to_merge([100, 1]) == 2 and tail_to_merge([100, 40, 20]) == 0


def test_a_killed_write_leaves_the_former_version(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "chunk_id long, version long, content string")
    assert table.upsert(rows) == 1
    with monkeypatch.context() as m:

        def killed(*a):
            raise KeyboardInterrupt

        m.setattr(Snapshots, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(rows.withColumn("content", F.lit("lost")))
    assert sorted(r.content for r in table.read().collect()) == ["a", "b"]
    assert table.upsert(rows.where("chunk_id = 2").withColumn("content", F.lit("kept"))) == 2
    assert sorted(r.content for r in table.read().collect()) == ["a", "kept"]
    assert sorted(r.content for r in table.read(1).collect()) == ["a", "b"]  # a reader keeps its version
    table.snapshots.clean(keep=1)
    assert len(list((tmp_path / "t" / "parts").iterdir())) == len(table.snapshots.parts())
    assert sorted(r.content for r in table.read().collect()) == ["a", "kept"]


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = Snapshots(spark, str(tmp_path / "s")), Snapshots(spark, str(tmp_path / "s"))
    assert a.commit([], 0) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        b.commit([{"path": "x/y", "bytes": 1}], 0)
    assert a.parts() == []


def test_keyed_table_is_a_dictionary(spark, tmp_path):
    """Random batches with versions, ties, repeated and null keys, deletions and merges."""
    rnd, table = random.Random(3), KeyedTable(spark, str(tmp_path / "t"))
    assert table.delete(spark.createDataFrame([(1,)], "chunk_id long")) == 0
    expected, largest = {}, None
    for batch in range(6):
        if batch in (2, 4):
            keys = [rnd.randrange(30) for _ in range(6)]
            table.delete(spark.createDataFrame([(k,) for k in [*keys, 999]], "chunk_id long"))
            for k in keys:
                expected.pop(k, None)
        else:
            rows = [(rnd.randrange(30), rnd.randrange(4), f"{batch}-{i}") for i in range(40 if not batch else 8)]
            table.upsert(spark.createDataFrame([*rows, (None, 9, "null")], "chunk_id long, version long, content string"))
            for k, v, c in rows:
                if k not in expected or v > expected[k][0]:
                    expected[k] = (v, batch)
                elif v == expected[k][0]:
                    expected[k] = (v, batch)
        got = {r.chunk_id: (r.version, int(r.content.split("-")[0])) for r in table.read().collect()}
        assert got == expected
        before = _files(spark, table.snapshots)
        largest = largest or next(iter(before))
        if batch > 3:
            table.merge()
            assert {r.chunk_id: (r.version, int(r.content.split("-")[0])) for r in table.read().collect()} == expected


def test_files_grow_with_what_is_written(spark, tmp_path, monkeypatch):
    from lodeseek.sources import snapshots

    monkeypatch.setattr(snapshots, "TASK_BYTES", 20_000)
    table = KeyedTable(spark, str(tmp_path / "t"), version="id")
    table.upsert(spark.range(20_000).select(F.col("id").alias("chunk_id"), "id", F.sha2(F.col("id").cast("string"), 256).alias("content")))
    large = len(list((tmp_path / "t" / "parts").glob("*/*.parquet")))
    table.upsert(spark.range(10).select(F.col("id").alias("chunk_id"), (F.col("id") + 1).alias("id"), F.lit("x").alias("content")))
    files = list((tmp_path / "t" / "parts").glob("*/*.parquet"))
    assert large > 20 and len(files) == large + 1  # ten rows are one file, and no other is touched
    assert table.read().where("content = 'x'").count() == 10 and table.read().count() == 20_000


def test_segments_equal_an_index_built_anew(spark, tmp_path):
    rnd = random.Random(7)
    index = text_segments.TextIndex(spark, str(tmp_path / "i"), FIELDS)
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w5"), (3, "nothing")], "query_id long, query string")
    schema, rows = "chunk_id long, content string, keywords_cn string", {}
    for batch in range(6):
        new = {rnd.randrange(40): (" ".join(rnd.choices(WORDS, k=rnd.randrange(12))) or None, rnd.choice(["w5", "", None])) for _ in range(40 if not batch else 5)}
        gone = [rnd.randrange(45) for _ in range(4)] if batch else []
        upserts = spark.createDataFrame([(k, *v) for k, v in new.items()] + [(None, "w1", "w5")], schema)
        before = _files(spark, index.snapshots)
        if batch == 3:
            index.apply(deleted=spark.createDataFrame([(g,) for g in gone], "chunk_id long"))
            new = {}
        else:
            index.apply(upserts, spark.createDataFrame([(g,) for g in gone], "chunk_id long") if gone else None)
        assert before.items() <= _files(spark, index.snapshots).items()  # a batch writes its own segment only
        rows = {k: v for k, v in rows.items() if k not in gone} | new
        if batch in (2, 5):
            index.merge()
        if batch not in (1, 3, 5):
            continue
        chunks = spark.createDataFrame([(k, *v) for k, v in rows.items()], schema)
        anew = text_segments.build(chunks, FIELDS, str(tmp_path / f"anew{batch}"))
        ours = index.open()
        for part, order in (("postings", ["field", "token", "chunk_id"]), ("frequencies", ["field", "token"]), ("lengths", ["field"])):
            a, b = (getattr(x, part).select(sorted(getattr(x, part).columns)).orderBy(*order).collect() for x in (ours, anew))
            assert a == b, part
        hits = [text_index.bm25(asked, chunks, FIELDS, x).orderBy("query_id", "rank").collect() for x in (ours, anew)]
        assert hits[0] == hits[1] and hits[0]
    assert len(index.snapshots.parts()) < 6


def test_segments_of_nothing(spark, tmp_path):
    index = text_segments.TextIndex(spark, str(tmp_path / "i"), FIELDS)
    with pytest.raises(ValueError):
        index.open()
    assert index.apply() == 0
    index.apply(spark.createDataFrame([], "chunk_id long, content string, keywords_cn string"))
    assert index.open().postings.count() == 0
    index.apply(spark.createDataFrame([(1, "w1", None)], "chunk_id long, content string, keywords_cn string"))
    index.apply(deleted=spark.createDataFrame([(1,), (1,), (None,)], "chunk_id long"))
    assert index.open().postings.count() == 0 and index.open().frequencies.count() == 0 and index.open().lengths.count() == 0


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


def test_cells_in_folders(spark, tmp_path):
    """A third of the vectors are one vector, and a cell of many is split; files that are read grow with the probed cells."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(900, 8)) + 6 * np.eye(8)[rng.integers(0, 8, 900)], np.tile(rng.normal(size=8), (450, 1))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)] + [(5000, None), (5001, [0.0] * 8), (5002, [1.0])], "chunk_id long, embedding array<double>")
    asked = vectors.where("chunk_id % 150 = 0 or chunk_id > 4000").withColumnRenamed("chunk_id", "query_id")
    cells = vector_cells.VectorCells(spark, str(tmp_path / "c"))
    cells.create(vectors, 6, leaf_rows=120)
    leaves = cells._leaves()
    assert len({c for c, _, _ in leaves}) == 6 < len(leaves)
    exact = _rows(vector_index.exact_top_k(asked.where("query_id <> 5002"), vectors, 15))
    assert _rows(cells.top_k(asked, 15, len(leaves))) == exact
    one, sizes = asked.where("query_id = 150"), []
    for n in (1, 3, len(leaves)):
        before = cells._alive
        probed = {}
        cells._alive = lambda parts, c=None, i=None: probed.update(cells=c, leaves=i) or before(parts, c, i)
        cells.top_k(one, 15, n)
        cells._alive = before
        files = before(cells.snapshots.parts(), probed["cells"], probed["leaves"]).select("_metadata.file_path", "_metadata.file_size").distinct().collect()
        assert all(f"cell={c}" in "".join(f.file_path for f in files) for c in probed["cells"])
        sizes.append(sum(f.file_size for f in files))
    assert sizes[0] < sizes[1] < sizes[2]

    changed = vectors.where("chunk_id between 100 and 130").withColumn("embedding", F.transform("embedding", lambda x: -x))
    cells.apply(changed.union(spark.createDataFrame([(9000, points[3].tolist()), (8, None)], "chunk_id long, embedding array<double>")))
    cells.apply(deleted=spark.createDataFrame([(150,), (901,), (77777,)], "chunk_id long"))
    now = vectors.where("not chunk_id between 100 and 130 and chunk_id not in (8, 150, 901)").union(changed).union(spark.createDataFrame([(9000, points[3].tolist())], "chunk_id long, embedding array<double>"))
    exact = _rows(vector_index.exact_top_k(asked.where("query_id <> 5002"), now, 15))
    assert _rows(cells.top_k(asked, 15, len(leaves))) == exact
    files = {p["path"] for p in cells.snapshots.parts()}
    cells.apply(deleted=spark.createDataFrame([(150,)], "chunk_id long"))
    assert files < {p["path"] for p in cells.snapshots.parts()}
    cells.merge()
    assert len(cells.snapshots.parts()) < 4 and _rows(cells.top_k(asked, 15, len(leaves))) == exact


def test_small_parts_keep_what_comes_before_in_its_tasks(spark, tmp_path, monkeypatch):
    """A small result of a large aggregation is written by one task, which doesn't also do the aggregation."""
    from pyspark.sql.readwriter import DataFrameWriter

    from lodeseek.sources import snapshots

    plans, write = [], DataFrameWriter.parquet

    def noted(self, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    out = snapshots.write_sorted(spark.range(1000).groupBy((F.col("id") % 10).alias("chunk_id")).count(), str(tmp_path / "p"), 1, "chunk_id")
    assert [r.chunk_id for r in out.collect()] == list(range(10)) and len(list((tmp_path / "p").glob("part-*"))) == 1
    text_segments.build(spark.range(20).selectExpr("id as chunk_id", "'a b' as content", "'k' as keywords_cn"), FIELDS, str(tmp_path / "i"))
    assert len(plans) > 5 and not [p for p in plans if "Coalesce" in p]


def test_a_build_shuffles_no_texts(spark, tmp_path, monkeypatch):
    """Words are counted by the tasks that read texts; only ids that stand twice make rows move; postings by token come when they are asked for."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def noted(self, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    rows = spark.range(0, 40, 1, 4).selectExpr("id as chunk_id", "concat('b a B ', 'w', id % 7) as content", "if(id % 2 = 0, 'k k', '') as keywords_cn")
    rows = rows.unionByName(spark.createDataFrame([(90, None, None), (None, "a", "k")], "chunk_id long, content string, keywords_cn string"))
    index = text_segments.TextIndex(spark, str(tmp_path / "i"), FIELDS)
    index.apply(rows)
    counted = [p for p in plans if "MapInArrow" in p]
    assert counted and not [p for p in counted if "Exchange" in p]
    assert len(list((tmp_path / "i/parts").glob("*/words/part-*"))) == 1 and not list((tmp_path / "i/parts").glob("*/postings*"))  # the small files of many tasks become one
    found = sorted(map(tuple, index.open().postings.collect()))
    assert len(found) == 3 * 40 + 20 and ("content", "b", 3, 2, 4) in found and ("keywords_cn", "k k", 4, 1, 1) in found
    assert index.sort_postings() == 2 and index.sort_postings() is None
    assert sorted(map(tuple, index.open().postings.collect())) == found and [r.token for r in index.open().postings.collect()] == sorted(f[1] for f in found)
    twice = rows.unionByName(rows.selectExpr("chunk_id", "'a' as content", "'z' as keywords_cn"))  # of two the greater counts
    assert sorted(map(tuple, text_segments.build(twice.where("chunk_id < 40"), FIELDS, str(tmp_path / "j")).postings.collect())) == found
