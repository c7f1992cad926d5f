"""Streams with state against their batch twins: shuffled micro-batches, repeated events, restarts."""

import datetime as dt
import os
import random
import time

from lodeseek.operators.keyed_table import KeyedTable
from lodeseek.sources import poll
from lodeseek.streaming import folds, states, tasks

T0 = dt.datetime(2024, 1, 1)
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))


def _put(spark, path, n, rows, schema):
    """The rows as the n-th file that the stream finds; one a micro-batch."""
    path.mkdir(exist_ok=True)
    part = spark.createDataFrame(rows, schema).toJSON().collect()
    (path / f"{n:03d}.json").write_text("\n".join(part))
    os.utime(path / f"{n:03d}.json", (1.7e9 + n, 1.7e9 + n))  # files come by time


def _run(stream, checkpoint, each):
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(checkpoint)).foreachBatch(each).trigger(availableNow=True).start()
    ended = q.awaitTermination(120)
    q.stop()
    assert ended and q.exception() is None


ANSWERS = "message_id string, seq long, ts timestamp, t string, k string, s string, c string, message string"


def _answer(rnd, name, n, end):
    rows = []
    for i in range(n):
        t = rnd.choice(["text", "text", "step", "cite"])
        rows.append((name, i, T0 + dt.timedelta(seconds=i), t, f"k{i % 3}" if t == "step" else None, rnd.choice(["running", "done"]) if t == "step" else None, f"w{i} " if t == "text" else None, None))
    if end:
        rows.append((name, n, T0 + dt.timedelta(seconds=n), end, None, None, None, "broken" if end == "error" else None))
    return rows


def test_answers_as_a_stream(spark, tmp_path):
    rnd = random.Random(11)
    rows = [r for i, end in enumerate(["done", "error", None, "done"]) for r in _answer(rnd, f"m{i}", 12, end)]
    rows = [r for r in rows if (r[0], r[1]) != ("m3", 5)]  # a gap, which the timer closes
    rnd.shuffle(rows)
    rows += rows[:6]
    batch = {r.message_id: r for r in folds.answers(spark.createDataFrame(rows, ANSWERS).dropDuplicates(["message_id", "seq"])).collect()}
    parts, found, upto = [rows[i::4] for i in range(4)], {}, {}

    def each(df, n):
        for r in df.collect():
            assert not found.get(r.message_id) or not found[r.message_id].closed
            found[r.message_id] = r

    for n in range(2):
        _put(spark, tmp_path / "in", n, parts[n], ANSWERS)
    _run(states.answer_stream(_source(spark, tmp_path / "in", ANSWERS)), tmp_path / "cp", each)
    seen = parts[0] + parts[1]
    for m, r in found.items():  # what came without a gap
        seqs = {x[1] for x in seen if x[0] == m}
        upto[m] = next(i for i in range(99) if i not in seqs)
        assert r.content == "".join(x[6] for x in sorted({x for x in seen if x[0] == m and x[1] < upto[m] and x[3] == "text"}, key=lambda x: x[1])) and not r.closed
    for n in range(2, 4):
        _put(spark, tmp_path / "in", n, parts[n], ANSWERS)
    _run(states.answer_stream(_source(spark, tmp_path / "in", ANSWERS)), tmp_path / "cp", each)  # a restart
    show = lambda r: (r.content, r.steps, r.n_citations, r.status, r.error)
    for m in ("m0", "m1", "m2"):
        assert show(found[m]) == show(batch[m]) and not found[m].closed
    assert found["m3"].content != batch["m3"].content  # events wait beyond the gap
    late = [("z", 0, T0 + dt.timedelta(hours=2), "text", None, None, "later", None)]
    _put(spark, tmp_path / "in", 4, late, ANSWERS)
    _put(spark, tmp_path / "in", 5, [("z", 1, T0 + dt.timedelta(hours=2), "text", None, None, "!", None)], ANSWERS)
    _run(states.answer_stream(_source(spark, tmp_path / "in", ANSWERS)), tmp_path / "cp", each)
    assert {m: show(found[m]) for m in batch} == {m: show(r) for m, r in batch.items()} and all(found[m].closed for m in batch)
    assert found["z"].content == "later!"


CHANGES = "seq long, kb_id string, type string, doc_id long, doc struct<name: string, n: double>"


def test_changes_as_a_stream(spark, tmp_path):
    rnd = random.Random(13)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice(["doc_update", "doc_update", "doc_deleted"]), rnd.randrange(6), (f"n{i}", i / 3)) for i in range(60)]
    rows = [(s, kb, t, d, None if t == "doc_deleted" else doc) for s, kb, t, d, doc in rows]
    rnd.shuffle(rows)
    table, so_far, tombstones = KeyedTable(spark, str(tmp_path / "t"), ["kb_id", "doc_id"], "seq"), [], []
    apply = states.keep_documents(table)

    def each(df, n):
        tombstones.extend(df.where("deleted").collect())
        apply(df, n)
        apply(df, n)  # a micro-batch that runs again

    spark.conf.set(NO_DATA, "false")  # or micro-batches without data follow each other for ever, as the time to live is in processing time
    for n in range(3):  # each a restart
        _put(spark, tmp_path / "in", n, rows[n::3], CHANGES)
        so_far.extend(rows[n::3])
        _run(states.change_stream(folds.for_subscribers(_source(spark, tmp_path / "in", CHANGES))), tmp_path / "cp", each)
        ours = {(r.kb_id, r.doc_id): (r.seq, r.doc.name, r.doc.n) for r in table.read().collect()}
        twin = folds.documents(folds.for_subscribers(spark.createDataFrame(so_far, CHANGES)))
        assert ours == {(r.kb_id, r.doc_id): (r.seq, r.doc.name, r.doc.n) for r in twin.collect()}
    spark.conf.unset(NO_DATA)
    assert tombstones and all(r.doc is None for r in tombstones)


STEPS = "doc_id long, step string, status string, ts timestamp, seq long"


def test_steps_beside_a_ledger(spark, tmp_path):
    rnd = random.Random(17)
    rows = [(rnd.randrange(5), rnd.choice(["mineru", "chunking", "es_write"]), rnd.choice(["running", "done", "failed"]), T0 + dt.timedelta(seconds=rnd.randrange(500)), i) for i in range(80)]
    old, new = rows[:40], rows[40:]
    new = [(d, s, st, ts + dt.timedelta(seconds=200), i) for d, s, st, ts, i in new]  # some events are older than the ledger's
    ledger = folds.step_states(spark.createDataFrame(old, STEPS))
    state = {r.doc_id: r.steps for r in ledger.collect()}
    start = lambda: states.step_stream(_source(spark, tmp_path / "in", STEPS), ledger)
    each = lambda df, n: state.update({r.doc_id: r.steps for r in df.collect()})
    _put(spark, tmp_path / "in", 0, new[:20] + new[:5], STEPS)
    _run(start(), tmp_path / "cp", each)
    _put(spark, tmp_path / "in", 1, new[20:], STEPS)
    _run(start(), tmp_path / "cp", each)  # a restart goes on from its own state
    expected = {r.doc_id: r.steps for r in folds.step_states(spark.createDataFrame(old + new, STEPS)).collect()}
    assert state == expected
    alone = {}
    _run(states.step_stream(_source(spark, tmp_path / "in", STEPS)), tmp_path / "cp2", lambda df, n: alone.update({r.doc_id: r.steps for r in df.collect()}))
    assert alone == {r.doc_id: r.steps for r in folds.step_states(spark.createDataFrame(new, STEPS)).collect()}


def test_polled_results_come_once(spark, tmp_path):
    """A restart in the middle of a micro-batch reads what was noted, and the service isn't asked again."""
    service = tmp_path / "service"
    service.mkdir()
    (service / "batches.json").write_text('["x", "y", "z"]')
    seen, fail = {}, [False]

    def each(df, n):
        rows = sorted((r.md5, r.state, r.err_msg or "", r.seq) for r in df.collect())
        if fail[0]:
            seen[f"lost {n}"] = rows
            raise RuntimeError("killed")
        seen[n] = rows

    def run():
        rows = poll.polled(spark, "tests.fake_service:Service", str(tmp_path / "log"), folder=str(service), batchesPerTask=2, seconds=0)
        q = rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(each).trigger(availableNow=True).start()
        try:
            q.awaitTermination(100)
        except Exception as e:
            assert "killed" in str(e)
        q.stop()

    asked = lambda: [int((service / f"asked-{b}").read_text()) for b in "xyz"]
    run()
    assert len(seen) == 1 and len(seen[0]) == 6 and asked() == [1, 1, 1]
    assert [p.name for p in sorted((tmp_path / "log").glob("*/group*"))] == ["group-000000.json", "group-000001.json"]
    fail[0] = True
    run()
    lost = seen.pop("lost 1")
    assert asked() == [2, 2, 2] and len(lost) == 6
    fail[0] = False
    run()
    assert seen[1] == lost  # the same rows
    rows = [r for n in seen for r in seen[n]]
    assert len(rows) == len(set(rows)) and {r[3] for r in rows} == set(range(1, max(asked()) + 1))
    assert all((f"{b}-b", "failed", "bad", 2) in lost for b in "xyz")


def test_late_rows_are_counted(spark, tmp_path):
    rng = random.Random(23)
    schema = "md5 string, state string, err_msg string, ts timestamp, seq long"
    parts = [[(f"t{rng.randrange(4)}", "running", "", T0 + dt.timedelta(minutes=10 * n + rng.randrange(-25, 10), seconds=rng.randrange(60)), 100 * n + i) for i in range(30)] for n in range(4)]
    late = tasks.LateRows()
    spark.streams.addListener(late)
    try:
        for n, part in enumerate(parts):
            _put(spark, tmp_path / "in", n, part, schema)
        q = tasks.task_state_stream(_source(spark, tmp_path / "in", schema), delay="10 minutes").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).format("noop").trigger(availableNow=True).start()
        assert q.awaitTermination(200)
        for _ in range(100):
            if late.upto(str(q.runId)) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(late)
    rows = [(*r, n) for n, part in enumerate(parts) for r in part]
    twin = {r.batch: r.n_late for r in folds.late_rows(spark.createDataFrame(rows, schema + ", batch long"), 600).collect()}
    assert sum(twin.values()) > 5 and {r.batch: r.n_late for r in late.table(spark).groupBy("batch").sum("n_late").withColumnRenamed("sum(n_late)", "n_late").collect()} == twin


def test_updates_reach_who_listens(spark, tmp_path):
    """Two streams under two watermarks against the batch join, and that against a loop."""
    rng = random.Random(29)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    updates = [(rng.choice(["a", "a", "b", None]), i, at(10 * i + rng.randrange(10)), f"d{i % 7}") for i in range(90)]
    spans = []
    for i in range(12):
        kb, begin, end = rng.choice("ab"), rng.randrange(600), 0
        end = begin + rng.randrange(1, 400)
        spans += [(f"s{i}", kb, at(x), at(min(x + 60, end))) for x in range(begin, end, 60)]
    spans += [("s0", None, at(0), at(50)), (None, "a", at(0), at(50)), ("s1", "a", at(50), at(50))]
    u_schema, s_schema = "kb_id string, seq long, ts timestamp, doc_id string", "session_id string, kb_id string, from_ts timestamp, to_ts timestamp"
    want = sorted((s, *u) for u in updates for s, kb, a, b in spans if s and kb and kb == u[0] and a <= u[2] < b)
    batch = folds.delivered(spark.createDataFrame(updates, u_schema), spark.createDataFrame(spans, s_schema))
    assert sorted(map(tuple, batch.collect())) == want and len(want) > 30
    found = []
    updates.sort(key=lambda r: r[2])
    spans.sort(key=lambda r: r[3])
    for n in range(3):
        cut = lambda rows, column, n=n: rng.sample(part := [r for r in rows if at(330 * n) <= r[column] < at(330 * (n + 1)) or n == 2 and r[column] >= at(990)], len(part))
        _put(spark, tmp_path / "u", n, cut(updates, 2), u_schema)
        _put(spark, tmp_path / "s", n, cut(spans, 3), s_schema)
        stream = folds.delivered(_source(spark, tmp_path / "u", u_schema), _source(spark, tmp_path / "s", s_schema), late="10 minutes")
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, n: found.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    assert sorted(found) == want
