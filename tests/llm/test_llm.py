"""Each operator against brute force, a round trip, planted cases or held-out labels, and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import ann, chat_format, components, decontam, html_extract, lm_scoring, mixing, near_dedup, queries, substring_dedup, token_rollup, toxicity
from lodeseek.llm.shared import new_path
from lodeseek.llm.wordbytes import words_of

from ..conftest import DATA
from ..helpers import assert_same

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = "wörd " * 30_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: null ids and texts, empty and very long ones, ties and repeated rows
ODD = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (4, LONG, None, "s", 1), (5, "\n\n\n", "en", None, 3), (6, LONG, "de", "s", 2)]


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in ("class_id", "_row", "key", "rep", "size", "digest")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(queries.queries()[name](spark, DATA), DATA, queries.oracle_sql()[name])


def test_words(spark):
    texts = ["", "Ab-c 9x_é!", None, "tail", "ß"]
    data = "".join(t or "" for t in texts).encode()
    offsets = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    w = words_of(np.frombuffer(data, np.uint8), offsets)
    assert [data[s:e].lower().decode() for s, e in zip(w.starts, w.ends)] == ["ab", "c", "9x", "é", "tail", "ß"]
    assert list(w.first) == [0, 0, 4, 4, 5, 6] and len(set(w.hashes)) == 6


# 1


def test_toxicity_on_held_out_labels(spark):
    rows = queries.queries()["op1_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_on_odd_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (4, 0, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, labels.limit(0)) is None
    out = toxicity.score(odd, None)
    assert out.count() == len(ODD) and out.columns[: len(odd.columns)] == odd.columns
    model = toxicity.Model(b"you fool ", b"good day ", (1.0,) * len(toxicity.FEATURES), -1.0)
    rated = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert rated[1]._n_windows == 0 and rated[1]._score == pytest.approx(1 / (1 + math.e)) and rated[4]._score == rated[6]._score
    assert toxicity.without_toxic(odd.limit(0), labels).count() == 0


def test_long_labelled_texts_are_learned_from(spark):
    rng = random.Random(8)
    plain = [sentence(rng, 1) for _ in range(300)]
    rude = ["blasted", "rotten", "vermin", "scoundrel"]

    def text(bad):
        return " ".join(rng.choice(rude) if bad and rng.random() < 0.2 else rng.choice(plain) for _ in range(6000))

    rows = [(i, text(i % 2), i % 2) for i in range(60)]
    assert min(len(t) for _, t, _ in rows) > toxicity.LONGEST
    docs = spark.createDataFrame([r[:2] for r in rows] + [rows[1][:2]] * 5, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all((r._score >= 0.5) == (r.doc_id % 2 == 1) for r in got) and len(got) == 65


# 2


def test_rollup_is_the_sum_of_current_documents(spark):
    store = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    rng, docs = random.Random(3), {}
    for batch in range(4):
        rows = []
        for seq in range(30):
            d, op = rng.randrange(12), rng.choice(["insert", "delete", "revise", "other"])
            row = (seq, op, d, rng.choice(["s", None]), rng.choice(["en", "de"]), "v", rng.randrange(100))
            rows.append(row)
            if op == "delete":
                docs.pop(d, None)
            elif op != "other":
                docs[d] = row[3:]
        rows += [(99, "insert", None, "s", "en", "v", 5), (99, None, 1, "s", "en", "v", 5)]
        changes = spark.createDataFrame(rows, token_rollup.CHANGES).withColumns({c: F.lit(1) for c in ("extra", "to", "bucket", "n_docs")})
        assert store.apply(f"b{batch}", changes) and not store.apply(f"b{batch}", changes)
        want = Counter()
        for s, lang, v, n in docs.values():
            want[s, lang, v, "docs"] += 1
            want[s, lang, v, "tokens"] += n
        got = Counter()
        for r in store.totals().collect():
            got[r.source, r.lang, r.version, "docs"], got[r.source, r.lang, r.version, "tokens"] = r.n_docs, r.n_tokens
        assert +got == +want
        if batch == 2:
            store.compact()
            assert not store.apply("b0", changes) and not store.apply("b2", changes)
    assert store.apply("none", changes.limit(0)) and not store.apply("none", changes)
    spark.createDataFrame([(1,)], "n long").write.parquet(f"{store.path}/sums/batch=broken")  # a batch without its marker
    assert +got == +Counter({(r.source, r.lang, r.version, k): v for r in store.totals().collect() for k, v in (("docs", r.n_docs), ("tokens", r.n_tokens))})


def test_rollup_merges_by_itself_and_survives_a_death(spark, monkeypatch):
    store = token_rollup.TokenRollup(spark, new_path(spark, "rollup"))
    change = lambda i, n: spark.createDataFrame([(i, "insert", d, "s", "en", "v", n) for d in (1, 2)], token_rollup.CHANGES)
    monkeypatch.setattr(token_rollup, "MANY_BATCHES", 3)
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    for i in range(4):
        assert store.apply(f"b{i}", change(i, i + 1)) and not store.apply(f"b{i}", change(i, 99))
    spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert len(store._parts()[0]) == 1 and [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 2, 8)]
    with monkeypatch.context() as m:

        def dies(*a):
            raise KeyboardInterrupt

        m.setattr(token_rollup.TokenRollup, "_mark", dies)
        with pytest.raises(KeyboardInterrupt):
            store.compact()
    assert [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 2, 8)]
    store.compact()
    store.compact()
    assert store._parts()[1] == [] and [tuple(r) for r in store.totals().collect()] == [("s", "en", "v", 2, 8)] and not store.apply("b0", change(9, 99))


def test_token_counts_are_of_whole_texts(spark, odd):
    import base64
    from pathlib import Path

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(token_rollup.TOKENIZER).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in token_rollup.with_bpe_tokens(odd).collect():
        t = next(x[1] for x in ODD if x[0] == r.doc_id)
        assert r.n_tokens == (len(encoding.encode_ordinary(t)) if t else 0)


# 3


def without_earlier_windows(docs, window):
    """By strings, clause by clause: id -> (text without what earlier windows have, removed stretches)."""
    seen, out = set(), {}
    for i, t in docs:
        clauses, at = [], 0
        for part in re.findall(r"[^.,;:!?\n]*[.,;:!?\n]+|[^.,;:!?\n]+$", t):
            w = [(m[0].lower(), at + m.start(), at + m.end()) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), part))]
            at += len(part)
            if w:
                clauses.append(w)
        gone = []
        for k in range(len(clauses)):
            w = []
            for c in clauses[k:]:
                w += c
                if len(w) >= window:
                    said = " ".join(x[0] for x in w)
                    if said in seen:
                        gone.append((w[0][1], w[-1][2]))
                    seen.add(said)
                    break
        spans = []
        for start, stop in gone:
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(stop, spans[-1][1])
            else:
                spans.append([start, stop])
        for s in spans:
            s[1] += len(re.match(r"[^\n0-9A-Za-z\x80-\U0010ffff]*", t[s[1] :])[0])
            s[1] += t[s[1] : s[1] + 1] == "\n" and (s[0] == 0 or t[s[0] - 1] == "\n")
        kept, last = "", 0
        for start, stop in spans:
            kept, last = kept + t[last:start], stop
        out[i] = (kept + t[last:], [(start, stop - start) for start, stop in spans])
    return out


def test_substring_dedup_is_brute_force(spark):
    rng = random.Random(4)
    passages = [", ".join(sentence(rng, n).capitalize() for n in (6, 9, 3, 8)) for _ in range(5)]
    lines = [sentence(rng, n) for n in (1, 3, 8, 15, 25, 40) for _ in range(3)]
    docs = []
    for i in range(60):
        parts = [rng.choice(lines) + rng.choice(["", ".", " !"]) for _ in range(rng.randrange(0, 9))]
        if i % 2:  # a passage that begins and ends inside other sentences, over the end of a line
            parts.insert(rng.randrange(len(parts) + 1), f"é own{i} start {rng.choice(passages)}.\n{rng.choice(passages)} end{i}")
        docs.append((i, "\n".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (substring_dedup.WINDOW, 8):
        got = {r.doc_id: (r.text, [(s.start, s.length) for s in r._removed]) for r in substring_dedup.dedup(df, window=window).collect()}
        assert got == without_earlier_windows(docs, window) and sum(len(x[1]) for x in got.values()) > 20


def test_passages_inside_lines_go_and_short_lines_stay(spark):
    rng = random.Random(14)
    passage = ". ".join(sentence(rng, 9) for _ in range(6))  # 54 words
    short = sentence(rng, 20) + "."
    docs = [(i, f"{sentence(rng, 40)} {passage if i < 3 else sentence(rng, 30)} {sentence(rng, 20)}\n{short}") for i in range(6)]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r._removed} == {1, 2} and all(r.text.endswith(short) for r in got.values())
    wide = "".join(chr(0x4E00 + i * 7) + ("，" if i % 9 == 8 else "") for i in range(120))
    got = {r.doc_id: r.text for r in substring_dedup.dedup(spark.createDataFrame([(1, f"甲{wide}乙。"), (2, f"丙丁{wide}戊。")], "doc_id long, text string")).collect()}
    assert got[1] == f"甲{wide}乙。" and len(got[2]) < 40


def test_substring_dedup_on_odd_tables(spark, odd):
    for df in (odd, odd.withColumn("_removed", F.lit("own")).withColumn("_text", F.lit(1))):
        out = substring_dedup.without_repeats(df)
        assert out.columns == df.columns and out.count() == len(ODD)
        texts = [(r.doc_id, r.text) for r in out.collect()]
        assert (1, None) in texts and (2, "") in texts and texts.count((3, "a b")) == 2 and (4, LONG) in texts and (6, "") in texts
        assert substring_dedup.without_repeats(df.limit(0)).count() == 0
    assert {r._removed for r in out.collect()} == {"own"}
    lines = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "A b, c d e f\nz")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substring_dedup.without_repeats(lines, unit="line", window=5).collect()} == {1: "a b c d e f\nx", 2: "z"}


# 4


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["<", "\\", "\\b", "\\l", "</turn>\n", "<part>", "<turn>", "é\U0001f600", "\n", "x", "<image:1>", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "a<b\\n\nc", None]), "".join(rng.choice(bits) for _ in range(6)) or None) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(df.select("conv_id", "turn", "role", F.array(part).alias("parts"), F.lit(1).alias("ord")))).collect()}
    for c in range(40):
        own = sorted((t, r or "", x or "") for cc, t, r, x in rows if cc == c)
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].loss_text == "".join(x for _, r, x in own if r == "assistant")


def test_chat_parts(spark):
    kind = "conv_id long, turn long, role string, parts " + chat_format.PARTS
    parts = [("text", "see <b>", None, None), ("image", None, "i.png", None), ("audio", None, "a.wav", 7), (None, "tail", None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("document", None, "d.pdf", None)]), (1, 2, "user", None), (None, None, None, [])]
    got = {r.conv_id: r for r in chat_format.formatted(spark.createDataFrame(rows, kind)).collect()}
    assert got[1].formatted == "<turn>user\nsee \\lb><part><image:1><part><audio:2><part>tail</turn>\n<turn>assistant\n<document:3></turn>\n<turn>user\n</turn>\n"
    assert [(a.number, a.ref, a.n_tokens) for a in got[1].attachments] == [(1, "i.png", 256), (2, "a.wav", 7), (3, "d.pdf", 512)] and got[1].n_tokens == 3 + 256 + 7 + 512
    assert got[None].formatted == "<turn>\n</turn>\n"
    rows = spark.createDataFrame([(1, 1, "assistant", [("text", "a <b>", None, None), ("image", None, "i", None), ("text", "<image:1>", None, None)])], kind)
    back = chat_format.read_back(chat_format.formatted(rows)).first()
    assert back.loss_text == "a <b><image:1>" and [(t.text, t.media) for t in back.turns] == [("a <b><image:1>", ["<image:1>"])]
    assert chat_format.read_back(chat_format.formatted(rows.limit(0))).count() == 0
    long = spark.createDataFrame([(1, t, "assistant", [("text", LONG, None, None)]) for t in range(3)], kind)
    assert chat_format.read_back(chat_format.formatted(long)).first().loss_text == 3 * LONG


# 5


def test_lm_scores_are_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, sentence(rng, rng.randrange(0, 40)), i % 3 == 0) for i in range(80)] + [(99, None, False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, target boolean").withColumn("text", F.coalesce("text", F.lit("")))
    size = 32
    known = lm_scoring.vocabulary(df, size)
    table = lm_scoring.loss_differences(lm_scoring.bigram_counts(df.select("text", "target"), known, size), size)
    got = {r.doc_id: r for r in lm_scoring.score(df, known, table, size=size).collect()}
    all_words = Counter(w for _, t, _ in docs for w in words(t))
    digest = {w: int(words_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hashes.view(np.int64)[0]) for w in all_words}
    vocab = set(sorted(all_words, key=lambda w: (-all_words[w], digest[w]))[: size - 2])
    ids = lambda t: ["<s>", *(w if w in vocab else "?" for w in words(t))]
    symbols = ["<s>", "?", *vocab]

    def model(texts):
        pairs, one = Counter(), Counter()
        for t in texts:
            x = ids(t)
            pairs.update(zip(x, x[1:]))
            one.update(x[1:])
        before, total = Counter(), sum(one[s] + 1 for s in symbols)
        for (a, _), n in pairs.items():
            before[a] += n
        w = lm_scoring.WEIGHT
        return lambda a, b: math.log((w * pairs[a, b] / before[a] + (1 - w) * (one[b] + 1) / total) if before[a] else (one[b] + 1) / total)

    good, every = model([t for _, t, y in docs if y]), model([t for _, t, _ in docs])
    for i, t, _ in docs:
        x = ids(t)
        want = sum(every(a, b) - good(a, b) for a, b in zip(x, x[1:]))
        assert got[i].n_tokens == len(x) - 1 and got[i].loss_difference == pytest.approx(want, abs=1e-3)
        assert (got[i].score is None) == (len(x) == 1)
    empty = lm_scoring.bigram_counts(df.limit(0).select("text", "target"), lm_scoring.vocabulary(df.limit(0), size), size)
    assert np.allclose(lm_scoring.loss_differences(empty, size), 0)


def test_lm_scores_of_every_word_are_brute_force(spark):
    rng = random.Random(16)
    docs = [(i, sentence(rng, rng.randrange(0, 40)), i % 3 == 0) for i in range(80)] + [(99, "", False), (None, "tail one", True), (7, "again", False)]
    docs += [(200 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60)), i % 2 == 0) for i in range(60)]  # over 2,046 words
    docs += [(300, "w1 rarea w2", True), (301, "w1 rareb w2", False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, target boolean").repartition(3)
    vocab = {w for _, t, _ in docs for w in words(t)}
    assert len(vocab) > lm_scoring.VOCABULARY

    def model(texts):
        pairs, one = Counter(), Counter()
        for t in texts:
            x = ["<s>", *words(t)]
            pairs.update(zip(x, x[1:]))
            one.update(x[1:])
        before, total, w = Counter(), sum(one.values()) + len(vocab), lm_scoring.WEIGHT
        for (a, _), n in pairs.items():
            before[a] += n
        return lambda a, b: math.log((w * pairs[a, b] / before[a] + (1 - w) * (one[b] + 1) / total) if before[a] else (one[b] + 1) / total)

    good, every = model([t for _, t, y in docs if y]), model([t for _, t, _ in docs])
    want = []
    for i, t, _ in docs:
        x = ["<s>", *words(t)]
        want.append((i or -1, len(x) - 1, pytest.approx(sum(every(a, b) - good(a, b) for a, b in zip(x, x[1:])), abs=1e-6)))
    for hot, cells in ((lm_scoring.HOT, lm_scoring.CELLS), (10, 500), (0, 500)):
        got = lm_scoring.score_all(df, hot, cells).collect()
        rows = sorted((r.doc_id or -1, r.n_tokens, r.loss_difference) for r in got)
        assert len(rows) == len(want) and all(a == b for a, b in zip(rows, sorted(want, key=lambda r: r[:2])))
        of = {r.doc_id: r for r in got}
        assert of[300].loss_difference != of[301].loss_difference and of[99].score is None
    assert lm_scoring.score_all(df.limit(0)).count() == 0


# 6


def test_nearest_have_recall(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0")
    want = ann.brute_force(v, q, 20)
    for options in ({}, {"block_rows": 150}, {"exact": True}):
        got: dict = {}
        for r in ann.nearest(v, q, 20, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        hit = sum(len({i for i, _ in got[k]} & {i for i, _ in x}) for k, x in want.items())
        assert hit / sum(map(len, want.values())) >= (1 if options.get("exact") else 0.9) and all(len(x) == 20 for x in got.values())
        assert all(dict(want[k])[i] == pytest.approx(s, abs=1e-12) for k, x in got.items() for i, s in x if i in dict(want[k]))


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "norms apart", "two dimensions"])
def test_a_whole_block_has_recall_and_lists_few_rows(kind):
    rng = np.random.default_rng(5)
    n, dim = ann.BLOCK_ROWS, 2 if kind == "two dimensions" else 64
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.2 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms apart":
        x *= rng.exponential(1, size=(n, 1))
    block, q = ann.Block(np.arange(n), x, float(np.linalg.norm(x, axis=1).max())), np.arange(0, n, n // 40)
    listed, whole = 0, block.listed

    def counted(lo, hi):
        nonlocal listed
        rows = whole(lo, hi)
        listed += len(rows)
        return rows

    block.listed = counted
    found = list(block.search(q, x[q], 20))
    hit = sum(len(set(a[1]) & set(e[1])) for a, e in zip(found, block.search(q, x[q], 20, exact=True)))
    assert hit / (20 * len(q)) >= 0.9
    if kind in ("clustered", "two dimensions"):
        assert listed < 0.4 * len(q) * n * ann.PROJECTIONS


def test_nearest_on_odd_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 2.0]), (8, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(v, v.where("vec_id in (0, 4)"), 20).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 3, 8, 1.0)]
    assert ann.nearest(v.limit(0), v, 3).count() == 0


# 7


def test_decontamination_is_brute_force(spark):
    rng = random.Random(7)
    items = {i: sentence(rng, rng.choice([1, 3, 9, 10, 11, 30])) for i in range(25)} | {90: None, 91: "", 92: "..."}
    items[93] = items[0]
    items[94] = " ".join(items[i] for i in (1, 2, 3))
    docs = {}
    for d in range(80):
        bits = [sentence(rng, rng.randrange(0, 12)) for _ in range(3)]
        for k in rng.sample(sorted(items), 2):
            w = (items[k] or "").split()
            a = rng.randrange(len(w) + 1)
            bits.insert(1, " ".join(w[a : a + rng.choice([5, 9, 10, 20])]).upper())
        docs[d] = ", ".join(bits)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = decontam.brute_force(docs, items)
    for block_words in (2_000_000, 40):
        got = {r.doc_id: r for r in decontam.scan(df, bench, block_words=block_words).collect()}
        for d, (n, hit, found, digest) in want.items():
            assert (got[d]._n_words, got[d]._n_hit, len(got[d]._items)) == (n, hit, found)
            assert hashlib.sha256(",".join(got[d]._items).encode()).hexdigest() == digest
    cut = {r.doc_id: r.text for r in decontam.decontaminate(df, bench, max_coverage=1.0).collect()}
    assert all(cut[d] == docs[d] for d, x in want.items() if not x[1])
    # what is left has the words that weren't hit
    assert all(len(words(cut[d])) == x[0] - x[1] for d, x in want.items())


def test_decontamination_on_odd_tables(spark, odd):
    bench = spark.createDataFrame([(1, "a b"), (None, "a b"), (2, None)], "item_id long, text string")
    got = decontam.scan(odd, bench)
    assert got.count() == len(ODD) and {r.doc_id: r._n_hit for r in got.collect()}[3] == 2
    clashing = odd.withColumns({"_items": F.lit("own"), "_n_hit": F.lit(7), "_spans": F.lit(None)})
    for df in (odd, clashing):
        out = decontam.decontaminate(df, bench)
        assert out.columns == df.columns and out.count() == len(ODD) - 3  # the rows that are an item go
    assert {(r._items, r._n_hit) for r in out.collect()} == {("own", 7)} and decontam.scan(clashing, bench).where("_n_hit = 2").count() == 3
    assert decontam.scan(odd, bench.limit(0)).where("_n_hit > 0").count() == 0 and decontam.scan(odd.limit(0), bench).count() == 0


# 8


def test_mix_meets_targets(spark):
    rows = queries.queries()["op8_mix_sources"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    got = rows.join(docs, "doc_id").collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert all(r.taken <= 3 * r.size for r in got) and sum(x[0].target for x in by.values()) == pytest.approx(sum(r.size for r in got))
    assert all(abs(sum(r.taken for r in x) / x[0].target - 1) < 0.05 for x in by.values())
    again = queries.queries()["op8_mix_sources"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got and [(r.doc_id, r.taken) for r in got])) == sorted((r.doc_id, r.taken) for r in again)


def test_targets_are_reshared(spark):
    sizes = {"a": 10, "b": 100, "c": 5, "d": 1000, None: 0, "": 7}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        k = left / sum(weight[s] for s in free)
        full = {s for s in free if k * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
        free -= full
    want |= {s: k * weight[s] for s in free}
    assert got == pytest.approx(want)


def test_mix_on_odd_tables(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and sum(r.size for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, *_ in ODD)
    assert mixing.mix(odd.limit(0)).count() == 0
    out = mixing.mixed(odd)  # it has a column size, which the mix's replaces
    assert out.columns == [*(c for c in odd.columns if c != "size"), "copies", "size", "source_size", "target", "taken"]
    assert all(r.size == len((r.text or "").split()) and r.copies > 0 for r in out.collect())
    weighted = spark.createDataFrame([(i, "w " * 10, "s", float(i % 4)) for i in range(400)] + [(400 + i, "w " * 10, "t", None) for i in range(400)], "doc_id long, text string, source string, w double")
    taken = {r.w: r.n for r in mixing.mix(weighted, importance="w").join(weighted.select("doc_id", "w"), "doc_id").where("source = 's'").groupBy("w").agg(F.sum("taken").alias("n")).collect()}
    assert taken[0.0] == 0 and taken[1.0] < taken[2.0] < taken[3.0]


# 9


def test_near_duplicates_are_found(spark):
    rng, docs = random.Random(9), []
    for g in range(60):
        base = sentence(rng, rng.choice([4, 8, 60, 150])).split()
        for _ in range(rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "new"
            docs.append((len(docs), " ".join(w).title() + rng.choice([".", ""])))
    base = sentence(rng, 120).split()
    for i in range(150):  # a large group, compared in blocks
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randrange(6)):
            w[k] = f"x{i}"
        docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            x, y = sets[i], sets[j]
            both = set(x) & set(y)
            if len(both) / len(set(x) | set(y)) < 0.5:
                continue
            p = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in set(x) | set(y)) for d in both)
            if p >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    for hopeful in (near_dedup.HOPEFUL, 0.0):
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, hopeful=hopeful).collect()}
        assert got == {i: top(i) for i in range(len(docs))}


def test_large_bands_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 25)
    rng = random.Random(29)
    base = sentence(rng, 300).split()
    docs = []
    for i in range(60):  # most are near each other, some only near a text that is far from the rest
        w = list(base)
        for k in range(i % 40, 300, 40):
            w[k] = f"y{i % 7}"
        docs.append((i, " ".join(w)))
    docs.append((500, "wörd " * 20_000 + docs[0][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(near_dedup, "LARGE", 1)
    assert want == {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} and want[500] == 500
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", 20_000)
    assert want == {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}


def test_rows_of_a_group_do_not_depend_on_other_groups(spark):
    rng = random.Random(19)

    def copies(first, n):
        base = sentence(rng, 120).split()
        return [(first + i, " ".join([*base[:60], f"x{first + i}", *base[61:]])) for i in range(n)]

    three, large = copies(0, 3), copies(100, 80)
    alone, beside = (near_dedup.near_duplicates(spark.createDataFrame(d, "doc_id long, text string")).where("doc_id < 3").collect() for d in (three, three + large))
    assert sorted(map(tuple, alone)) == sorted(map(tuple, beside)) and {r.class_id for r in beside} == {0}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 2**60, 300).astype(np.uint64), rng.integers(1, 2**60, 300).astype(np.uint64)
    y[:200] = x[:200]
    wx, wy = rng.integers(1, 4, 300), rng.integers(1, 4, 300)
    ox, oy = np.argsort(x), np.argsort(y)
    true = near_dedup.similarity((x[ox], wx[ox]), (y[oy], wy[oy]))
    s = near_dedup.probminhash(np.repeat([0, 1], 300), np.concatenate([x, y]), np.concatenate([wx, wy]), 3, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(true, abs=0.03) and (s[2] == 0).all()


def test_near_duplicates_on_odd_tables(spark, odd):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(10)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent = {x: x for pair in links for x in pair if x is not None}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in links:
        if a is not None:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for pair in links if None not in pair and pair[0] != pair[1] for x in pair}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def test_articles_of_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in queries.queries()["op10_html_extract"](spark, DATA).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        import html

        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


UNSEEN = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Site</a></header><div id="cookieBanner">We use cookies, and by staying
you agree to all of them, whatever they may be.</div><div class="layout"><div class="main-content"><h1>Head&shy;line &amp; more</h1><p class="byline">By someone</p><p>First&nbsp;paragraph of the
<i>article</i>, with a <a href="/l">link</a>.<p>Second one, unclosed<script>var x = "<p>no</p>";</script><ul><li>Point.</li></ul><div class="ad-box">Buy now</div><p>Third.</p>
<form><input><p>Subscribe to our letter</p></form></div><div class="right sidebar"><p>Popular things that many people read at length these days.</p></div></div>
<div class="comments"><p>Nice article, I liked the second paragraph most of all of them.</p></div><!-- <p>hidden</p> --><footer><p>&copy; 2024</p></footer></body></html>"""


def test_an_unseen_layout_and_odd_pages(spark):
    rows = [(1, UNSEEN), (2, None), (3, ""), (4, "plain text &lt;here&gt;"), (5, "<p>open <b>bold <!-- never closed"), (6, "<script>only"), (7, "<article>" + "<p>long enough text here " * 5000), (8, "a < b <p title='>'>c")]
    got = {r.page_id: r._text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1] == "Head\xadline & more\nFirst paragraph of the article, with a link.\nSecond one, unclosed\nPoint.\nThird."
    assert got[2] == got[3] == got[6] == "" and got[7].count("\n") == 4999
    assert html_extract.blocks(rows[7][1])[0][0] == "a < b" and html_extract.blocks(rows[3][1])[0][0] == "plain text <here>"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_whole_articles_stay(spark):
    text = [" ".join(f"word{i}of{k}" for i in range(30)) for k in range(3)]
    ps = "".join(f"<p>{t}</p>" for t in text)
    menu, foot = "<nav><a href='/'>Home</a></nav>", "<div class='footer'><p>All rights are with the owners of this site.</p></div>"
    pages = [
        f"<body class='single has-sidebar'>{menu}<article><h1>Head</h1>{ps}</article>{foot}</body>",
        f"<body class='sidebar'>{menu}<article><h1>Head</h1>{ps}</article>{foot}</body>",
        f"<body>{menu}<div id='page' class='with-sidebar'><article><h1>Head</h1>{ps}</article></div>{foot}</body>",
        f"<body><div id='page' class='sidebar'>{menu}<article><h1>Head</h1>{ps}</article>{foot}</div></body>",
        f"<body>{menu}<article class='post comments-open category-social'><h1>Head</h1>{ps}</article>{foot}</body>",
        f"<body>{menu}<article class='sponsored'><h1>Head</h1>{ps}</article>{foot}</body>",
        f"<body><form id='aspnetForm'>{menu}<div class='body'><h1>Head</h1>{ps}</div>{foot}</form></body>",
        f"<body>{menu}<article><h1>Head</h1><p>{text[0]}</p><div class='warning'><p>{text[1]}</p></div><p>{text[2]}</p></article>{foot}</body>",
    ]
    got = {r.n: r._text for r in html_extract.extract(spark.createDataFrame(list(enumerate(pages)), "n long, html string")).collect()}
    assert got == {n: "\n".join(["Head", *text]) for n in range(len(pages))}
    remarks = "<div class='comments'>" + "".join(f"<article><p>{t} {t}</p></article>" for t in text) + "</div>"
    assert [b[3] for b in html_extract.blocks(f"<body><article><h1>Head</h1><p>{text[0]}</p></article>{remarks}</body>")] == [0, 0, 1, 1, 1]


def test_formulas_and_fallbacks_stay():
    math_ml = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation encoding='x'>E=m</annotation></semantics></math>"
    page = f"<article><p>So {math_ml} holds.</p><p><object data='x'><param name='a'>A map of it.</object> <canvas>A drawing.</canvas><video><source src='v'>A film.</video></p></article>"
    assert [b[0] for b in html_extract.blocks(page)] == ["So E=m holds.", "A map of it. A drawing.A film."]
    assert html_extract.blocks("<math><mtr><mtd>1</mtd><mtd>2</mtd></mtr></math>")[0][0] == "1 2"


def test_blocks_of_hostile_pages_are_whole():
    long_tag = f"<p title='{'x' * 50_000}>'>text"
    assert [b[0] for b in html_extract.blocks(long_tag)] == ["text"]
    assert [b[0] for b in html_extract.blocks('<p title="a>kept</p><p>too</p>')] == ["kept", "too"]
    deep = "<p>" + "<b>" * 30 + "one<div>two</div>"
    assert [b[0] for b in html_extract.blocks(deep)] == ["one", "two"]
    assert [b[0] for b in html_extract.blocks("<b>" * 20_000 + "x" + "</i>" * 20_000)] == ["x"]


def test_layouts_without_names_need_words_and_links(spark):
    rng = random.Random(20)
    text = [sentence(rng, 40) for _ in range(4)]
    text[1] = f"{text[1]} <a href='/x'>{sentence(rng, 9)}</a> tail"
    menu = "".join(f"<div><a href='/{i}'>{sentence(rng, 2)}</a></div>" for i in range(5))
    more = "".join(f"<div><a href='/{i}'>{sentence(rng, 14)}</a></div>" for i in range(3))
    bodies = {box: "".join(f"<{box}>{t}</{box}>" for t in text) for box in ("div", "p", "section")}
    pages = [(box, f"<body>{menu}<h1>{sentence(rng, 4)}</h1>{body}{more}<div>Imprint</div><div>Contact us</div></body>") for box, body in bodies.items()]
    got = {r.box: r._text for r in html_extract.extract(spark.createDataFrame(pages, "box string, html string")).collect()}
    plain = [re.sub("<[^>]*>", "", t) for t in text]
    for box, page in pages:
        assert got[box].split("\n") == [re.search("<h1>(.*)</h1>", page)[1], *plain]
    used = set()

    def of(t):
        if not isinstance(t, bool):
            used.add(t[0])
            of(t[2]), of(t[3])

    of(html_extract.fitted(spark))
    assert {"words", "links", "words_after"} <= used and used & {"links_after", "links_before"}


def test_extraction_keeps_columns_named_like_its_own(spark):
    rows = spark.createDataFrame([(1, "<article><p>One two three.</p></article>", "b", "t")], "page_id long, html string, _blocks string, _text string")
    out = html_extract.extract(rows)
    assert out.columns == ["page_id", "_blocks", "_text"] and out.first()[1:] == ("b", "One two three.")


def test_the_tree_fits_its_table(spark):
    is_main = html_extract.train(spark)
    rows = html_extract.labelled(spark).withColumn("p", is_main(F.struct(*html_extract.FEATURES)).cast("double"))
    assert rows.where("p = label").count() / rows.count() > 0.97


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), docs.schema)
    hits = decontam.scan(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where("_n_hit > 0").count()
    assert hits == 0
    classes = near_dedup.near_duplicates(docs.where("text <> ''"))
    assert docs.where("text <> ''").count() > 0 and classes.count() > 0
    mixed = corpus_pipeline.run(spark, DATA)
    assert 0 < mixed.count() <= docs.count() and mixed.where("taken > 3 * size or copies < 1").count() == 0
