"""Operators 11 to 13 against brute force and the public libraries, and on odd tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import alignment, bpe_sql, period_runs, queries

from ..conftest import DATA
from .test_llm import DOCS, ODD

P = pytest.importorskip("public_tokenizers")
STRANGE = ["a  b", " x", "<|endoftext|> café <s> ▁ ok", "日本語　テキスト 😀 ﬁ", "a\nb\tc", "a\nb\tc", "zz ", "x" * 700 + " word" * 30_000, "it's I'LL we'd 1234 ½ ২", "\x00\x01    ࡰ \U0001e4d0"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [*ODD, *((100 + i, t, "en", "s", 1) for i, t in enumerate(STRANGE))]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("ids", "decoded", "runs", "collapsed", "digest", "groups", "copies", "n_a", "pairs")})


def _sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# 11


def _aligned(texts):
    """The measures of each (key, text), by walking through both tokenizers' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    b_bytes = lambda i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b_side.id_to_piece(i)) else p.replace("▁", " ").encode()
    out, counts = [], Counter()
    for key, text in texts:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        parts_a, parts_b = [ranks[i] for i in a], [b_bytes(i) for i in b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            out.append((key, 0, 0, 0, [], ""))
            continue
        i = j = end_a = end_b = 0
        links, groups, group = [], [], ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            to_a, to_b = end_a + len(parts_a[i]), end_b + len(parts_b[j])
            if to_a <= to_b:
                group[0].append(str(a[i]))
                i, end_a = i + 1, to_a
            if to_b <= to_a:
                group[1].append(str(b[j]))
                j, end_b = j + 1, to_b
            if to_a == to_b:
                groups.append("|".join(map(",".join, group)))
                group = ([], [])
        counts.update(links)
        out.append((key, len(a), len(b), len(groups), links, _sha(";".join(groups))))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(key, n_a, n_b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha) for key, n_a, n_b, g, links, sha in out]


def test_alignment_is_brute_force(spark):
    got = queries.queries()["op11_token_alignment"](spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(_aligned(docs))


def test_alignment_in_passes_and_on_odd_tables(spark, odd, monkeypatch):
    expected = sorted(_aligned([(r.doc_id, r.text) for r in odd.collect()]), key=str)
    assert sorted(map(tuple, alignment.measures(odd).collect()), key=str) == expected
    assert sum(r[1] == 0 for r in expected) >= 3  # null, empty, and changed by a tokenizer
    monkeypatch.setattr(alignment, "PAIRS_A_PASS", 40)
    assert sorted(map(tuple, alignment.measures(odd.where("doc_id is null or doc_id <> 4 and doc_id <> 6")).collect()), key=str) == sorted(_aligned([(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id <> 4 and doc_id <> 6").collect()]), key=str)
    assert alignment.measures(odd.limit(0)).collect() == []


# 12


def _runs(w, least_length=6, least_exponent=4):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least_length, least_exponent * q) and all(w[i : i + n - r] != w[i + r : i + n] for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _expected_runs(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    rows = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], _sha(rows), _sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_lyndon_words_and_runs_are_brute_force():
    rng = random.Random(5)
    for trial in range(150):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 2, 5, 20, 50]))] for _ in range(rng.choice([1, 3, 8]))]
        if trial % 3 == 0:
            texts = [t * rng.choice([1, 3, 5]) + t[: rng.randrange(len(t) + 1)] for t in texts]
        codes, first = np.array([c for t in texts for c in t], np.int64), np.cumsum([0, *map(len, texts)])
        lyndon = [next((j - i for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t) - i) for t in texts for i in range(len(t))]
        assert period_runs.lyndon_lengths(codes, first).tolist() == lyndon
        for least in ((6, 4), (2, 2), (1, 5)):
            assert list(zip(*map(np.ndarray.tolist, period_runs.runs_of(codes, first, *least)), strict=True)) == [(i, *r) for i, t in enumerate(texts) for r in _runs(t, *least)]


def test_runs_of_documents_are_brute_force(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("length(text) < 8000")
    short = docs.collect()
    got = {r.doc_id: tuple(r) for r in queries.queries()["op12_period_runs"](spark, DATA).collect()}
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count() and any(r[1] for r in got.values())
    assert [got[r.doc_id] for r in short] == [_expected_runs(*r) for r in short]
    monkeypatch.setattr(period_runs, "GROUPED", 500)
    again = period_runs.with_runs(docs.select("doc_id", period_runs.words_of(F.col("text")).alias("words")))
    plain = {r.doc_id: _runs(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in short}
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in again.collect()} == plain


def test_runs_on_odd_tables(spark, odd):
    texts = odd.withColumn("words", period_runs.words_of(F.col("text"))).drop("text")
    rows = period_runs.with_runs(texts).collect()
    assert len(rows) == odd.count() and set(rows[0].asDict()) == set(texts.columns) - {"words"}
    long = next(r for r in rows if r.doc_id == 4)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "wörd"
    assert [(r.runs, r.collapsed) for r in rows if r.doc_id in (1, 2, 5)] == [([], "")] * 3
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [None, "", "b"])], "id int, words array<string>")
    assert [r.collapsed for r in period_runs.with_runs(nulls).orderBy("id").collect()] == ["", "", "  b"]
    assert period_runs.with_runs(texts.limit(0)).collect() == []


# 13


def _library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(spark):
    library = _library()
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.queries()["op13_bpe_duckdb"](spark, DATA).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(texts[r.doc_id]))


def test_bpe_on_odd_tables(spark, odd, monkeypatch):
    library = _library()
    rows = bpe_sql.with_bytes(bpe_sql.with_ids(odd)).collect()
    assert len(rows) == odd.count()
    packed = lambda t: np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
    expected = Counter((r.doc_id, packed(r.text), (r.text or "").encode()) for r in odd.collect())
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == expected
    assert bpe_sql.with_bytes(bpe_sql.with_ids(odd.limit(0))).collect() == []
    unknown = spark.createDataFrame([(1, None), (2, np.array([99_999_999], "<u4").tobytes())], "id int, ids binary")
    assert [bytes(r.decoded) for r in bpe_sql.with_bytes(unknown).collect()] == [b"", b""]


def test_bpe_of_long_words_and_a_small_memory(spark, monkeypatch):
    monkeypatch.setattr(bpe_sql, "REMEMBERED", 3)
    monkeypatch.setattr(bpe_sql, "STEPS", 5)
    ranks, library, rng = bpe_sql.read_ranks(spark, bpe_sql.RANKS), _library(), random.Random(2)
    encoder = bpe_sql.Encoder(ranks, bpe_sql.merge_table(ranks))
    texts = ["".join(rng.choice("abcdefghij") for _ in range(400)), "a" * 500, "", "日本語テキスト" * 9, "one two three", "four one"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
