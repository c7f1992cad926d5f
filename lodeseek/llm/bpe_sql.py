"""Byte-level BPE over whole texts: each partition encodes and decodes with DuckDB, as rows of tokens and positions.

A text is cut by the pre-tokenizer's pattern. Words that a worker hasn't met before become rows (word, position, token),
first a token a byte. A recursive query joins neighbours with the merge table and contracts in each word the leftmost
of the pairs of least rank, until no word has a pair that merges. Decoding joins ids with the vocabulary and puts their
bytes together by an ordered aggregation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read_table, slices

# Fixed value: the pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Text that is encoded at a time, bytes of new words in one recursive query, and its contractions before it starts anew
#: from what it has (its rows of all steps stay in memory until then).
SLICE, NEW_BYTES, STEPS = 4 << 20, 256 << 10, 64
#: Words whose tokens a worker remembers; then it begins anew.
REMEMBERED = 600_000
#: Ids that are decoded at a time.
DECODED = 500_000

CONTRACT = """
with recursive s as (
    select w, p, t, lead(t) over v as next_t, lead(p) over v as next_p, 0 as k from begun window v as (partition by w order by p)
    union all
    select s.w, s.p, case when s.p = c.into_p then c.m else s.t end,
           case when s.p = c.into_p then gone.next_t when s.next_p = c.into_p then c.m else s.next_t end,
           case when s.p = c.into_p then gone.next_p else s.next_p end, s.k + 1
    from (
        select w, min(m) as m, arg_min(p, rank_p) as into_p, arg_min(next_p, rank_p) as gone_p
        from (select w, p, next_p, m, (m::bigint << 32) | p as rank_p from s join merges on l = t and r = next_t where k < {steps}) group by w
    ) c
    join s on s.w = c.w
    join s as gone on gone.w = c.w and gone.p = c.gone_p
    where s.p <> c.gone_p
)
select w, p, t, k from s join (select w, max(k) as k from s group by w) using (w, k)"""
DECODE = "select d, unhex(string_agg(h, '' order by p)) as b from rows_of join vocabulary using (t) group by d order by d"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 of the bytes, blank, rank), by any path that Spark reads."""
    lines = spark.read.text(path).collect()  # a vocabulary
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in lines if r[0])}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, m): every pair of tokens whose joined bytes are a token; the merged id is its rank."""
    found = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return pa.table([pa.array(c, pa.int32()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int32())] * 3, names=["l", "r", "m"])


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


class _Numbers(dict):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Tokens of words, for one task: words that it knows by number, and DuckDB for new ones."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = _connection()
        self.con.register("merges_of", merges)
        self.con.execute("create table merges as select * from merges_of")
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.sizes, self.tokens, self.n_ids = [], [], 0

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and all tokens, word by word."""
        lengths = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        t = self.single[np.frombuffer(b"".join(words), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(w):
            self.con.register("begun", pa.table([w, p, t], names=["w", "p", "t"]))
            got = self.con.execute(CONTRACT.format(steps=STEPS)).fetchnumpy()
            w, p, t, open_ = got["w"], got["p"], got["t"], got["k"] >= STEPS
            done.append((w[~open_], p[~open_], t[~open_]))
            w, p, t = w[open_], p[open_], t[open_]
        w, p, t = (np.concatenate(c) for c in zip(*done, strict=True))
        at = np.lexsort((p, w))
        return np.bincount(w, minlength=len(words)), t[at]

    def learn(self, words: list[str]) -> None:
        """Add words in the order of their numbers. A word that is a token as a whole has that one."""
        raw = [w.encode() for w in words]
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int32)
        sizes, at = np.ones(len(raw), np.int64), np.flatnonzero(whole < 0)
        parts = []
        rest, n = [], 0
        for i in at:
            rest.append(i)
            n += len(raw[i])
            if n >= NEW_BYTES or i == at[-1]:
                sizes[rest], ids = self.contracted([raw[j] for j in rest])
                parts.append(ids)
                rest, n = [], 0
        ids = np.zeros(int(sizes.sum()), np.int32)
        known = np.repeat(whole >= 0, sizes)
        ids[known] = whole[whole >= 0]
        if parts:
            ids[~known] = np.concatenate(parts)
        self.sizes.append(sizes)
        self.tokens.append(ids)
        self.n_ids += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; a text's words are encoded separately."""
        import regex

        if len(self.numbers) > REMEMBERED:
            self.forget()
        find, numbers, n_known = regex.compile(PATTERN).findall, self.numbers, len(self.numbers)
        codes = []
        for text in texts:
            words = find(text)
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        fresh = list(islice(numbers, n_known, None))
        if fresh:
            self.learn(fresh)
            self.sizes, self.tokens = [np.concatenate(self.sizes)], [np.concatenate(self.tokens)]
        if not self.sizes:
            return [np.zeros(0, np.int64) for _ in texts]
        sizes, ids = self.sizes[0], self.tokens[0]
        first = np.cumsum(sizes) - sizes
        out = []
        for code in codes:
            n = sizes[code]
            out.append(ids[np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return out


#: The encoder of each vocabulary in this Python worker, which serves one task after the other.
_encoders: dict[str, Encoder] = {}


def _replacing(df: DataFrame, column: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != column), T.StructField(column, T.BinaryType())])


def with_ids(docs: DataFrame, path: str = RANKS, text: str = "text", column: str = "ids") -> DataFrame:
    """docs with the ids of each whole text as little-endian unsigned 32-bit integers in a row, in place of the text.

    Special tokens' strings are plain text. Null and empty texts have no ids; rows that repeat, ties and nulls in other
    columns pass as they are; an empty table gives none; a column named like the new one is replaced. A long text is
    encoded whole; work on one word (a run without breaks) grows with the square of its length, memory with its length.
    """
    ranks = read_ranks(docs.sparkSession, path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))  # a vocabulary
    kept = docs.drop(column) if text != column else docs
    schema = _replacing(kept.drop(text), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(*shared.value)
        encoder = _encoders[path]
        for batch in chain.from_iterable(slices(b, text, SLICE) for b in batches):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = pa.array([x.astype("<u4").tobytes() for x in encoder.encode(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), ids], names=schema.names)

    return kept.mapInArrow(run, schema)


def with_bytes(encoded: DataFrame, path: str = RANKS, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """encoded with the bytes that each row's ids (as with_ids packs them) stand for; null ids and none give no bytes.

    An id that the vocabulary lacks adds nothing. A column named like the new one is replaced.
    """
    ranks = read_ranks(encoded.sparkSession, path)
    vocabulary = pa.table([pa.array(ranks.values(), pa.int64()), pa.array([t.hex() for t in ranks], pa.string())], names=["t", "h"])
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = encoded.drop(column)
    schema = _replacing(kept, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = None
        for batch in batches:
            if con is None:
                con = _connection()
                con.register("vocabulary_of", shared.value)
                con.execute("create table vocabulary as select * from vocabulary_of")
            packed = [np.frombuffer(x or b"", "<u4") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            out: list[bytes] = [b""] * len(packed)
            for some in _by_size(packed, DECODED):
                sizes = [len(packed[i]) for i in some]
                d, p = np.repeat(some, sizes), np.concatenate([np.arange(n) for n in sizes])
                con.register("rows_of", pa.table([d, p, np.concatenate([packed[i] for i in some]).astype(np.int64)], names=["d", "p", "t"]))
                for i, b in con.execute(DECODE).fetchall():
                    out[i] = b
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(out, pa.binary())], names=schema.names)

    return kept.mapInArrow(run, schema)


def _by_size(arrays: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """Numbers of arrays in groups of about `most` values; a longer one is a group alone, empty ones are in none."""
    group, n = [], 0
    for i, a in enumerate(arrays):
        if group and n + len(a) > most:
            yield group
            group, n = [], 0
        if len(a):
            group.append(i)
            n += len(a)
    if group:
        yield group


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: number and digest of its ids, and digest of what they decode to."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = with_bytes(with_ids(docs))
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
