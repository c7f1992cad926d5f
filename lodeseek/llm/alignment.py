"""Two tokenizers' tokens of the same texts, aligned by the bytes that they cover.

Texts are shuffled by their full text and each distinct one is encoded and aligned once; its pairs count as often as
documents have it. Pairs are summed over the corpus, looked up for each text's links, and the measures of a text are
joined to the documents that have it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read_table, slices, stored
from .token_rollup import PATTERN, pieces

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A pair of ids is one number: the first id times this, plus the second.
SECOND, PAIR_BITS = 1 << 20, 40
#: Pairs of the corpus that go to every task at a time (17 bytes each); more are looked up in further passes.
PAIRS_A_PASS = 4_000_000
#: Bytes of text that are aligned at a time.
SLICE = 1 << 20

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary, whose characters each stand for a byte.

    Printable bytes stand for themselves, the others, in order, for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t)}


class Aligner:
    """Both tokenizers, for one task. files: the contents of the byte-level one's JSON and of the piece model."""

    def __init__(self, files: tuple[bytes, bytes]):
        import sentencepiece
        import tiktoken

        spec = json.loads(files[0])
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = byte_ranks({t: i for t, i in spec["model"]["vocab"].items() if i not in special})
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
        self.bytes_a = self._table(ranks.items())
        names = [(self.b.id_to_piece(i), i) for i in range(self.b.get_piece_size())]
        self.bytes_b = self._table((bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode(), i) for t, i in names)
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        ends = ((self.bytes_a, ",|"), (self.bytes_b, ",;"))
        self.shown = [[np.array([f"{i}{mark}" for i in range(len(t))], object) for mark in marks] for t, marks in ends]

    @staticmethod
    def _table(items) -> list[bytes]:
        found = {i: t for t, i in items}
        return [found.get(i, b"") for i in range(max(found) + 1)]

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Both tokenizers' ids of blank + text; none if either's bytes aren't those. A long text is encoded in pieces.

        Pieces begin with a blank after a letter or digit and before a letter, over which neither joins tokens.
        """
        if not text:
            return [], []
        parts = list(pieces(" " + text))
        a = list(chain.from_iterable(self.a.encode_ordinary_batch(parts, num_threads=1))) if len(parts) > 1 else self.a.encode_ordinary(parts[0])
        b = list(chain.from_iterable(self.b.encode([p[1:] for p in parts], num_threads=1)))
        whole = (" " + text).encode()
        at = self.bytes_b
        if b"".join([at[i] for i in b]) != whole or b"".join([self.bytes_a[i] for i in a]) != whole:
            return [], []
        return a, b

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray | pa.Array]:
        """The columns of ALIGNED for each text."""
        found = [self.ids(t) for t in texts]
        (a, of_a, n_a), (b, of_b, n_b) = (self._flat([f[k] for f in found]) for k in (0, 1))
        end_a, end_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])  # over all texts, which end alike in both
        at_a, at_b = (np.bincount(e, minlength=int(end_a[-1]) + 1 if len(a) else 1) for e in (end_a, end_b))  # by byte
        both, links = np.flatnonzero(at_a & at_b), np.flatnonzero(at_a | at_b)
        link_a, link_b = (np.cumsum(x)[links] - x[links] for x in (at_a, at_b))
        text = of_a[link_a] if len(links) else links
        # Sorted as one number: the text, then the pair.
        keys = np.sort((text << PAIR_BITS) | (a[link_a] * SECOND + b[link_b])) if len(links) else links
        text, pair = keys >> PAIR_BITS, keys & ((1 << PAIR_BITS) - 1)
        begin = np.flatnonzero(np.r_[True, np.diff(keys) != 0]) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.r_[begin, len(keys)])
        first = np.searchsorted(text[begin], np.arange(len(texts) + 1)).astype(np.int32)
        groups = np.cumsum(at_a & at_b)
        group_text = of_a[np.cumsum(at_a)[both] - 1] if len(both) else both
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_text, minlength=len(texts)), "n_links": np.bincount(text, minlength=len(texts)),
            "groups": self._shown(a, b, groups[end_a - 1], groups[end_b - 1], len(both), n_a, n_b),
            "pairs": pa.ListArray.from_arrays(pa.array(first), pa.array(pair[begin], pa.int64())), "times": pa.ListArray.from_arrays(pa.array(first), pa.array(times, pa.int32())),
        }

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())), np.repeat(np.arange(len(ids)), n), n

    def _shown(self, a, b, group_a, group_b, n_groups, n_a, n_b) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each text, from the groups that its tokens are in."""
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True][: len(a)], np.r_[group_b[1:] != group_b[:-1], True][: len(b)]
        upto_a, upto_b = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.r_[0, np.cumsum(np.bincount(group_b, minlength=n_groups))]
        out = np.empty(len(a) + len(b), object)
        (a_more, a_last), (b_more, b_last) = self.shown
        out[np.arange(len(a)) + upto_b[group_a]] = np.where(last_a, a_last[a], a_more[a])
        out[np.arange(len(b)) + upto_a[group_b]] = np.where(last_b, b_last[b], b_more[b])
        ends = np.cumsum(n_a + n_b)
        return ["".join(out[e - n : e])[:-1] for e, n in zip(ends, n_a + n_b, strict=True)]


def aligned(texts: DataFrame, files: tuple[str, str] = (BYTE_BPE, PIECES), text: str = "text") -> DataFrame:
    """texts with, in place of the text, the alignment of both tokenizers' tokens of blank + text.

    n_a, n_b: tokens; groups: ids between byte offsets where both have a token's end, as `a1,a2|b1;a3|b2,b3`, and their
    number; n_links: pairs of tokens that share bytes; pairs, times: the different pairs of ids among them (first * SECOND
    + second) and how many links have each. Texts that are null, empty or changed by a tokenizer have none of these.
    Columns that are named like the new ones are replaced; an empty table gives none; long texts are encoded in pieces.
    """
    spark = texts.sparkSession
    read = tuple(spark.read.format("binaryFile").load(f).select("content").first()[0] for f in files)  # two vocabularies
    shared = spark.sparkContext.broadcast(tuple(bytes(x) for x in read))
    new = T.StructType.fromDDL(ALIGNED)
    kept = texts.drop(*new.names)
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != text), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in chain.from_iterable(slices(b, text, SLICE) for b in batches):
            aligner = aligner or Aligner(shared.value)
            found = aligner.align(batch.column(batch.schema.get_field_index(text)).to_pylist())
            old = [batch.column(batch.schema.get_field_index(c)) for c in schema.names if c not in found]
            yield pa.RecordBatch.from_arrays([*old, *(x if isinstance(x, pa.Array) else pa.array(x) for x in found.values())], names=schema.names)

    return kept.mapInArrow(run, schema)


def pair_counts(alignments: DataFrame, copies: str = "copies") -> DataFrame:
    """(pair, second, n, best): links of each pair of ids over all documents, and whether its second id has none with more."""
    each = alignments.select(copies, F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = stored(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.times") * F.col(copies)).alias("n")), "pair-counts")
    second = (F.col("pair") % SECOND).alias("second")
    most = counts.groupBy(second).agg(F.max("n").alias("most"))  # as many as the second vocabulary has ids
    return counts.withColumn("second", second).join(most.hint("merge"), "second").select("pair", "second", "n", (F.col("n") == F.col("most")).alias("best"))


def with_pair_measures(alignments: DataFrame, counts: DataFrame) -> DataFrame:
    """alignments with n_best (links whose pair is a best one) and count_sum (over links, the counts of their pairs).

    The counts go to every task in passes of PAIRS_A_PASS, each of which reads the stored alignments.
    """
    counts = stored(counts, "pairs")
    n_passes = max(1, -(-counts.count() // PAIRS_A_PASS))
    spark = alignments.sparkSession
    name = F.pmod(F.xxhash64("pair"), F.lit(n_passes))
    kept = [f for f in alignments.schema.fields if f.name not in ("pairs", "times", "n_best", "count_sum")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    found = None
    for i in range(n_passes):
        rows = counts.where(name == i).select("pair", "n", "best").toArrow().sort_by("pair")
        shared = spark.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in ("pair", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pair, n, best = shared.value
            for batch in batches:
                pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
                asked, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(batch.num_rows), np.diff(pairs.offsets.to_numpy()))
                sums = np.zeros((2, batch.num_rows), np.int64)
                if len(pair) and len(asked):
                    at = np.minimum(np.searchsorted(pair, asked), len(pair) - 1)
                    here = pair[at] == asked
                    np.add.at(sums[0], row[here & best[at]], weight[here & best[at]])
                    np.add.at(sums[1], row[here], (weight * n[at])[here])
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *map(pa.array, sums)], names=schema.names)

        part = alignments.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if n_passes > 1:
        found = found.groupBy(*[f.name for f in kept]).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found


def measures(docs: DataFrame, files: tuple[str, str] = (BYTE_BPE, PIECES)) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text).

    Rows that repeat an id or a text have a row each; null ids stay null; other columns pass unread; no documents give
    no rows. Rows without tokens have zeros and an empty digest. Groups of copies of any size meet only as sums by text
    and in the join by digest, whose large partitions Spark splits.
    """
    has_text = F.coalesce(F.length("text"), F.lit(0)) > 0
    texts = docs.where(has_text).groupBy("text").agg(F.count("*").alias("copies"))
    each = aligned(texts.withColumn("digest", F.sha2("text", 256)), files).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    each = stored(each.drop("groups"), "aligned")
    found = stored(with_pair_measures(each, pair_counts(each)).drop("copies"), "measures")
    rows = docs.select("doc_id", F.when(has_text, F.sha2("text", 256)).alias("digest"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.join(found.hint("merge"), "digest", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the measures of their two encodings."""
    return measures(read_table(spark, sf_dir, "documents"))
