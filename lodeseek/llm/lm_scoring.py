"""LM scoring by cross-entropy difference (Moore and Lewis 2010) of two bigram models over one vocabulary.

The vocabulary is every word of all documents; the target model counts the documents labelled good, the background
model all documents. Both models are tables that grow with the corpus: words with their counts, and cells (previous
word, word), which are dealt to buckets with the documents they stand in. A bucket counts its cells, takes each one's
loss under the target less that under the background, and sums these by document; the sums meet again by the stretch of
documents (about 8 MB of text) that was dealt at once.

vocabulary, bigram_counts, loss_differences and score do the same over a small vocabulary that is fixed beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, slices, stored, text_column, text_or_empty
from .wordbytes import Words, mix64, words_of

#: Size of the vocabulary with the start (0) and the unknown word (1); weight of the bigram beside the unigram.
VOCABULARY, WEIGHT = 2048, 0.7
START, UNKNOWN = 0, 1
#: Distinct words that a task gathers before it passes them on.
GATHERED = 400_000
#: Commonest words, whose counts every task has; tokens for each bucket of cells; the bit that marks the other words.
HOT, CELLS, RARE = 200_000, 3_000_000, np.uint64(1 << 63)
#: Counts of a word in both models, and of the words that follow it. The start is the word 0, which follows nothing.
COUNTS = ["background", "target", "after_background", "after_target"]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes of all words of all documents (column text) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                new, n = np.unique(words_of(*text_column(part, "text")).hashes, return_counts=True)
                words, at = np.unique(np.concatenate([words, new]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(words)).astype(np.int64)
                if len(words) > GATHERED:
                    yield out()
                    words, counts = words[:0], counts[:0]
        yield out()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Sorted hashes of the size - 2 commonest words, ties by hash."""
    best = word_counts(docs).orderBy(F.desc("n"), "word").limit(size - 2).collect()
    return np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))


def token_ids(words: Words, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(words), UNKNOWN)
    at = np.searchsorted(vocabulary, words.hashes)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == words.hashes, at + 2, UNKNOWN)


def cells(words: Words, vocabulary: np.ndarray, size: int) -> np.ndarray:
    """The cell (previous token, token) of each word; a text's first word follows the start."""
    ids = token_ids(words, vocabulary)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[words.first[:-1][np.diff(words.first) > 0]] = START
    return before * size + ids


def bigram_counts(docs: DataFrame, vocabulary: np.ndarray, size: int = VOCABULARY) -> DataFrame:
    """(cell, background, target) of documents with columns text and target (boolean)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, size * size), np.int32)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                words = words_of(*text_column(part, "text"))
                at, good = cells(words, shared.value, size), np.array(part.column(1).to_pylist(), bool)[words.row]
                for k, x in enumerate((at, at[good])):
                    cell, n = np.unique(x, return_counts=True)
                    table[k, cell] += n.astype(np.int32)
        some = np.flatnonzero(table[0])
        for k in range(0, len(some), 100_000):
            c = some[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), *(pa.array(table[i, c].astype(np.int64)) for i in (0, 1))], names=["cell", "background", "target"])

    counted = docs.select("text", "target").mapInArrow(run, "cell int, background long, target long")
    return counted.groupBy("cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def loss_differences(counts: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Table of -log P_target + log P_background of each cell; at most size squared cells come to the driver."""
    got = counts.toArrow()
    cell = got.column("cell").to_numpy()
    table = np.zeros(size * size, np.float32)
    for sign, name in ((-1, "target"), (1, "background")):
        table += np.float32(sign) * log_probabilities(cell, got.column(name).to_numpy(), size)
    return table


def log_probabilities(cell: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Bigrams interpolated with add-one unigrams; a context never seen leaves all to the unigrams."""
    context = np.bincount(cell // size, weights=n, minlength=size)
    unigram = np.bincount(cell % size, weights=n, minlength=size) + 1.0
    unigram /= unigram.sum()
    own = np.where(context > 0, WEIGHT, 0.0)
    p = ((1 - own)[:, None] * unigram[None, :]).astype(np.float64).reshape(-1)
    p[cell] += (WEIGHT * n / np.maximum(context, 1)[cell // size])
    return np.log(p).astype(np.float32)


def score(docs: DataFrame, vocabulary: np.ndarray, table: np.ndarray, doc_id: str = "doc_id", text: str = "text", size: int = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, loss_difference, score): the sum over whole texts, and the mean, lower for text like the target.

    A text without words (null, empty) has 0 tokens, difference 0 and a null score; a row for each row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, losses = shared.value
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                words = words_of(*text_column(part, "text"))
                n = np.diff(words.first)
                total = np.bincount(words.row, weights=losses[cells(words, known, size)], minlength=part.num_rows)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(total.astype(np.float64)), mean], names=["doc_id", "n_tokens", "loss_difference", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, loss_difference double, score double")


def before_of(words: Words) -> np.ndarray:
    """The hash of the word before each word, 0 for a text's first."""
    before = np.zeros_like(words.hashes)
    before[1:] = words.hashes[:-1]
    before[words.first[:-1][np.diff(words.first) > 0]] = 0
    return before


def model_words(docs: DataFrame) -> DataFrame:
    """(word, *COUNTS) of every word of documents with columns text and target (boolean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.zeros(0, np.uint64), np.zeros((4, 0), np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *(pa.array(c) for c in counts)], names=["word", *COUNTS])
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                words = words_of(*text_column(part, "text"))
                good = np.array(part.column(1).to_pylist(), bool)[words.row]
                new, at = np.unique(np.concatenate([words.hashes, before_of(words)]), return_inverse=True)
                one, after = at[: len(words)], at[len(words) :]
                n = np.array([np.bincount(x, minlength=len(new)) for x in (one, one[good], after, after[good])])
                known, at = np.unique(np.concatenate([known, new]), return_inverse=True)
                counts = np.array([np.bincount(at, weights=c, minlength=len(known)) for c in np.concatenate([counts, n], axis=1)]).astype(np.int64)
                if len(known) > GATHERED:
                    yield out()
                    known, counts = known[:0], counts[:, :0]
        yield out()

    counted = docs.select("text", "target").mapInArrow(run, "word long, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _ids(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A hot word's place in hot (sorted), else its hash with the mark of other words."""
    if not len(hot):
        return hashes | RARE
    at = np.searchsorted(hot, hashes)
    at[at == len(hot)] = 0
    return np.where(hot[at] == hashes, at.astype(np.uint64), hashes | RARE)


def _digest(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(before + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + word)


def _buckets(before: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """All that follows a word is in one bucket, unless the word is hot: then its cells are spread."""
    return (np.where(before < RARE, _digest(before, word), mix64(before)) % np.uint64(n)).astype(np.int32)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """The arrays, byte planes apart so that small numbers compress."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(planes))


def _unpacked(data: bytes, kinds: list[type]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)), kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


#: Arrays of a bucket's share of some documents: each cell's words, counts in both models and number of documents, then
#: each of these documents (from the first of the share) and how often the cell stands in it.
_SHARE = [np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32]


def _shares(row: np.ndarray, before: np.ndarray, word: np.ndarray, good: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    bucket, cell = _buckets(before, word, n_buckets), _digest(before, word)
    order = np.lexsort((cell, bucket))  # stable, so that rows stay in order within a cell
    row, before, word, good, bucket, cell = (x[order] for x in (row, before, word, good, bucket, cell))
    new_cell = np.concatenate([[True], (cell[1:] != cell[:-1]) | (bucket[1:] != bucket[:-1])])
    new_row = new_cell | np.concatenate([[True], row[1:] != row[:-1]])
    at, at_row = np.flatnonzero(new_cell), np.flatnonzero(new_row)
    n_cell = np.diff(np.concatenate([at, [len(row)]]))
    n_good, n_rows = np.add.reduceat(good.astype(np.int64), at), np.add.reduceat(new_row.astype(np.int64), at)
    n_row = np.diff(np.concatenate([at_row, [len(row)]]))
    first_row = np.concatenate([[0], np.cumsum(n_rows)])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[at])) + 1, [len(at)]])
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own, rows = slice(i, j), slice(first_row[i], first_row[j])
        small = [x.astype(np.uint32) for x in (n_cell[own], n_good[own], n_rows[own], row[at_row[rows]], n_row[rows])]
        yield int(bucket[at[i]]), _packed([before[at[own]], word[at[own]], *small])


def score_all(docs: DataFrame, hot: int = HOT, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_tokens, loss_difference, score) as score() gives them, over every word of docs (doc_id, text, target).

    A cell's probability is WEIGHT of its share of what follows the previous word, and else the word's add-one share;
    a previous word that the target never has leaves all to the latter. Only the counts of the commonest words go to
    every task; those of other words are joined to the buckets that ask for them, and all that follows such a word is
    in one bucket, where it is counted. A bucket has about so many cells; one that stands in every document puts a
    number for each document into its bucket.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    words = stored(model_words(docs), "words")
    n_words, *sums = words.agg(F.count_if(F.col("background") > 0), *[F.coalesce(F.sum(c), F.lit(0)) for c in COUNTS[:2]]).first()
    n_buckets = int(sums[0] // cells) + 1
    best = words.orderBy(F.desc(F.greatest("background", "after_background")), "word").limit(hot).toArrow()
    of_hot = best.column("word").to_numpy().view(np.uint64)
    order = np.argsort(of_hot)
    shared = spark.sparkContext.broadcast((of_hot[order], [best.column(c).to_numpy()[order] for c in COUNTS]))

    def cells_of(part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
        words = words_of(*text_column(part, "text"))
        return words, _ids(before_of(words), shared.value[0]), _ids(words.hashes, shared.value[0])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                words, before, word = cells_of(part)
                rare = word >= RARE
                asked = np.unique(np.rec.fromarrays([_buckets(before[rare], word[rare], n_buckets), words.hashes[rare].view(np.int64)], names="bucket,word"))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(asked["bucket"])), pa.array(np.ascontiguousarray(asked["word"]))], names=["bucket", "word"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, names = TaskContext.get().partitionId() << 33, ["bucket", "first", "doc", "doc_id", "n_tokens", "data"]
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                words, before, word = cells_of(part)
                n, doc = part.num_rows, np.arange(part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(((start + doc) % n_buckets).astype(np.int32)), pa.array(np.full(n, start)), pa.array(doc), part.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.nulls(n, pa.binary())], names=names)
                if len(words):
                    good = np.array(part.column(2).to_pylist(), bool)[words.row]
                    for bucket, data in _shares(words.row, before, word, good, n_buckets):
                        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([start], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, part.column(0).type), pa.nulls(1, pa.int64()), pa.array([data], pa.binary())], names=names)
                start += n

    def sum_up(own: pa.Table, asked: pa.Table) -> pa.Table:
        there = own.filter(own.column("data").is_null()).drop(["bucket"])
        rest = own.filter(own.column("data").is_valid())
        sums_of = []
        if rest.num_rows:
            shares = [_unpacked(x, _SHARE) for x in rest.column("data").to_pylist()]
            before, word, *counts = (np.concatenate([s[k] for s in shares]) for k in range(4))
            _, first, at = np.unique(_digest(before, word), return_index=True, return_inverse=True)
            n = [np.bincount(at, weights=c) for c in counts]
            before, word = before[first], word[first]
            hot_before, hot_word = before < RARE, word < RARE
            _, context = np.unique(before[~hot_before], return_inverse=True)
            order = np.argsort(asked.column("word").to_numpy().view(np.uint64) | RARE)
            place = order[np.searchsorted((asked.column("word").to_numpy().view(np.uint64) | RARE)[order], word[~hot_word])]
            loss = np.zeros(len(first))
            for k, sign in ((0, 1), (1, -1)):
                after, alone = np.zeros(len(first)), np.zeros(len(first))
                after[hot_before] = shared.value[1][2 + k][before[hot_before].astype(np.int64)]
                after[~hot_before] = np.bincount(context, weights=n[k][~hot_before])[context] if len(context) else 0
                alone[hot_word] = shared.value[1][k][word[hot_word].astype(np.int64)]
                alone[~hot_word] = asked.column(COUNTS[k]).to_numpy()[place]
                p = (alone + 1) / (sums[k] + n_words) * np.where(after > 0, 1 - WEIGHT, 1.0)
                loss += sign * np.log(p + WEIGHT * n[k] / np.maximum(after, 1))
            done = 0
            for s in shares:
                mine = loss[at[done : done + len(s[0])]]
                done += len(s[0])
                some = np.unique(s[5])
                sums_of.append(_packed([some, np.bincount(s[5], weights=np.repeat(mine, s[4]) * s[6])[some]]))
        found = rest.drop(["bucket", "data"]).append_column("data", pa.array(sums_of, pa.binary()))
        return pa.concat_tables([there, found.cast(there.schema)])

    def gather(share: pa.Table) -> pa.Table:
        there = share.filter(share.column("data").is_null())
        total, n = np.zeros(there.num_rows), there.column("n_tokens").to_numpy()
        for data in share.column("data").drop_null().to_pylist():
            some, sums = _unpacked(data, [np.uint32, np.float64])
            total[some] += sums
        total = total[there.column("doc").to_numpy()]
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        return pa.table([there.column("doc_id"), pa.array(n), pa.array(total), mean], names=["doc_id", "n_tokens", "loss_difference", "score"])

    dealt = docs.select("doc_id", "text", "target").mapInArrow(deal, f"bucket int, first long, doc long, doc_id {kind}, n_tokens long, data binary")
    asked = docs.select("text").mapInArrow(ask, "bucket int, word long").distinct().join(words.select("word", *COUNTS[:2]).hint("merge"), "word").select("bucket", "word", *COUNTS[:2])
    parts = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(sum_up, f"first long, doc long, doc_id {kind}, n_tokens long, data binary")
    return parts.groupBy("first").applyInArrow(gather, f"doc_id {kind}, n_tokens long, loss_difference double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    return score_all(docs.join(good.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")))
