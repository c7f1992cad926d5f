"""Benchmark decontamination: a generalised suffix automaton of the test items, through which training words stream.

The automaton's symbols are words. A document word that no item has leads back to its root with length 0, and so
does a pair of neighbours that no item has; numpy finds the stretches between such places for a whole Arrow batch at
a time, and only those stretches, where a match of the wanted length can lie, are walked word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read_table, slices, text_column
from .wordbytes import LOWER, Words, words_of

WINDOW = 10
#: Words of items in one automaton, counted as if every second character began one; more items are taken in several
#: passes, so that what is broadcast stays bounded: about 1.3 KB an item word were measured, so at most 390 MB in a
#: worker, and 130 MB where words have five letters.
BLOCK_WORDS = 300_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words (bytes), knowing in which items each window occurs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        here: list[set] = [set()]
        short: list[set] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w, here, short)
                here[last].add(item)
            if 0 < len(words) < window:
                short[last].add(item)
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in order:  # longest first: what a state holds also ends at its suffix link
            if self.length[self.link[s]] >= window:
                here[self.link[s]] |= here[s]
        #: for each state, the state of its last `window` words, or -1
        self.at_window = [-1] * len(self.link)
        #: for each state, the complete short items that end there, as (number of words, item)
        self.short: list[tuple] = [()] * len(self.link)
        for s in reversed(order):
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.short[s] = tuple((self.length[s], i) for i in short[s]) + self.short[up]
        self.items = [frozenset(x) if self.at_window[s] == s else frozenset() for s, x in enumerate(here)]

    def _extend(self, last: int, w: bytes, here: list, short: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w, here, short)
        cur = self._state(length[last] + 1, {}, here, short)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w, here, short)
        return cur

    def _state(self, length: int, to: dict, here: list, short: list) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(0)
        here.append(set())
        short.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: bytes, here: list, short: list) -> int:
        """A state for the words of q that are no longer than p's and w."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), here, short)
        self.link[clone] = self.link[q]
        here[clone] |= here[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def walk(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset]]:
        """(first word, end, items) of each window occurrence, by the longest match that ends at each word."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                length = 0
                continue
            if length >= self.window:
                yield i + 1 - self.window, i + 1, self.items[self.at_window[state]]
            for n, item in self.short[state]:
                if n <= length:
                    yield i + 1 - n, i + 1, frozenset([item])


class Scanner:
    """The automaton with sorted hashes of its words and pairs, for finding the stretches worth walking."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        texts = [(t or "").encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        words = words_of(data, offsets) if len(data) else words_of(np.zeros(0, np.uint8), offsets)
        lowered = LOWER[data].tobytes()
        spelled = [lowered[s:e] for s, e in zip(words.starts, words.ends, strict=True)]
        of = [(i, spelled[a:b]) for (i, _), a, b in zip(items, words.first[:-1], words.first[1:], strict=True)]
        self.automaton = SuffixAutomaton(of, window)
        self.vocabulary = np.unique(words.hashes)
        same = words.row[:-1] == words.row[1:]
        self.pairs = np.unique(pair_hash(words.hashes)[same]) if len(words) > 1 else np.zeros(0, np.uint64)
        self.least = min([window, *(len(w) for _, w in of if w)])
        # a bitmap over 22 bits of the hash spares most binary searches
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.vocabulary >> np.uint64(42)).astype(np.int64)] = True

    def stretches(self, words: Words) -> Iterator[tuple[int, int]]:
        """[from, to) of words, in one text, that are all in the vocabulary with all neighbours paired in some item."""
        if not len(words) or not len(self.vocabulary):
            return
        known = self.maybe[(words.hashes >> np.uint64(42)).astype(np.int64)]
        some = np.flatnonzero(known)
        known[some] = among(words.hashes[some], self.vocabulary)
        join = known[:-1] & known[1:] & (words.row[:-1] == words.row[1:])
        some = np.flatnonzero(join)
        join[some] = among(words.hashes[some] * _P + words.hashes[some + 1], self.pairs)
        if self.least <= 1:
            starts = np.flatnonzero(known & ~np.concatenate([[False], join]))
            ends = np.flatnonzero(known & ~np.concatenate([join, [False]])) + 1
        else:
            edge = np.diff(np.concatenate([[0], join.astype(np.int8), [0]]))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        for k in np.flatnonzero(ends - starts >= self.least):
            yield int(starts[k]), int(ends[k])


_P = np.uint64(0xD1342543DE82EF95)


def pair_hash(h: np.ndarray) -> np.ndarray:
    return h[:-1] * _P + h[1:]


def among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


HITS = T.StructType([
    T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()),
    T.StructField("_items", T.ArrayType(T.StringType())),
    T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("words", T.LongType())]))),
])
_ARROW = [("_n_words", pa.int64()), ("_n_hit", pa.int64()), ("_items", pa.list_(pa.string())), ("_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())])))]


def _blocks(items: DataFrame, most_words: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("string"), "text").where("item_id is not null").toLocalIterator():
        n = (len(r[1] or "") + 1) // 2
        if block and size + n > most_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


def scan(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with _n_words, _n_hit, _items (sorted strings) and _spans (byte offsets and words of the hit stretches).

    A word is hit if it lies in an occurrence of a window: `window` consecutive words of an item, or a whole item of
    fewer. Null and empty texts have no words and no hits; items that are null, empty or without an id match nothing;
    equal items each count; repeated rows are scanned alike; other columns pass unread. An empty table of items or
    documents gives no hits or no rows. Items beyond block_words are scanned in further passes whose hits are merged.
    Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    docs = out = docs.drop(*HITS.names)
    for block in _blocks(items, block_words):
        shared = spark.sparkContext.broadcast(Scanner(block, window))
        first = out is docs
        out = out.mapInArrow(_scan_with(shared, text, first), T.StructType([*docs.schema.fields, *HITS.fields]))
    return out


def _scan_with(shared, text: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = text_column(part, text)
                words = words_of(data, offsets)
                hit, found = np.zeros(len(words), bool), {}
                if not first:
                    _hits_before(part, words, offsets, hit, found)
                for a, b in scanner.stretches(words):
                    lowered = [LOWER[data[s:e]].tobytes() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)]
                    for i, j, items in scanner.automaton.walk(lowered):
                        hit[a + i : a + j] = True
                        found.setdefault(int(words.row[a]), set()).update(items)
                yield _with_hits(part, words, offsets, hit, found, first)

    return run


def _hits_before(part, words, offsets, hit, found) -> None:
    for r, (spans, items) in enumerate(zip(part.column("_spans").to_pylist(), part.column("_items").to_pylist(), strict=True)):
        if items:
            found[r] = set(items)
        for s in spans or ():
            a, b = np.searchsorted(words.starts, [offsets[r] + s["start"], offsets[r] + s["stop"]])
            hit[a:b] = True


def _with_hits(part, words, offsets, hit, found, first) -> pa.RecordBatch:
    n = part.num_rows
    counts = np.diff(words.first)
    hits = np.bincount(words.row[hit], minlength=n) if hit.any() else np.zeros(n, np.int64)
    spans: list[list] = [[] for _ in range(n)]
    if hit.any():
        joined = hit[:-1] & hit[1:] & (words.row[:-1] == words.row[1:])
        for i in np.flatnonzero(hit & ~np.concatenate([[False], joined])):
            j = i
            while j < len(joined) and joined[j]:
                j += 1
            r = int(words.row[i])
            spans[r].append({"start": int(words.starts[i] - offsets[r]), "stop": int(words.ends[j] - offsets[r]), "words": int(j - i + 1)})
    new = [counts, hits, [sorted(found.get(r, ())) for r in range(n)], spans]
    own = [(f, c) for f, c in zip(part.schema, part.columns, strict=True) if first or f.name not in {k for k, _ in _ARROW}]
    return pa.RecordBatch.from_arrays([c for _, c in own] + [pa.array(v, t) for v, (_, t) in zip(new, _ARROW, strict=True)], schema=pa.schema([f for f, _ in own] + [pa.field(k, t) for k, t in _ARROW]))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs without the stretches that items share; documents with over max_coverage of their words hit go altogether.

    The columns stay as they are; only the text of contaminated rows changes: each hit stretch is cut out, and one
    blank stands for it. Clean rows, null and empty texts, and columns named like those of scan pass unchanged.
    """
    clashing = {c: f"_own{c}" for c in docs.columns if c in HITS.names}
    hits = scan(docs.withColumnsRenamed(clashing), items, text, window).where(F.col("_n_hit") <= F.lit(max_coverage) * F.col("_n_words"))
    return _cut(hits, text).drop(*HITS.names).withColumnsRenamed({b: a for a, b in clashing.items()}).select(*docs.columns)


def _cut(hits: DataFrame, text: str) -> DataFrame:
    whole, spans = F.encode(F.col(text), "UTF-8"), F.col("_spans")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.decode(F.substring(whole, F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0).cast("int") + 1,
                                       F.greatest(F.lit(0), F.coalesce(F.get(spans, i)["start"], F.octet_length(F.col(text)).cast("bigint")) - F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0)).cast("int")), "UTF-8"),
    )
    return hits.withColumn(text, F.when(F.size(spans) > 0, F.array_join(kept, " ")).otherwise(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = scan(docs, read_table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
        F.to_json(F.col("_spans")).alias("spans"),
    )


def brute_force(texts: dict, items: dict, window: int = WINDOW) -> dict:
    """By comparing every window with every place, for small tables: doc_id -> (n_words, n_hit, items, digest)."""
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items.items():
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        ids = sorted(found)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
    return out
