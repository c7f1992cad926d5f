"""Periodic runs of words, found from Lyndon words in both orders of the alphabet.

A run is a stretch that repeats with a period and can't be longer. Its root, in one of the two orders, is the longest
Lyndon word at each place where it begins in the run; so the lengths of the longest Lyndon words at all places tell every
run. They come from the first phase of Baier's suffix sorter, which groups places by these words and never sorts
suffixes: groups are taken from the greatest down; the nearest place to the left of a group's places that is in a lesser
group has its word lengthened by theirs, and moves into a group of its own just above the one it was in. All texts
of a batch, each in both orders, take their greatest groups at the same time, as arrays. Roots that recur are then
extended to both sides by longest common extensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read_table, text_or_empty

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
#: Words of the texts that are grouped at a time (a longer text is grouped alone), and words compared at a time.
GROUPED, COMPARED = 3_000_000, 2_000_000


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=starts.dtype)


class _Grouping:
    """Places of several texts, in groups by the Lyndon words found so far; a text's groups are stretches of slots."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        n = len(codes)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        by = text * (int(codes.max()) + 1) + codes
        self.at = np.argsort(by, kind="stable").astype(np.int32)  # place in each slot
        self.slot = np.empty(n, np.int32)
        self.slot[self.at] = np.arange(n, dtype=np.int32)
        new = np.r_[True, np.diff(by[self.at]) != 0]
        begin = np.flatnonzero(new).astype(np.int32)
        self.group = np.empty(n, np.int32)  # first slot of each place's group
        self.size = np.zeros(n, np.int32)  # of the group that begins in a slot
        self.size[begin] = np.diff(np.r_[begin, n])
        self.group[self.at] = np.repeat(begin, self.size[begin])
        self.length = np.ones(n, np.int32)
        # Neighbours among places whose groups are still to come; n stands for none.
        self.left, self.right = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
        self.left[first[:-1]] = n
        self.right[first[1:] - 1] = n
        self.moving = np.zeros(n, bool)

    def take(self, begin: np.ndarray, end: np.ndarray) -> None:
        """Take the groups in these slots, one a text: lengthen and move the places before them."""
        none = len(self.slot)
        places = self.at[begin] if len(begin) and int((end - begin).max()) == 1 else np.sort(self.at[_spread(begin, end - begin)])
        left = self.left[places]
        head = np.flatnonzero(np.r_[True, left[1:] != places[:-1]])
        times = np.diff(np.r_[head, len(places)]).astype(np.int32)
        before, last = left[head], places[head + times - 1]
        after = self.right[last]
        self.right[before], self.left[after] = after, before
        some = before != none
        before, times, of = before[some], times[some], places[head[some]]
        self.length[before] += times * self.length[of]
        shared = self.size[self.group[before]] > 1
        if shared.any():
            self.move(before[shared], times[shared])

    def move(self, places: np.ndarray, times: np.ndarray) -> None:
        """To the ends of their groups' slots, in new groups by how many times their words were lengthened."""
        order = np.lexsort((times, self.group[places]))
        places, times = places[order], times[order]
        group = self.group[places]
        other = np.r_[True, group[1:] != group[:-1]]
        begin = np.flatnonzero(other)
        count = np.diff(np.r_[begin, len(places)]).astype(np.int32)
        groups = group[begin]
        tail = groups + self.size[groups] - count
        to = _spread(tail, count)
        was = self.slot[places]
        self.moving[places] = True
        there = self.at[to]
        pushed = there[~self.moving[there]]
        vacant = was[was < np.repeat(tail, count)]
        self.at[vacant], self.slot[pushed] = pushed, vacant
        self.at[to], self.slot[places] = places, to
        self.moving[places] = False
        self.size[groups] -= count
        own = np.flatnonzero(other | np.r_[True, times[1:] != times[:-1]])
        sizes = np.diff(np.r_[own, len(places)]).astype(np.int32)
        self.size[to[own]] = sizes
        self.group[places] = np.repeat(to[own], sizes)


def lyndon_lengths(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place of the texts that begin at `first` (which ends with their end)."""
    if not len(codes):
        return np.zeros(0, np.int32)
    first = np.unique(first)  # texts without words have no place
    state = _Grouping(codes, first)
    begin, top = first[:-1].astype(np.int32), first[1:].astype(np.int32)
    while len(top):
        low = state.group[state.at[top - 1]]
        state.take(low, top)
        going = low > begin
        begin, top = begin[going], low[going]
    return state.length


def _alike(codes: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
    """How many words are the same from places a and b on (step -1: backwards), room at most."""
    out = np.zeros(len(a), np.int64)
    going, block = np.flatnonzero(room > 0), 8
    while len(going):
        unfinished = []
        for some in np.array_split(going, -(-len(going) * block // COMPARED)):
            here = np.minimum(room[some] - out[some], block)
            offset = _spread(np.zeros(len(some), np.int64), here)
            on = step * (np.repeat(out[some], here) + offset)
            differs = codes[np.repeat(a[some], here) + on] != codes[np.repeat(b[some], here) + on]
            same = np.minimum.reduceat(np.where(differs, offset, np.repeat(here, here)), np.cumsum(here) - here)
            out[some] += same
            unfinished.append(some[(same == here) & (out[some] < room[some])])
        going, block = np.concatenate(unfinished), min(block * 4, COMPARED)
    return out


def runs_of(codes: np.ndarray, first: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of at least so many words and periods, by text, start and period."""
    n_texts, n = len(first) - 1, len(codes)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    both = np.concatenate([codes, codes.max() - codes])
    found = lyndon_lengths(both, np.concatenate([first, first[1:] + n]))
    text = np.repeat(np.arange(n_texts), np.diff(first))
    end, begin = first[1:][text], first[:-1][text]
    # A run of e periods has at least e - 1 whole roots one after the other.
    roots = max(1, int(least_exponent) - 1)
    parts = []
    for length in (found[:n], found[n:]):
        at = np.flatnonzero(np.arange(n) + roots * length.astype(np.int64) <= end)
        for k in range(1, roots):
            there = at + k * length[at].astype(np.int64)
            at = at[(length[there] == length[at]) & (codes[there] == codes[at])]
        p = length[at].astype(np.int64)
        whole = (roots - 1) * p
        same = _alike(codes, at, at + p, 1, whole) == whole
        at, p = at[same], p[same]
        if roots > 1:  # the first of the places that share a run
            valid = np.zeros(n, bool)
            valid[at] = True
            earlier = np.maximum(at - p, 0)
            leftmost = ~((at - p >= begin[at]) & valid[earlier] & (length[earlier] == p))
            at, p = at[leftmost], p[leftmost]
        on = at + roots * p
        to = on + _alike(codes, on, on - p, 1, end[at] - on)
        start = at - _alike(codes, at - 1, at - 1 + p, -1, at - begin[at])
        parts.append(np.stack([text[at], start, to - start, p], 1))
    rows = np.unique(np.concatenate(parts), axis=0)
    rows = rows[(rows[:, 2] >= least_length) & (rows[:, 2] >= least_exponent * rows[:, 3])]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1] - first[rows[:, 0]], rows[:, 2], rows[:, 3]


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """The batch in parts of about GROUPED words, with each part's words and where its texts begin in them."""
    lists = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), GROUPED, "right")))
        words = pc.fill_null(pc.list_flatten(lists.slice(at, to - at)), "")
        yield batch.slice(at, to - at), words, np.r_[0, np.cumsum(sizes[at:to])]
        at = to


def with_runs(texts: DataFrame, words: str = "words", runs: str = "runs", collapsed: str = "collapsed", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """texts with their runs (start, length, period in words, by start and period) and what is left of the words.

    words: an array of strings; what is left are the words that no run has after its first period, joined by blanks,
    in place of the words. Null and empty arrays have no runs and leave an empty text, a null word counts as an empty
    one; rows that repeat, ties and nulls in other columns pass as they are, columns named like the new ones are
    replaced, an empty table gives none. A long text is grouped whole, in memory and time that grow with its words.
    """
    texts = texts.drop(*({runs, collapsed} - {words}))
    schema = T.StructType([*(f for f in texts.schema.fields if f.name != words), T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, first in chain.from_iterable(_texts(b, words) for b in batches):
            coded = flat.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            text, start, length, period = runs_of(codes, first, least_length, least_exponent)
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, first[text] + start + period, 1)
            np.add.at(gone, first[text] + start + length, -1)
            kept = np.cumsum(gone[:-1]) == 0
            ends = np.r_[0, np.cumsum(kept)][first]
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(kept))), " ")
            rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], names=["start", "length", "period"])
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(first))), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in schema.names[:-2]), found, left], names=schema.names)

    return texts.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    """The words between blanks, tabs and line ends, as an array; none for null."""
    blanks = F.translate(text_or_empty(text), "\t\n\x0b\x0c\r", " " * 5)
    return F.array_remove(F.split(blanks, " ", -1), "")


def with_period(words: Column, begin: Column, period: Column) -> Column:
    """words, those from number `begin` on being the next `period` ones over and over."""
    on = F.transform(F.sequence(begin, F.size(words) - 1), lambda i: F.get(words, (begin + (i - begin) % period).cast("int")))
    return F.concat(F.slice(words, F.lit(1), begin.cast("int")), on)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which one in ten (by crc32 of its id) has its words repeat from some place on."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("words"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    begin = g % n
    period = 1 + F.floor((n - begin) / (3 + g % 8))
    repeated = F.when((F.col("h") % 10 == 0) & (n > 0), with_period(F.col("words"), begin, period)).otherwise(F.col("words"))
    found = with_runs(docs.select("doc_id", repeated.alias("words")))
    longest = F.aggregate(
        "runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )
    rows = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(rows, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
