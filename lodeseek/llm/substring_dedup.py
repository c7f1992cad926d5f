"""Substring dedup by hashing the units of lines: the earliest ranked occurrence of a repeated passage stays, others go.

A line (or paragraph) is cut into clauses at punctuation, so that a passage that begins or ends inside a line still has
whole units in common with its other occurrences. From each unit on, as many units as have a given number of words are
hashed as one window, over the ends of lines; digests are grouped globally, and what a repeated window covers goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, slices, stored, text_column, text_or_empty
from .wordbytes import IS_WORD, mix64, powers, words_of

#: Words of a window: shorter passages stay wherever they are, since short lines repeat by chance, as headings or as forms.
WINDOW = 30
# What ends a clause and a sentence, in ASCII and in wide characters.
ENDS = {"clause": (b".,;:!?\n", "。，、；：！？"), "sentence": (b".!?\n", "。！？"), "line": (b"\n", "")}
_BASE = 0xD1342543DE82EF95


def unit_windows(data: np.ndarray, offsets: np.ndarray, unit: str = "clause", window: int = WINDOW):
    """(row, start, stop, digest, digest) of each window: byte offsets in its text of the first and behind the last word.

    A window begins at a unit and has as few units as come to the wanted words; a text's end may leave too few. Wide
    characters count half a word each. Words are lower-cased as far as a to z go; what stands between them is no matter.
    """
    words = words_of(data, offsets, wide_apart=True)
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    ascii_ends, wide_ends = ENDS[unit]
    is_end = np.isin(data, np.frombuffer(ascii_ends, np.uint8))
    for c in wide_ends:
        a, b, d = c.encode()
        is_end[:-2] |= (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == d)
    passed = np.concatenate([[0], np.cumsum(is_end)])[words.starts]
    first = np.flatnonzero(np.concatenate([[True], (passed[1:] != passed[:-1]) | (words.row[1:] != words.row[:-1])]))
    behind = np.concatenate([first[1:], [len(words)]])
    sizes = np.concatenate([[0], np.cumsum(np.where(data[words.starts] >= 0xE3, 1, 2))])
    last = np.searchsorted(sizes[behind], sizes[first] + 2 * window)
    fits = last < len(first)
    fits[fits] = words.row[first[last[fits]]] == words.row[first[fits]]
    begin, end = first[fits], behind[last[fits]]
    row = words.row[begin]
    digests = []
    for salt in (1, 2):
        base = (_BASE + 4 * salt) % 2**64
        inverse = powers(len(words), np.uint64(pow(base, -1, 2**64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words.hashes + np.uint64(salt)) * powers(len(words), np.uint64(base)))])
        digests.append(mix64((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)).view(np.int64))
    return row, words.starts[begin] - offsets[row], words.ends[end - 1] - offsets[row], *digests


def windows(docs: DataFrame, unit: str = "clause", window: int = WINDOW) -> DataFrame:
    """(d1, d2, id, h, start, stop) of each window of docs (doc_id, text); id and h, a digest of the text, rank documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = text_column(part, "text")
                row, start, stop, d1, d2 = unit_windows(data, offsets, unit, window)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), part.column(0).take(at), part.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["d1", "d2", "id", "h", "start", "stop"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"d1 long, d2 long, id {kind}, h long, start int, stop int")


def repeats(docs: DataFrame, unit: str = "clause", window: int = WINDOW) -> DataFrame:
    """(id, h, gone): (start, stop) of the windows to remove, for the documents that have any.

    The first occurrence by (id, digest of the text, place) stays. Rows equal in id and text count as one document.
    Only digests that occur twice are joined back, and the grouping is a partial minimum, so that a passage which a
    third of the corpus shares is never gathered in one task.
    """
    every = windows(docs, unit, window)
    place = F.struct("id", "h", "start")
    first = every.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first.select("d1", "d2", "first"), "first")
    again = every.join(first.hint("merge"), ["d1", "d2"]).where(place != F.col("first"))
    return again.groupBy("id", "h").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))


SPANS = "array<struct<start:bigint,length:bigint>>"


def cut(data: np.ndarray, gone: list[tuple[int, int]]) -> tuple[str, list[dict]]:
    """What is left of a text (UTF-8 bytes) without some stretches of it, and these in code points.

    A stretch goes with the punctuation and blanks behind it in its line, and with the line's end if it fills the line.
    """
    spans: list[list[int]] = []
    for start, stop in sorted(gone):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    raw, kept, removed, at = data.tobytes(), [], [], 0
    for start, stop in spans:
        while stop < len(raw) and raw[stop] != 10 and not IS_WORD[raw[stop]]:
            stop += 1
        if stop < len(raw) and raw[stop] == 10 and (not start or raw[start - 1] == 10):
            stop += 1
        kept.append(raw[at:start])
        removed.append({"start": int(chars[start]), "length": int(chars[stop] - chars[start])})
        at = stop
    return b"".join([*kept, raw[at:]]).decode(), removed


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "clause", window: int = WINDOW) -> DataFrame:
    """docs, its text without repeated passages, with _removed: their offsets in code points of the whole text, and lengths.

    Null text stays null; empty texts, texts without repeats and rows without a rival pass unchanged, a text of which
    nothing remains becomes empty; null ids rank first; other columns pass unread, but one named _removed is replaced.
    """
    from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    gone = repeats(narrow, unit, window).select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("gone").alias("_gone"))
    others = [c for c in docs.columns if c not in (text, "_removed")]
    rows = docs.select(F.struct(*others).alias("_row"), F.col(doc_id).alias("_of"), F.col(text).alias("_text"))
    rows = rows.join(gone.hint("merge"), F.col("_of").eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty("_text")) == F.col("_h")), "left").select("_row", "_text", "_gone")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                data, offsets = text_column(part, "_text")
                texts, removed = part.column(1).to_pylist(), [[]] * part.num_rows
                for i, of_row in enumerate(part.column(2).to_pylist()):
                    if of_row:
                        texts[i], removed[i] = cut(data[offsets[i] : offsets[i + 1]], [(g["start"], g["stop"]) for g in of_row])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(removed, spans)], names=["_row", "_text", "_removed"])

    kinds = StructType([rows.schema["_row"], StructField("_text", StringType()), StructField("_removed", _parse_datatype_string("array<struct<start:bigint,length:bigint>>"))])
    out = rows.mapInArrow(run, kinds)
    return out.select(*[F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c != "_removed"], "_removed")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "clause", window: int = WINDOW) -> DataFrame:
    """docs, its text without the repeated passages; the columns of docs, which may include one named _removed."""
    if "_removed" in docs.columns:
        kept = dedup(docs.withColumnRenamed("_removed", "_removed_before"), doc_id, text, unit, window).drop("_removed")
        return kept.withColumnRenamed("_removed_before", "_removed").select(*docs.columns)
    return dedup(docs, doc_id, text, unit, window).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("_removed").cast("long").alias("n_removed"), F.array_join(F.transform("_removed", lambda s: F.concat_ws("+", s["start"], s["length"])), ",").alias("removed"), "text")


#: The given tables have no wide characters and no blanks but the line feed and the space.
SQL = """
with docs as (select doc_id, text, coalesce(text, '') as whole from documents),
units as (select doc_id, whole, unnest(parts) as part, unnest(range(len(parts))) as pos
          from (select doc_id, whole, regexp_extract_all(whole, '[^.,;:!?\n]*[.,;:!?\n]*') as parts from docs)),
words as (select doc_id, whole, pos, part,
                 regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w,
                 coalesce(sum(length(part)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as place
          from units),
spoken as (select *, len(w) as n, coalesce(sum(len(w)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as before,
                  length(regexp_extract(part, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*')) as lead,
                  length(regexp_extract(part, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$')) as tail
           from words where len(w) > 0),
opened as (select doc_id, whole, before, (place + lead)::bigint as start,
                  string_agg(array_to_string(w, ' '), ' ') over win as said, sum(n) over win as size, max((place + length(part) - tail)::bigint) over win as stop
           from spoken window win as (partition by doc_id order by before range between current row and 29 following)),
ranked as (select *, row_number() over (partition by said order by doc_id, start) as nth from opened where size >= 30),
gone as (select doc_id, start, stop, coalesce(max(stop) over (partition by doc_id order by start rows between unbounded preceding and 1 preceding), -1) as upto from ranked where nth > 1),
islands as (select *, sum((start > upto)::int) over (partition by doc_id order by start rows unbounded preceding) as island from gone),
merged as (select doc_id, island, min(start) as start, max(stop) as stop from islands group by doc_id, island),
wider as (select m.doc_id, island, start, whole,
                 stop + length(regexp_extract(substring(whole, stop + 1), '^[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*')) as stop
          from merged m join docs using (doc_id)),
spans as (select doc_id, island, start, whole,
                 stop + (case when substring(whole, stop + 1, 1) = chr(10) and (start = 0 or substring(whole, start, 1) = chr(10)) then 1 else 0 end) as stop
          from wider),
kept as (select doc_id, island, start, stop, substring(whole, lag(stop, 1, 0) over w + 1, start - lag(stop, 1, 0) over w) as left_of,
                substring(whole, stop + 1) as right_of from spans window w as (partition by doc_id order by island)),
texts as (select doc_id, count(*)::bigint as n_removed, string_agg(start || '+' || (stop - start), ',' order by start) as removed,
                 string_agg(left_of, '' order by start) || max_by(right_of, start) as text from kept group by doc_id)
select doc_id, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed, case when n_removed is null then d.text else t.text end as text
from docs d left join texts t using (doc_id)
"""
