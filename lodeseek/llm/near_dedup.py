"""MinHash near-dedup by ProbMinHash: probability Jaccard of five-word shingles weighted by their counts.

Each shingle is a Poisson process whose rate is its count; every arrival falls on one of the signature's components,
and each component keeps its earliest arrival. A shingle stops once its next arrival is later than every component's
(early termination). Two texts agree on a component with a probability that is their probability Jaccard, which for
texts without repeated shingles is plain Jaccard. Bands of five components give candidates; candidates are verified
by the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, read_table, slices, stored, text_column, text_or_empty
from .wordbytes import Words, mix64, powers, sequence_digest, windows, words_of

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 25, 5, 0.8
#: A pair whose signatures agree on a smaller part isn't verified: at 0.8 that is four standard deviations away. With 0
#: every pair that shares a band is.
HOPEFUL = 0.66
#: Pairs of bands for each of their rows beyond which pivots are taken first; rows beyond which a band is compared in
#: blocks; rows of a chunk, and bytes of its texts.
PAIRS_A_ROW, LARGE, CHUNK, CHUNK_BYTES = 4, 64, 1000, 4 << 20


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted; a text of fewer words, but not none, is one shingle."""
    n_rows, counts = len(words.first) - 1, np.diff(words.first)
    all_of = windows(words.hashes, size)
    inside = words.row[: len(all_of)] == words.row[size - 1 :] if len(all_of) else np.zeros(0, bool)
    row, value = words.row[: len(all_of)][inside], all_of[inside]
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        row = np.concatenate([row, few])
        value = np.concatenate([value, sequence_digest(words, 5)[few]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.concatenate([at, [len(row)]]))


def probminhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signatures (n_rows, m) of weighted sets, 0 for an empty one, by vectorised rounds of arrivals."""
    first, signature = np.full((n_rows, m), np.inf), np.zeros((n_rows, m), np.uint64)
    times, holders = first.reshape(-1), signature.reshape(-1)
    alive_row, alive, rate, t, j = row, element, weight.astype(float), np.zeros(len(row)), 0
    latest = np.full(n_rows, np.inf)
    while len(alive):
        j += 1
        step = np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        draw = mix64(alive ^ step)
        t = t - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        keep = t < latest[alive_row]
        alive_row, alive, rate, t, draw = alive_row[keep], alive[keep], rate[keep], t[keep], draw[keep]
        if not len(alive):
            break
        cell = alive_row * m + (mix64(draw + np.uint64(j)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(times, cell, t)
        won = times[cell] == t
        holders[cell[won]] = alive[won]
        some = np.unique(alive_row)
        latest[some] = first[some].max(axis=1)
        keep = t < latest[alive_row]
        alive_row, alive, rate, t = alive_row[keep], alive[keep], rate[keep], t[keep]
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for k, p in enumerate(powers(rows, np.uint64(0xBF58476D1CE4E5B9))):
        keys += mix64(signature[:, k::rows][:, :bands]) * p
    return mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, d1, d2, n_words, keys, sketch): digests of the word sequence, band keys, and 8 bits of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = words_of(*text_column(part, "text"))
                signature = probminhash(*shingles(words), part.num_rows, bands * rows)
                keys, n = band_keys(signature, bands, rows).view(np.int64), part.num_rows
                whole = lambda x, k, kind: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(x.reshape(-1), kind))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sequence_digest(words, 1).view(np.int64)), pa.array(sequence_digest(words, 2).view(np.int64)), pa.array(np.diff(words.first).astype(np.int64)),
                     whole(keys, bands, pa.int64()), whole((signature >> np.uint64(32)).astype(np.uint8).view(np.int8), bands * rows, pa.int8())],
                    names=["doc_id", "d1", "d2", "n_words", "keys", "sketch"],
                )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, d1 long, d2 long, n_words long, keys array<long>, sketch array<tinyint>")


def similarity(x: dict[int, int] | tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two (sorted elements, weights)."""
    (ex, wx), (ey, wy) = x, y
    both, ix, iy = np.intersect1d(ex, ey, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    px, py = wx[ix].astype(float), wy[iy].astype(float)
    only_x, only_y = wx.sum() - px.sum(), wy.sum() - py.sum()
    ratio = py / px
    order = np.argsort(ratio, kind="stable")
    px, py, ratio = px[order], py[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    sum_x = np.concatenate([[0], np.cumsum(px)])[upto] + only_x
    sum_y = py.sum() - np.concatenate([[0], np.cumsum(py)])[upto] + only_y
    return float((1 / (sum_x / px + sum_y / py)).sum())


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) whose whole texts' similarity is at least that; texts: (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            keep, sims = [], []
            for part in slices(batch, "text_a", 1 << 20):
                a, b = (words_of(*text_column(part, c)) for c in ("text_a", "text_b"))
                (ra, ea, wa), (rb, eb, wb) = shingles(a), shingles(b)
                cut_a, cut_b = (np.searchsorted(r, np.arange(part.num_rows + 1)) for r in (ra, rb))
                for i in range(part.num_rows):
                    s, t = slice(cut_a[i], cut_a[i + 1]), slice(cut_b[i], cut_b[i + 1])
                    sims.append(similarity((ea[s], wa[s]), (eb[t], wb[t])))
            keep = pa.array([s >= least for s in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    joined = joined.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _hopeful_pairs(rows: DataFrame, bands: DataFrame, hopeful: float) -> DataFrame:
    """(a, b): pairs of different classes that share a band and agree on enough of their sketches, once each.

    The conditions stand in the join, so a pair that fails isn't made into a row; a pair is taken in the smallest key
    that it shares.
    """
    own = rows.join(bands.select("key").hint("merge"), "key", "left_semi")
    left = own.select("key", F.col("rep").alias("a"), F.col("class").alias("class_a"), F.col("keys").alias("keys_a"), F.col("sketch").alias("sketch_a"))
    right = own.select(F.col("key").alias("_key"), F.col("rep").alias("b"), F.col("class").alias("class_b"), F.col("keys").alias("keys_b"), F.col("sketch").alias("sketch_b"))
    agreeing = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, e: n + e)
    same = (F.col("key") == F.col("_key")) & (F.col("a") < F.col("b")) & (F.col("class_a") != F.col("class_b"))
    first = F.filter(F.zip_with("keys_a", "keys_b", lambda x, y: F.when(x == y, x)), lambda k: k.isNotNull())
    enough = (agreeing >= int(hopeful * BANDS * ROWS)) & (F.col("key") == F.array_min(first))
    return left.join(right.hint("merge"), same & enough).select("a", "b")


def _block_links(rows: DataFrame, bands: DataFrame, texts: DataFrame, least: float, hopeful: float) -> DataFrame:
    """(a, b, similarity): verified links that join the classes within large bands, found in blocks of their rows.

    The rows of a band's largest class and its other rows are cut into chunks, by rows and by bytes. Each chunk of the
    others meets each chunk of either kind, as one group of bounded size; two chunks of the largest class never meet.
    There the sketches are compared as matrices, and pairs in the smallest key they share are verified from the
    likeliest on, unless links found before have joined their classes: so no pair becomes a row unless it is a link
    that joins two classes.
    """
    own = rows.join(bands.select("key").hint("merge"), "key", "left_semi").join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    own = stored(own, "large")
    sizes = own.groupBy("key", "class").agg(F.count("*").alias("size"), F.sum(F.octet_length("text")).alias("bytes"))
    plan = sizes.groupBy("key").agg(F.max_by(F.struct("class", "size", "bytes"), F.struct("size", -F.col("class"))).alias("top"), F.sum("size").alias("size"), F.sum("bytes").alias("bytes"))
    chunks = lambda size, of: F.greatest(F.ceil(size / CHUNK), F.ceil(of / CHUNK_BYTES), F.lit(1)).cast("int")
    plan = plan.select("key", F.col("top.class").alias("largest"), chunks(F.col("top.size"), F.col("top.bytes")).alias("n_largest"), chunks(F.col("size") - F.col("top.size"), F.col("bytes") - F.col("top.bytes")).alias("n_others"))
    plan = stored(plan, "chunks")
    own = own.join(plan.hint("merge"), "key").withColumn("other", F.col("class") != F.col("largest"))
    own = own.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.when(F.col("other"), F.col("n_others")).otherwise(F.col("n_largest"))).cast("int"))
    # chunks of the others are 0, 1, ...; those of the largest class -1, -2, ...
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    meets = F.when(F.col("other"), F.concat(upto(F.col("n_others")), F.transform(upto(F.col("n_largest")), lambda x: -1 - x))).otherwise(upto(F.col("n_others")))
    dealt = own.withColumn("chunk", F.when(F.col("other"), F.col("chunk")).otherwise(-1 - F.col("chunk"))).select("key", "rep", "class", "keys", "sketch", "text", "chunk", F.explode(meets).alias("meets"))
    dealt = dealt.withColumn("i", F.least("chunk", "meets")).withColumn("j", F.greatest("chunk", "meets")).drop("meets")
    dealt = dealt.repartition("key", "i", "j")  # else all blocks of a band stay where its join put them

    def run(block):
        import pandas as pd

        key, i, j = block["key"].iloc[0], block["i"].iloc[0], block["j"].iloc[0]
        ids, parts, chunk = block["rep"].to_numpy(), block["class"].to_numpy(), block["chunk"].to_numpy()
        keys, sketch = np.stack(block["keys"].to_numpy()), np.stack(block["sketch"].to_numpy())
        raw = [t.encode() for t in block["text"]]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        row, element, count = shingles(words_of(np.frombuffer(b"".join(raw), np.uint8), offsets))
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        agreeing = np.zeros((len(left), len(right)), np.uint8)
        for c in range(sketch.shape[1]):
            agreeing += sketch[left, c][:, None] == sketch[right, c][None, :]
        enough = (agreeing >= int(hopeful * BANDS * ROWS)) & (parts[left][:, None] != parts[right][None, :])
        x, y = np.nonzero(enough & (ids[left][:, None] < ids[right][None, :])) if i == j else np.nonzero(enough)
        order = np.argsort(-agreeing[x, y].astype(int), kind="stable")
        x, y = left[x[order]], right[y[order]]
        class_of = {c: c for c in parts}

        def top(c):
            while class_of[c] != c:
                class_of[c] = c = class_of[class_of[c]]
            return c

        found = []
        for a, b in zip(x, y, strict=True):
            if top(parts[a]) == top(parts[b]):
                continue
            both = keys[a] == keys[b]
            if keys[a][both].min() != key:
                continue
            sim = similarity((element[cut[a] : cut[a + 1]], count[cut[a] : cut[a + 1]]), (element[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]]))
            if sim >= least:
                class_of[top(parts[a])] = top(parts[b])
                found.append((min(ids[a], ids[b]), max(ids[a], ids[b]), sim))
        return pd.DataFrame(found, columns=["a", "b", "similarity"])

    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, hopeful: float = HOPEFUL) -> DataFrame:
    """(doc_id, class_id): one row for each distinct doc_id. class_id: the smallest id that links reach.

    Texts with equal sequences of words are one class from the start, stood for by the smallest id. Links aren't
    counted: a class is joined by few of its links, and which of them are looked at depends on other groups. Texts
    without words (null, empty) link with nothing; a null doc_id has no row; of repeated rows with one id the text that
    sorts first counts; an empty table gives no rows.

    Where bands have many pairs for their rows, all members of a band are first compared with the one that meets most
    others: what is linked with it is in its class, and only pairs of members in different classes remain. Of these,
    all that share a band are compared by their sketches, and by their whole texts where the sketches leave hope, which
    hopeful=0 leaves to all.
    """
    spark = docs.sparkSession
    sketches = stored(signatures(docs.where(F.col(doc_id).isNotNull()), doc_id, text), "sketches")
    grouped = sketches.where("n_words > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    grouped = stored(grouped.select("d1", "d2", "rep"), "grouped")  # so that both sides of the join are plain shuffles, which Spark splits where they are skewed
    members = sketches.where("n_words > 0").select("doc_id", "d1", "d2").join(grouped.hint("merge"), ["d1", "d2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    members = stored(members.groupBy("doc_id").agg(F.min("rep").alias("rep")), "members")
    reps = members.where("doc_id = rep").select("doc_id")
    rep_sketches = sketches.join(reps.hint("merge"), "doc_id").select("doc_id", "keys", "sketch").dropDuplicates(["doc_id"])
    rows = rep_sketches.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(rows.join(shared.hint("merge"), "key"), "bands")
    degrees = stored(rows.groupBy("rep").agg(F.sum("n").alias("degree")), "degrees")
    at = degrees.select(F.col("rep").alias("doc_id"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).where("doc_id is not null")
    texts = stored(texts.join(at.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    looks = rep_sketches.select(F.col("doc_id").alias("rep"), "keys", "sketch").join(degrees.hint("merge"), "rep")
    rows = stored(rows.select("key", "rep").join(looks.hint("merge"), "rep").withColumn("class", F.col("rep")), "rows")

    links, tested = None, None
    while True:
        sizes = rows.groupBy("key", "class").agg(F.count("*").alias("size"))
        bands = sizes.groupBy("key").agg(F.sum("size").alias("rows"), F.count("*").alias("classes"), F.sum(F.col("size") * F.col("size")).alias("squares")).where("classes > 1")
        bands = stored(bands, "bands")
        n_rows, n_pairs = bands.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum((F.col("rows") * F.col("rows") - F.col("squares")) / 2), F.lit(0))).first()
        if not n_rows:
            break
        last = tested is not None or n_pairs <= PAIRS_A_ROW * n_rows
        in_blocks = None
        if last:
            large = bands.where(F.col("rows") > LARGE)
            pairs = _hopeful_pairs(rows, bands.where(F.col("rows") <= LARGE), hopeful)
            in_blocks = stored(_block_links(rows, large, texts, least, hopeful), "links") if large.limit(1).count() else None
        else:
            pivot = stored(rows.groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("pivot")), "pivots")
            pairs = pivot.join(bands.select("key").hint("merge"), "key", "left_semi").join(rows.select("key", "rep").hint("merge"), "key").where("pivot <> rep")
            pairs = pairs.select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["a", "b"], "left_anti")
        tested = stored(pairs, "pairs")
        found = stored(_verified(tested, texts, least), "links")
        found = found if in_blocks is None else found.union(in_blocks)
        links = found if links is None else links.union(found)
        classes = components(links)
        if last:
            break
        rows = rows.drop("class").join(classes.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("class", F.coalesce("component", "rep")).drop("component")
        rows = stored(rows, "rows")
    if links is None:
        classes = spark.createDataFrame([], "node long, component long")
    of_rep = stored(classes.withColumnRenamed("node", "rep"), "classes")  # a plain scan, so that Spark splits a rep that many share
    for table in (grouped, degrees, texts, rows):
        dropped(table)
    everyone = sketches.select("doc_id").distinct().join(members.hint("merge"), "doc_id", "left")
    return everyone.join(of_rep.hint("merge"), "rep", "left").select("doc_id", F.coalesce("component", "rep", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the document of the smallest id of each near-duplicate class only; columns and other rows unchanged.

    Rows without an id stay; of rows that repeat an id one stays.
    """
    found = near_duplicates(docs, doc_id, text)
    kept = found.where("doc_id = class_id").select(F.col("doc_id").alias("_kept_id"))
    out = docs.join(kept.hint("merge"), F.col(doc_id).cast("long") == F.col("_kept_id"), "left_semi")
    repeated = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").limit(1).count()
    if repeated:
        out = out.groupBy(doc_id).agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(text_or_empty(text))).alias("_row")).select("_row.*")
    return out.unionByName(docs.where(F.col(doc_id).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
