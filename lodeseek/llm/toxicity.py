"""Toxicity by compression distance: windows of words are compressed with a dictionary of toxic and one of ordinary text.

zstandard trains both dictionaries: a base on ordinary windows, which both have, and for each class a part trained on
what sets its windows apart, the segments of words that its documents use significantly more often. (Trained on plain
windows of each class, dictionaries hold little but what the classes have in common; README has the figures.) A window
that compresses shorter with the toxic dictionary by some bytes is evidence, and a logistic fit on the counts at
several thresholds calibrates them to a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, slices, text_or_empty

#: Words in a window, of two sizes; characters of a segment's least part; bytes of the base and of a class's own part.
WINDOWS, PART, COMMON, OWN = (8, 13), 5, 8000, 2000
#: Bounds of the labelled sample that is fitted: documents of each class, and their longest text in characters.
SAMPLE = {1: 1000, 0: 2000}
LONGEST = 20_000
#: Windows of that sample that the base is trained on, evenly spaced.
TRAINED_ON = 100_000
#: Bytes saved at which windows are counted.
MARGINS = (2, 3, 4, 5, 6, 8)
OF_WINDOW = [*(f"m{m}" for m in MARGINS), "most", "mean", "sum"]
FEATURES = [*(f"w{w}_{x}" for w in WINDOWS for x in OF_WINDOW), "log_windows"]

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    bias: float

    def score(self) -> Column:
        z = F.lit(self.bias)
        for name, w in zip(FEATURES, self.weights, strict=True):
            z = z + F.lit(w) * F.col(name)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def windows_of(words: list[str], size: int) -> list[bytes]:
    return [" ".join(words[i : i + size]).encode() for i in range(0, len(words), size)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=64, dict_size=len(dictionary), min_match=6, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def _parts(text: str) -> set[str]:
    found = set()
    for w in set(_LETTERS.findall(text.lower())):
        w = f" {w} "
        found.update(w[i : i + PART] for i in range(len(w) - PART + 1))
    return found


def distinctive(own: list[str], other: list[str], least_z: float = 6.0) -> set[str]:
    """Parts of words that occur in significantly more of the own texts than of the other ones."""
    mine, theirs = Counter(), Counter()
    for t in own:
        mine.update(_parts(t))
    for t in other:
        theirs.update(_parts(t))
    n, m = len(own), len(other)

    def marked(part: str) -> bool:
        a, b = mine[part], theirs[part]
        if a < 4 or a / n < 4 * (b + 0.5) / m:
            return False
        p = (a + b) / (n + m)
        return (a / n - b / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m) + 1e-12) > least_z

    return {x for x in mine if marked(x)}


def segments(word: str, parts: set[str]) -> str:
    """What neighbouring parts of the given ones cover of a word, its ends marked by blanks."""
    word, out, upto = f" {word} ", "", -1
    for i in range(len(word) - PART + 1):
        if word[i : i + PART] in parts:
            out += word[max(i, upto) : i + PART]
            upto = i + PART
    return out


def trained(samples: list[bytes], most: int) -> bytes:
    """The content of a dictionary trained on samples, at most a half of them; the samples where they are too few."""
    size = min(most, sum(map(len, samples)) // 2)
    try:
        return zstandard.train_dictionary(size + 200, samples, k=16, d=6).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-most:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The dictionaries of both classes: the base trained on ordinary windows, then each class's own part."""
    windows = [w for t in ordinary for w in windows_of(t.lower().split(), WINDOWS[0])]
    base = trained(windows[:: len(windows) // TRAINED_ON + 1], COMMON)
    out = []
    for own, other in ((toxic, ordinary), (ordinary, toxic)):
        parts = distinctive(own, other)
        found = ("".join(segments(w, parts) for w in _LETTERS.findall(x.decode())) for t in own for x in windows_of(t.lower().split(), WINDOWS[0]))
        out.append(base + trained([x.encode() for x in found if x], OWN))
    return out[0], out[1]


def margins(docs: DataFrame, toxic: bytes, ordinary: bytes, text: str = "text") -> DataFrame:
    """docs with _n_windows and, of the bytes that the toxic dictionary saves in the windows of each size, the features.

    m2 to m8: windows that save so many, over the root of the number of windows; most: the best one's, from 0 to 12;
    mean: that of all; sum: that of what each saves beyond 2, up to 9, over the same root. log_windows: of the larger
    size. Null and empty texts have no windows and zeros.
    """
    names = ["_n_windows", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_toxic, with_ordinary = compressor(toxic), compressor(ordinary)
        at_least = np.array(MARGINS)
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                out = np.zeros((part.num_rows, len(names)))
                for i, t in enumerate(part.column(part.schema.get_field_index(text)).to_pylist()):
                    words, row = (t or "").lower().split(), []
                    if not words:
                        continue
                    for size in WINDOWS:
                        parts = windows_of(words, size)
                        saved = np.array([len(with_ordinary.compress(x)) - len(with_toxic.compress(x)) for x in parts])
                        root = math.sqrt(len(parts))
                        row += [*((saved[:, None] >= at_least).sum(0) / root), min(max(saved.max(), 0), 12), saved.mean(), np.clip(saved - 2, 0, 7).sum() / root]
                    out[i] = [-(-len(words) // WINDOWS[0]), *row, math.log(1 + len(parts))]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[:, k]) for k in range(len(names)))], names=[*part.schema.names, *names])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(x, DoubleType()) for x in names)]))


def learning(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model | None:
    """Learn from a bounded sample of labelled rows, chosen by a hash of their ids; None if a class has none.

    docs: doc_id, text; labels: doc_id, toxic. Rows whose crc32(doc_id) mod 5 is 0, null labels and empty texts are not
    learned from; of a text over LONGEST a piece of that length is, from a place that a hash of the text gives; of
    contrary labels of one id the toxic one counts, of several texts the least. The logistic fit is made on the texts
    that the dictionaries were trained on.
    """
    spark, sample = docs.sparkSession, sample or SAMPLE
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learning()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.where("_toxic = 1").limit(2 * sample[1]).union(known.where("_toxic = 0").limit(2 * sample[0]))
    chosen = spark.createDataFrame(chosen.collect(), "doc_id long, _toxic int")  # at most 2 ids a document sampled
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0)
    at = (1 + F.pmod(F.xxhash64("text"), F.length("text") - LONGEST + 1)).cast("int")
    texts = texts.withColumn("text", F.when(F.length("text") <= LONGEST, F.col("text")).otherwise(F.substr("text", at, F.lit(LONGEST))))
    texts = texts.groupBy("doc_id", "_toxic").agg(F.min("text").alias("text"))  # so no more rows than ids were chosen
    rows = sorted({(r["_toxic"], r["text"]) for r in texts.collect()}, key=lambda r: hash_of(r[1]))
    of = {k: [t for y, t in rows if y == k][: sample[k]] for k in (0, 1)}
    if not of[0] or not of[1]:
        return None
    toxic, ordinary = dictionaries(of[1], of[0])
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    fitted = spark.createDataFrame([(float(y), t) for y in (0, 1) for t in of[y]], "label double, text string")
    n, m = (known.where(f"_toxic = {y}").count() for y in (0, 1))
    rated = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(margins(fitted, toxic, ordinary))
    rated = rated.withColumn("weight", F.when(F.col("label") == 1, m / len(of[1])).otherwise(n / len(of[0])) * (len(rows) / (n + m)))
    lr = LogisticRegression(regParam=1e-3, maxIter=50, weightCol="weight").fit(rated)
    return Model(toxic, ordinary, tuple(map(float, lr.coefficients)), float(lr.intercept))


def hash_of(text: str) -> bytes:
    import hashlib

    return hashlib.md5(text.encode()).digest()


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with _n_windows and _score (0 to 1). Without a model every score is 0; an empty text gets the fit's value for no evidence.

    Whole texts are read, one Arrow batch after the other; repeated rows get equal scores; other columns pass unread.
    """
    if model is None:
        return docs.withColumn("_n_windows", F.lit(0.0)).withColumn("_score", F.lit(0.0))
    narrow = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    rated = margins(narrow, model.toxic, model.ordinary, "_text")
    return rated.select(*[F.col("_row")[c].alias(c) for c in docs.columns], "_n_windows", model.score().alias("_score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs whose score is below the threshold; columns and texts unchanged."""
    return score(docs, fit(docs, labels)).where(F.col("_score") < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = score(docs.withColumn("text", text_or_empty("text")), fit(docs, read_table(spark, sf_dir, "labels")))
    return rated.select("doc_id", F.coalesce(~learning(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_n_windows").cast("long").alias("n_windows"))
