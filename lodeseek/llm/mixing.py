"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is its source's target over its source's size, where wanted weighted by its
importance. The whole part is certain; for the rest documents are ranked by random odds over inclusion odds, and each
source takes the first ones until its words are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, stored, text_or_empty

#: Rows of a source in one bin of ranks; each bin is sorted by a task of its own.
BIN_ROWS = 2_000
#: A table of sources up to so many rows is broadcast, a longer one joined by shuffling.
FEW_SOURCES = 20_000
SEED = 20_240_601


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def fill(rows: DataFrame, by: list[str], size: str, weight: str, total: Column, most: float) -> DataFrame:
    """rows with _level: the level k at which the sum of least(most * size, k * weight) over the group is total.

    Rows fill up in order of most * size / weight; the level is that of the first row that isn't full. Where all are
    full, _level is infinite. by: the group's columns, or none.
    """
    order = Window.partitionBy(*by).orderBy(F.col("_full"), *[F.col(c) for c in rows.columns if c not in by])
    out = rows.withColumn("_full", F.when(F.col(weight) > 0, most * F.col(size) / F.col(weight)).otherwise(F.lit(float("inf"))))
    before = F.coalesce(F.sum(most * F.col(size)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_at", F.when(left > 0, (total - before) / left).otherwise(F.lit(float("inf"))))
    free = F.min(F.when(F.col("_full") >= F.col("_at"), F.struct("_full", "_at"))).over(Window.partitionBy(*by))
    return out.withColumn("_level", F.coalesce(free["_at"], F.lit(float("inf")))).drop("_full", "_at")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, n, target) from a table with source and size: one row for each source, null included.

    Sources in order of code points, null last, get the weights in turn; a target stops at `most` times the source's
    size, and the excess goes to the others by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", given)
    total = F.sum("source_size").over(Window.partitionBy()) * share
    return fill(rows.withColumn("total", total), [], "source_size", "weight", F.col("total"), most).select(
        "source", "source_size", "n", F.least(most * F.col("source_size"), F.col("_level") * F.col("weight")).alias("target")
    )


def _expected(sizes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(source, importance, expected): copies of a document of that importance."""
    groups = sizes.groupBy("source", "importance").agg(F.sum("size").alias("size"))
    groups = groups.join(sources.select("source", "target").withColumnRenamed("source", "_s").hint("merge"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    groups = groups.withColumn("mass", F.col("size") * F.col("importance"))
    level = fill(groups, ["source"], "size", "mass", F.col("target"), most)
    return level.select("source", "importance", F.when(F.col("size") > 0, F.least(F.lit(most), F.col("_level") * F.col("importance"))).otherwise(F.lit(0.0)).alias("expected"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3),
        share: float = 1.0, most: float = 3.0, importance: str | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of docs.

    size counts the words (null text: 0, so nothing is taken); a null source is a source of its own; the random numbers
    are a hash of doc_id, text and seed, so reruns agree; rows that repeat an id and a text share their number and stand
    next to each other in rank. importance: a column of weights of documents within their source (null: 1; negative: 0), rounded to 3
    places; an empty table gives no rows. Taken words of a source stay below its target, by less than a document.
    """
    t = text_or_empty(text)
    weight = F.lit(1.0) if importance is None else F.round(F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(1.0)), F.lit(0.0)), 3)
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), t), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    sizes = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(t).alias("size"), u.alias("u"), weight.alias("importance")), "sizes")
    sources = stored(targets(sizes, weights, share, most), "sources")
    hint = "broadcast" if sources.count() <= FEW_SOURCES else "merge"
    copies = _expected(sizes, sources, most).withColumnsRenamed({"source": "_s", "importance": "_i"})
    copies = stored(copies, "copies")
    copies_hint = "broadcast" if copies.count() <= FEW_SOURCES else "merge"
    rows = sizes.join(sources.withColumnRenamed("source", "_src").hint(hint), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    rows = rows.join(copies.hint(copies_hint), F.col("source").eqNullSafe(F.col("_s")) & (F.col("importance") == F.col("_i"))).drop("_s", "_i")
    rows = rows.withColumn("whole", F.floor(F.col("expected") + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), F.col("expected") - F.floor(F.col("expected") + 1e-9)))
    # Pareto rank, on a log scale; the bin compares it with the source's mean inclusion, so that bins are about equal
    odds = lambda p: F.log(p / (1 - p))
    mean = F.least(F.greatest(F.col("target") / F.col("source_size") % 1, F.lit(1e-6)), F.lit(1 - 1e-6))
    rank = odds(F.col("u")) - odds(F.least(F.col("part"), F.lit(1 - 1e-12)))
    n_bins = F.ceil(F.col("n") / BIN_ROWS)
    sampled = rows.where("part > 1e-9 and size > 0").withColumn("rank", rank)
    sampled = sampled.withColumn("bin", F.floor(n_bins / (1 + F.exp(-(F.col("rank") + odds(mean))))))
    bins = sampled.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("part")).alias("wanted"))
    order = Window.partitionBy("source").orderBy("bin")
    bins = bins.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("wanted").over(Window.partitionBy("source")).alias("_wanted"))
    ranked = sampled.join(stored(bins, "bins").hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    ranked = _taken_first(ranked).select(*rows.columns, "extra")
    both = ranked.unionByName(rows.where("not (part > 1e-9 and size > 0)").withColumn("extra", F.lit(0).cast("long")))
    copies_of = F.col("whole").cast("long") + F.col("extra")
    return both.select("doc_id", "source", "size", "source_size", "target", copies_of.alias("copies"), (copies_of * F.col("size")).alias("taken"))


def _taken_first(ranked: DataFrame) -> DataFrame:
    """ranked with extra: 1 for the first of a source, in rank, that fit its wanted words, else 0.

    In the bin where the words run out, later documents that fit what is left are taken too, in rank, twice over, so
    that the sum comes near although one document may be long. There the order is Pareto's no more: shorter documents of
    that one bin are likelier, which is one bin in n / BIN_ROWS of a source. _before: words in earlier bins.
    """
    whole = Window.partitionBy("source", "bin")
    upto = whole.orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = ranked.withColumn("extra", (F.col("_before") + F.sum("size").over(upto) <= F.col("_wanted")).cast("long"))
    for _ in range(2):
        left = F.col("_wanted") - F.col("_before") - F.sum(F.col("size") * F.col("extra")).over(whole)
        out = out.withColumn("_left", left).withColumn("_fits", ((F.col("extra") == 0) & (F.col("size") <= F.col("_left"))).cast("long"))
        fits = (F.col("_fits") == 1) & (F.sum(F.col("size") * F.col("_fits")).over(upto) <= F.col("_left"))
        out = out.withColumn("extra", F.when(fits, 1).otherwise(F.col("extra")).cast("long"))
    return out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs that the mix takes, with copies, size, source_size, target and taken; the columns of docs come first.

    Columns of docs named like the new ones are replaced; null texts and sources are as in mix. Joined by id and the text's hash; rows that repeat both are decided alike, by the most copies that one of them got.
    """
    docs = docs.drop("copies", "size", "source_size", "target", "taken")
    own = ["doc_id", "text", "source"]
    keyed = docs.select(*own).withColumn("_h", F.xxhash64(text_or_empty("text")))
    keyed = keyed.withColumn("_key", F.struct("doc_id", "_h"))
    got = mix(keyed.select("_key", "text", "source"), doc_id="_key", **options).groupBy("doc_id").agg(*[F.max(c).alias(f"_{c}") for c in ("copies", "size", "source_size", "target", "taken")])
    got = got.where("_copies > 0").select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id._h").alias("_h"), "_copies", "_size", "_source_size", "_target", "_taken")
    out = docs.join(got.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text_or_empty("text")) == F.col("_h")))
    return out.select(*[docs[c] for c in docs.columns], *[F.col(f"_{c}").alias(c) for c in ("copies", "size", "source_size", "target", "taken")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
