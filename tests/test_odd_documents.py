"""Odd documents: nothing before the first line's end or the first stop, nulls, empty fields, separators in a language or source."""

import itertools
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodeseek.operators import chunks
from lodeseek.plans import ORACLES, QUERIES

from .conftest import DATA
from .helpers import TABLES, assert_same

TEXTS = ["One. Two\nthree.", "", None, "\nSecond line. More", ".stop first\nx", "\n", ".", "..\n\n", " ", "no end", "\r\na.b", "题。目.文\nx", "a\x00.b\n", "|；;,，.x", "【标题】."]
LANGS = ["en", "", None, " de ", "a,b", "；", "x|y", "　fr", "\n", "e.n"]
SOURCES = ["src0", "", None, " src1", "a，b", ",", "s\t", "src|2"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The given tables with odd documents in place of theirs."""
    at = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        if name != "documents":
            (at / f"{name}.parquet").symlink_to(Path(DATA, f"{name}.parquet"))
    rows = [(i, *x) for i, x in enumerate(itertools.product(TEXTS, LANGS, SOURCES))] + [(None, "a\nb", "en", "src0"), (7, "again", "en", "src0")]
    path = at / "documents"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.parquet(str(path))
    (at / "documents.parquet").symlink_to(next(path.glob("*.parquet")))
    return str(at)


def test_paper_chunks_of_odd_documents(spark, odd):
    assert_same(QUERIES["paper_chunks"](spark, odd), odd, ORACLES["paper_chunks"])


def test_missing_metadata_by_default_and_as_given(spark):
    rows = [("p", "", None, "a；；b, ", None), ("q", "t", "", "", "j")]
    docs = spark.createDataFrame(rows, "doc_id string, title_cn string, abstract_cn string, keywords_cn string, journal string")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in chunks.META if c not in docs.columns})
    of = lambda **how: {r.doc_id: (r.content, r.journal, r.keywords_cn) for r in chunks.paper_chunks(docs, **how).collect()}
    assert of() == {"p": ("【关键词】a；；b, ", "", ["a", "b"]), "q": ("【标题】t", "j", [])}
    assert of(as_given=True) == {"p": (None, None, ["a", "b"]), "q": ("【标题】t\n\n【摘要】\n\n【关键词】", "j", [])}
