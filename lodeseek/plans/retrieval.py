"""Queries over text and vector search, ranking and answers, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import answers, plugins, ranking, search, text_index, text_segments, vector_cells, vector_index
from ..operators.keyed_table import KeyedTable
from ..sources import tables
from ..sources.shared import new_path, stored

FIELDS = {"content": "text", "title_cn": "text", "keywords_cn": "keyword"}
FIVE = {**FIELDS, "metadata_title_cn": "text", "metadata_keywords_cn": "keyword"}
PAYLOAD = ["doc_id", "content", "title_cn", "journal", "title", "heading_stack"]


_built: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, tables_read: tuple[str, ...], make):
    """What make() stores in the shared folder, built once for each application and state of the tables' files."""
    key = (spark.sparkContext.applicationId, what, tables.listing(spark, sf_dir, *tables_read))
    if key not in _built:
        _built[key] = make()
    return _built[key]


def index_of(spark: SparkSession, sf_dir: str) -> text_index.Index:
    return _once(spark, sf_dir, "text", ("documents",), lambda: text_segments.build(tables.chunks(spark, sf_dir), FIELDS))


def cells_of(spark: SparkSession, sf_dir: str) -> vector_cells.VectorCells:
    """The vectors in 128 cells."""

    def make():
        cells = vector_cells.VectorCells(spark, new_path(spark, "cells"))
        cells.create(tables.chunk_vectors(spark, sf_dir), 128)
        return cells

    return _once(spark, sf_dir, "cells", ("embeddings",), make)


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    by_field = index.postings.groupBy("field").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
    terms = index.frequencies.groupBy("field").agg(F.count("*").alias("n_terms"))
    return by_field.join(F.broadcast(terms), "field").join(F.broadcast(index.lengths), "field").select("field", "n_postings", "n_tokens", "n_terms", "n_chunks", F.round("avgdl", 6).alias("avgdl"))


def _text_hits(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return text_index.bm25(tables.queries(spark, sf_dir), tables.chunks(spark, sf_dir), FIELDS, index=index_of(spark, sf_dir), **options)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_hits(spark, sf_dir)


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_hits(spark, sf_dir, filters={"article_type": ["en", "de"], "journal": "src1", "unknown": "x"})


def maintained_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, text_segments.TextIndex]:
    """The last rows, and their index after three batches: all chunks; those labelled toxic shortened to their titles, and
    repeated contents deleted, where they aren't among these; those of low quality with their source added."""

    def make():
        index = text_segments.TextIndex(spark, new_path(spark, "segments"), FIVE)
        store = KeyedTable(spark, new_path(spark, "chunks"))
        rows = tables.with_metadata(tables.chunks(spark, sf_dir)).select("chunk_id", *FIVE)
        labels = tables.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_id")
        first = rows.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min("chunk_id").alias("first"))
        copies = rows.select("chunk_id", F.sha2("content", 256).alias("digest")).join(first.hint("merge"), "digest").where("chunk_id > first").select("chunk_id")
        short = rows.join(labels.where("toxic = 1").select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("content", F.col("title_cn"))
        longer = rows.join(labels.where("quality = 0").select("chunk_id").distinct(), "chunk_id", "left_semi").withColumn("content", F.concat_ws(" ", "content", "metadata_keywords_cn"))
        for n, (upserts, deleted) in enumerate([(rows, None), (short, copies), (longer, None)]):
            index.apply(upserts, deleted)
            if deleted is not None:
                store.delete(deleted)
            store.upsert(upserts.withColumn("version", F.lit(n).cast("long")))
        index.merge()
        store.merge()
        return store, index

    store, index = _once(spark, sf_dir, "segments", ("documents", "labels"), make)
    return store.read(), index


def bm25_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fields of an index that followed upserts and deletions."""
    rows, index = maintained_index(spark, sf_dir)
    return text_index.bm25(tables.queries(spark, sf_dir), rows, FIVE, index.open(), k=50)


def segments_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed statistics of segments, and what their postings come to."""
    index = maintained_index(spark, sf_dir)[1].open()
    by_field = index.postings.groupBy("field").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
    terms = index.frequencies.groupBy("field").agg(F.count("*").alias("n_terms"), F.sum("df").alias("sum_df"))
    joined = by_field.join(F.broadcast(terms), "field").join(F.broadcast(index.lengths), "field")
    return joined.select("field", "n_postings", "n_tokens", "n_terms", "sum_df", "n_chunks", F.round("avgdl", 6).alias("avgdl"))


def maintained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a keyed table has after the same batches."""
    return maintained_index(spark, sf_dir)[0].select("chunk_id", F.md5("content").alias("digest"), "metadata_keywords_cn")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index.exact_top_k(tables.query_vectors(spark, sf_dir), tables.chunk_vectors(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """Stored, as the steps after it join it with itself: 20 rows a query."""
    return stored(ranking.rrf(bm25_topk(spark, sf_dir), vector_topk(spark, sf_dir), k), "fused")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One knowledge base, with filters on both sides; the vectors are those that have the queries' numbers."""
    target = search.Target(index_of(spark, sf_dir), tables.chunks(spark, sf_dir), tables.chunk_vectors(spark, sf_dir), FIELDS)
    return search.hybrid(tables.queries(spark, sf_dir), tables.query_vectors(spark, sf_dir), target, {"article_type": ["en", "fr"], "unknown": "x"}, each=50, top=30)


def rrf_sixty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, 60)


def payload_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits with payload: the text store's where it has the chunk, else what the vector store knows."""
    fused, docs = _fused(spark, sf_dir), tables.chunks(spark, sf_dir)
    text = fused.where("rank_text is not null").join(docs.select("chunk_id", "title_cn", "journal", "heading_stack"), "chunk_id").select("query_id", "chunk_id", "title_cn", "journal", "heading_stack")
    vector = fused.where("rank_vector is not null").select("query_id", "chunk_id", F.concat(F.lit("#"), F.col("chunk_id").cast("string")).alias("title_cn"), F.lit("vectors").alias("journal"), F.array(F.lit("v")).alias("heading_stack"))
    return ranking.merge_payload(text, vector, ["query_id", "chunk_id"], ["title_cn", "journal"], ["heading_stack"]).select("query_id", "chunk_id", "title_cn", "journal", F.array_join("heading_stack", "/").alias("path"))


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stored(ranking.with_payload(_fused(spark, sf_dir), tables.chunks(spark, sf_dir), PAYLOAD), "payload").join(tables.queries(spark, sf_dir), "query_id")
    return ranking.rerank(hits, plugins.lexical_overlap)


def _final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).drop("rank").withColumnsRenamed({"rank_rerank": "rank", "score_rerank": "score"})


def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "chunk_id", "rank", "score_rerank", "rank_rerank")


def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.context(_final(spark, sf_dir))


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content"))
    return answers.prompts(tables.queries(spark, sf_dir), context_blocks(spark, sf_dir), history)


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = tables.chunks(spark, sf_dir).groupBy("doc_id").agg(F.min("title_cn").alias("title_cn"), F.min("journal").alias("journal"))
    return answers.citations(_final(spark, sf_dir).withColumn("title_cn", F.lit("")), papers)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _citations(spark, sf_dir)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.retrieval_metrics(_fused(spark, sf_dir))


def rerank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.rerank_metrics(_reranked(spark, sf_dir))


def relevance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.bands(vector_topk(spark, sf_dir))


def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite the first and last of a query's citations, and one that doesn't exist."""
    cited = _citations(spark, sf_dir).select("query_id", "id")
    n = F.count("*")
    text = F.concat(F.lit("As shown [1, "), n.cast("string"), F.lit("] and [doc-"), (n + 2).cast("string"), F.lit("]."))
    return answers.marker_rates(answers.markers(cited.groupBy("query_id").agg(text.alias("content"))), cited)


def conversation_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four queries in a row count as one conversation."""
    each = _citations(spark, sf_dir).groupBy(F.floor(F.col("query_id") / 4).alias("conv_id"), F.col("query_id").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("id", "chunk_id"))).alias("citations"))
    return answers.distinct_citations(each).select("conv_id", "id", "ord", F.col("citation.chunk_id").alias("chunk_id"))


def ann_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_of(spark, sf_dir).top_k(tables.query_vectors(spark, sf_dir), 20)


def ann_every_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of all cells is an exact one."""
    return cells_of(spark, sf_dir).top_k(tables.query_vectors(spark, sf_dir), 20, 128)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each query's 20 nearest rows are found in 1, 4, 16 and 64 of 128 cells, and how many rows these have."""
    cells, asked = cells_of(spark, sf_dir), tables.query_vectors(spark, sf_dir)
    exact = stored(vector_index.exact_top_k(asked, tables.chunk_vectors(spark, sf_dir), 20).select("query_id", "chunk_id"), "exact")
    parts = []
    for n in (1, 4, 16, 64):
        near = cells.top_k(asked, 20, n).select("query_id", "chunk_id", F.lit(1).alias("found"))
        both = exact.join(near.hint("merge"), ["query_id", "chunk_id"], "left")
        parts.append(both.agg(F.lit(n).alias("n_probe"), F.count("*").alias("n_exact"), F.count("found").alias("n_found"), (F.count("found") / F.count("*")).alias("recall")))
    return reduce(DataFrame.unionByName, parts)


def ann_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of all cells after batches: queries' own vectors deleted, and those of low-quality documents negated."""

    def make():
        cells = vector_cells.VectorCells(spark, new_path(spark, "cells"))
        vectors = tables.chunk_vectors(spark, sf_dir)
        cells.create(vectors, 32)
        low = tables.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("chunk_id")).distinct()
        cells.apply(vectors.join(low, "chunk_id", "left_semi").withColumn("embedding", F.transform("embedding", lambda x: -x)))
        cells.apply(deleted=tables.queries(spark, sf_dir).select(F.col("query_id").alias("chunk_id")))
        cells.merge()
        return cells

    cells = _once(spark, sf_dir, "changed cells", ("embeddings", "labels", "benchmark"), make)
    return cells.top_k(tables.query_vectors(spark, sf_dir), 20, 32)


def doubled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.doubled(tables.queries(spark, sf_dir))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.queries(spark, sf_dir).select("query_id", F.size(tokens(F.col("query"))).cast("long").alias("n_tokens"), F.array_join(F.array_sort(F.array_distinct(tokens(F.col("query")))), " ").alias("terms"))


QUERIES = {f.__name__: f for f in (
    postings_stats, bm25_topk, bm25_filtered, bm25_segments, segments_stats, maintained_rows, vector_topk, hybrid_search, hybrid_filtered, rrf_sixty, payload_merge, rerank_lexical, context_blocks, prompt_build,
    citations, retrieval_metrics, rerank_metrics, relevance_bands, citation_markers, conversation_citations, ann_cells, ann_every_cell, ann_recall, ann_maintained, doubled_queries, query_terms,
)}

_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_WORDS = f"""
c as (select doc_id as chunk_id, source as doc_id, text as content, string_split(text, chr(10))[1] as title_cn, lang as keywords_cn, lang as article_type, source as journal from documents),
w as (select chunk_id, 'content' as field, {_TOK.format("content")} as words from c
      union all select chunk_id, 'title_cn', {_TOK.format("title_cn")} from c
      union all select chunk_id, 'keywords_cn', case when keywords_cn <> '' then [keywords_cn] else [] end from c),
st as (select field, count(*) as n_chunks, avg(len(words)) as avgdl from w where len(words) > 0 group by field),
p as (select field, chunk_id, dl, token, count(*) as tf from (select field, chunk_id, len(words) as dl, unnest(words) as token from w) group by all)"""
_FIVE = f"""
lb as (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id),
c as (select * from (
    select d.doc_id as chunk_id, string_split(text, chr(10))[1] as title_cn, lang as keywords_cn, string_split(text, chr(10))[-1] as metadata_title_cn, source as metadata_keywords_cn,
           case when quality = 0 then concat_ws(' ', text, source) when toxic = 1 then string_split(text, chr(10))[1] else text end as content,
           d.doc_id > min(d.doc_id) over (partition by text) as copy, coalesce(quality = 0 or toxic = 1, false) as labelled
    from documents d left join lb on lb.doc_id = d.doc_id) where labelled or not copy),
w as (select chunk_id, 'content' as field, {_TOK.format("content")} as words from c
      union all select chunk_id, 'title_cn', {_TOK.format("title_cn")} from c
      union all select chunk_id, 'metadata_title_cn', {_TOK.format("metadata_title_cn")} from c
      union all select chunk_id, 'keywords_cn', case when keywords_cn <> '' then [keywords_cn] else [] end from c
      union all select chunk_id, 'metadata_keywords_cn', case when metadata_keywords_cn <> '' then [metadata_keywords_cn] else [] end from c),
st as (select field, count(*) as n_chunks, avg(len(words)) as avgdl from w where len(words) > 0 group by field),
p as (select field, chunk_id, dl, token, count(*) as tf from (select field, chunk_id, len(words) as dl, unnest(words) as token from w) group by all),
d as (select field, token, count(*) as df from p group by all)"""
_FIVE_HITS = f"""{_FIVE},
qw as (select item_id as query_id, f.field, case when f.field like '%keywords%' then [text] else {_TOK.format("text")} end as words
       from benchmark, (values ('content'), ('title_cn'), ('keywords_cn'), ('metadata_title_cn'), ('metadata_keywords_cn')) f(field)),
q as (select query_id, field, token, count(*) as qtf from (select query_id, field, unnest(words) as token from qw) group by all),
s as (select q.query_id, p.chunk_id, round(sum(qtf * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
        * case when q.field = 'content' then 1.0::double when q.field like '%title%' then 2.0::double else 1.5::double end), 6) as score, count(*) filter (q.field = 'content') as must
      from q join p on q.field = p.field and q.token = p.token join d on d.field = p.field and d.token = p.token join st on st.field = p.field
      group by 1, 2)"""
_HITS = f"""{_WORDS},
d as (select field, token, count(*) as df from p group by all),
qw as (select item_id as query_id, 'content' as field, {_TOK.format("text")} as words from benchmark
       union all select item_id, 'title_cn', {_TOK.format("text")} from benchmark union all select item_id, 'keywords_cn', [text] from benchmark),
q as (select query_id, field, token, count(*) as qtf from (select query_id, field, unnest(words) as token from qw) group by all),
s as (select q.query_id, p.chunk_id, round(sum(qtf * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
        * case q.field when 'content' then 1.0::double when 'title_cn' then 2.0::double else 1.5::double end), 6) as score, count(*) filter (q.field = 'content') as must
      from q join p on q.field = p.field and q.token = p.token join d on d.field = p.field and d.token = p.token join st on st.field = p.field
      group by 1, 2)"""
_TEXT = f"""{_HITS},
t as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s where must > 0) where rank <= 200)"""
_VECTOR = """
e as (select vec_id, embedding::double[] as v from embeddings),
n as (select vec_id, v, sqrt(list_dot_product(v, v)) as len from e),
vs as (select b.vec_id as query_id, a.vec_id as chunk_id, round(list_dot_product(a.v, b.v) / (a.len * b.len), 6) as score from n a, n b where b.vec_id in (select item_id from benchmark)),
v as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from vs) where rank <= 200)"""


def _fusion(k: int) -> str:
    return f"""{_TEXT}, {_VECTOR},
fu as (select coalesce(v.query_id, t.query_id) as query_id, coalesce(v.chunk_id, t.chunk_id) as chunk_id, v.rank as rank_vector, t.rank as rank_text,
         round(coalesce(1.0::double / ({k} + v.rank), 0) + coalesce(1.0::double / ({k} + t.rank), 0), 6) as score_rrf
       from v full join t on v.query_id = t.query_id and v.chunk_id = t.chunk_id),
f as (select * from (select *, row_number() over (partition by query_id order by score_rrf desc, coalesce(rank_vector, 999999), coalesce(rank_text, 999999), chunk_id)::int as rank from fu) where rank <= 20)"""


_RERANK = f"""{_fusion(20)},
h as (select f.*, c.doc_id, c.content, c.title_cn, c.journal, c.article_type, b.text as query from f left join c on c.chunk_id = f.chunk_id join benchmark b on b.item_id = f.query_id),
sc as (select query_id, chunk_id, rank, round(len(list_intersect(list_distinct({_TOK.format("query")}), list_distinct({_TOK.format("content")}))) / len(list_distinct({_TOK.format("query")})), 6) as scored from h where content <> ''),
kept as (select * from (select *, row_number() over (partition by query_id order by scored desc, rank) as place from sc) where place <= 5),
r as (select h.* exclude (rank), h.rank as former, coalesce(kept.scored, 0.0) as score,
        row_number() over (partition by h.query_id order by (coalesce(content, '') <> '') desc, coalesce(kept.scored, 0.0) desc, h.rank)::int as rank
      from h left join kept on kept.query_id = h.query_id and kept.chunk_id = h.chunk_id)"""
_CONTEXT = f"""{_RERANK},
x as (select *, row_number() over (partition by query_id order by rank) as i, replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as body from r where content <> ''),
cx as (select query_id, count(*) as n_used, string_agg('[' || i || '] 标题: 《' || title_cn || '》 | 来源: ' || journal || ' | 章节: ' || article_type || chr(10) || '    内容: '
         || case when length(body) > 800 then substr(body, 1, 800) || '...' else body end, chr(10) || chr(10) order by i) as context
       from x where i <= 5 group by query_id)"""
_CITED = f"""{_RERANK},
papers as (select doc_id, min(title_cn) as title, min(journal) as journal from c group by doc_id),
one as (select *, row_number() over (partition by query_id, doc_id order by rank) as k from r where content <> '' and doc_id is not null),
ct as (select query_id, row_number() over (partition by query_id order by rank)::int as id, one.doc_id, chunk_id, papers.title as title, one.journal as source,
         case when length(content) > 200 then substr(content, 1, 200) || '...' else content end as snippet, score as relevance
       from one left join papers on papers.doc_id = one.doc_id where k = 1),
ci as (select * from ct where id <= 5)"""

ORACLES = {
    "hybrid_filtered": f"""with {_HITS}, {_VECTOR},
        ok as (select chunk_id from c where article_type in ('en', 'fr')),
        tx as (select * from (select query_id, s.chunk_id, row_number() over (partition by query_id order by score desc, s.chunk_id)::int as rank from s join ok on ok.chunk_id = s.chunk_id where must > 0) where rank <= 50),
        vx as (select * from (select query_id, vs.chunk_id, row_number() over (partition by query_id order by score desc, vs.chunk_id)::int as rank from vs join ok on ok.chunk_id = vs.chunk_id) where rank <= 50),
        fu as (select coalesce(vx.query_id, tx.query_id) as query_id, coalesce(vx.chunk_id, tx.chunk_id) as chunk_id, vx.rank as rank_vector, tx.rank as rank_text,
                 round(coalesce(1.0::double / (20 + vx.rank), 0) + coalesce(1.0::double / (20 + tx.rank), 0), 6) as score_rrf from vx full join tx on vx.query_id = tx.query_id and vx.chunk_id = tx.chunk_id)
        select * from (select *, row_number() over (partition by query_id order by score_rrf desc, coalesce(rank_vector, 999999), coalesce(rank_text, 999999), chunk_id)::int as rank from fu) where rank <= 30""",
    "ann_every_cell": f"with {_VECTOR} select query_id, chunk_id, score, rank from v where rank <= 20",
    "ann_maintained": f"""with {_VECTOR}, lo as (select distinct doc_id from labels where quality = 0),
        g as (select query_id, chunk_id, case when chunk_id in (select doc_id from lo) then -score else score end as score from vs where chunk_id not in (select item_id from benchmark))
        select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from g) where rank <= 20""",
    "postings_stats": f"with {_WORDS}, a as (select field, count(*) as n_postings, sum(tf)::bigint as n_tokens, count(distinct token) as n_terms from p group by field) select a.*, n_chunks, round(avgdl, 6) as avgdl from a join st on st.field = a.field",
    "bm25_segments": f"with {_FIVE_HITS} select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from s where must > 0) where rank <= 50",
    "segments_stats": f"""with {_FIVE}, a as (select field, count(*) as n_postings, sum(tf)::bigint as n_tokens from p group by field), b as (select field, count(*) as n_terms, sum(df)::bigint as sum_df from d group by field)
        select a.field, n_postings, n_tokens, n_terms, sum_df, n_chunks, round(avgdl, 6) as avgdl from a join b on a.field = b.field join st on st.field = a.field""",
    "maintained_rows": f"with {_FIVE} select chunk_id, md5(content) as digest, metadata_keywords_cn from c",
    "bm25_topk": f"with {_TEXT} select query_id, chunk_id, score, rank from t",
    "bm25_filtered": f"with {_HITS}, k as (select s.*, row_number() over (partition by query_id order by score desc, s.chunk_id)::int as rank from s join c on c.chunk_id = s.chunk_id where must > 0 and article_type in ('en', 'de') and journal = 'src1') select query_id, chunk_id, score, rank from k where rank <= 200",
    "vector_topk": f"with {_VECTOR} select query_id, chunk_id, score, rank from v",
    "hybrid_search": f"with {_fusion(20)} select query_id, chunk_id, rank_vector, rank_text, score_rrf, rank from f",
    "rrf_sixty": f"with {_fusion(60)} select query_id, chunk_id, rank_vector, rank_text, score_rrf, rank from f",
    "payload_merge": f"with {_fusion(20)} select query_id, f.chunk_id, case when rank_text is not null and c.title_cn <> '' then c.title_cn when rank_vector is not null then '#' || f.chunk_id else c.title_cn end as title_cn, case when rank_text is not null then c.journal else 'vectors' end as journal, case when rank_text is not null then c.article_type else 'v' end as path from f left join c on c.chunk_id = f.chunk_id",
    "rerank_lexical": f"with {_RERANK} select query_id, chunk_id, former as rank, score as score_rerank, rank as rank_rerank from r",
    "context_blocks": f"with {_CONTEXT} select query_id, n_used, context from cx",
    "prompt_build": f"""with {_CONTEXT},
        hi as (select conv_id, turn, case when role = 'user' then '用户' else '助手' end || ': ' || text as line, row_number() over (partition by conv_id order by turn desc) as back from conversations),
        hb as (select conv_id, string_agg(line, chr(10) order by turn) || chr(10) || chr(10) as block from hi where back <= 20 group by conv_id)
        select item_id as query_id, coalesce(block, '') || '以下是相关文献片段：' || chr(10) || chr(10) || context || chr(10) || chr(10) || '请基于以上文献回答：' || text as prompt,
               case when context is null then '未找到相关文献' end as answer
        from benchmark left join cx on cx.query_id = item_id left join hb on hb.conv_id = item_id""",
    "citations": f"with {_CITED} select query_id, id, doc_id, chunk_id, title, source, snippet, relevance from ci",
    "retrieval_metrics": f"""with {_fusion(20)} select query_id, count(rank_vector) as n_vector, count(rank_text) as n_text, count(rank_vector) + count(rank_text) - count(*) as overlap,
        case when count(rank_vector) > 0 and count(rank_text) > 0 then 'both' when count(rank_vector) > 0 then 'milvus_only' else 'es_only' end as routing,
        string_agg(chunk_id || ':' || printf('%.3f', round(score_rrf, 3)), ',' order by rank) filter (rank <= 3) as best from f group by query_id""",
    "rerank_metrics": f"""with {_RERANK}, o as (select *, row_number() over (partition by query_id order by score desc) as k from r)
        select query_id, count(*) as n_hits, count(*) filter (score > 0) as n_scored, coalesce(string_agg(printf('%.3f', round(score, 3)), ',' order by score desc) filter (score > 0 and k <= 5), '') as best from o group by query_id""",
    "relevance_bands": f"with {_VECTOR} select case when score >= 0.9 then 'high' when score >= 0.75 then 'good' when score >= 0.6 then 'fair' else 'low' end as band, count(*) as n_hits, round(avg(score), 6) as mean_score from v group by 1",
    "citation_markers": f"with {_CITED}, k as (select query_id, count(*) as n from ci group by query_id) select query_id, case when n = 1 then 1 else 2 end::bigint as n_used, 1::bigint as n_dangling, greatest(n - 2, 0)::bigint as n_uncited from k",
    "conversation_citations": f"with {_CITED} select floor(query_id / 4)::bigint as conv_id, id, min(query_id) as ord, arg_min(chunk_id, query_id) as chunk_id from ci group by 1, 2",
    "doubled_queries": "select item_id as query_id, case when length(text) < 15 then text || ' ' || text else text end as query from benchmark",
    "query_terms": f"select item_id as query_id, len({_TOK.format('text')})::bigint as n_tokens, array_to_string(list_sort(list_distinct({_TOK.format('text')})), ' ') as terms from benchmark",
}
