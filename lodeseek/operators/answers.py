"""From ranked hits to context, prompt, citations and figures about retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, present, strip
from .ranking import top_k

# Labels and limits of contexts, prompts and citations.
TOP_N, CONTEXT_CHARS, SNIPPET_CHARS, MOST_CITATIONS, MOST_HISTORY = 5, 800, 200, 5, 20
DEFAULT_JOURNAL, UNKNOWN_TITLE = "中国全科医学", "未知文档"
NO_CONTEXT = "未找到相关文献"
ARROW = " → "


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts joined in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def context(ranked: DataFrame, top_n: int = TOP_N, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, n_used, context) from hits with rank, content, title_cn, journal, title, heading_stack; hits without content are passed over."""
    hits = top_k(ranked.where(present(F.col("content")).isNotNull()).withColumnRenamed("rank", "_r"), top_n, order=[F.asc("_r")], rank="i")
    path = F.when(F.size("heading_stack") > 0, F.concat(F.lit(" | 章节: "), F.array_join("heading_stack", ARROW))).otherwise("")
    body = cut(F.replace(strip(F.col("content")), F.lit("\n"), F.lit(" ")), max_chars)
    known = F.coalesce(present(F.col("title_cn")), present(F.col("journal"))).isNotNull()
    head = F.when(known, F.concat(F.lit("标题: 《"), F.coalesce("title_cn", F.lit("")), F.lit("》 | 来源: "), F.coalesce(present(F.col("journal")), F.lit(DEFAULT_JOURNAL)))).otherwise(F.coalesce(present(F.col("title")), F.lit(UNKNOWN_TITLE)))
    line = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), head, path, F.lit("\n    内容: "), body)
    return hits.groupBy("query_id").agg(F.count("*").alias("n_used"), ordered_join(F.col("i"), line, "\n\n").alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt, answer): a query without context has a null prompt and a fixed answer.

    history: query_id, ord, role, content; the last messages come first in the prompt, one a line.
    """
    out = queries.select("query_id", "query").join(contexts.select("query_id", "context"), "query_id", "left")
    if history is not None:
        last = top_k(history, MOST_HISTORY, order=[F.desc("ord")], rank="back")
        label = F.when(F.col("role") == "user", "用户").otherwise("助手")
        block = last.groupBy("query_id").agg(F.concat(ordered_join(F.col("ord"), F.concat(label, F.lit(": "), F.col("content")), "\n"), F.lit("\n\n")).alias("block"))
        out = out.join(block, "query_id", "left")
    else:
        out = out.withColumn("block", F.lit(None).cast("string"))
    text = F.concat(F.coalesce("block", F.lit("")), F.lit("以下是相关文献片段：\n\n"), F.col("context"), F.lit("\n\n请基于以上文献回答："), F.col("query"))
    return out.select("query_id", F.when(F.col("context").isNotNull(), text).alias("prompt"), F.when(F.col("context").isNull(), NO_CONTEXT).alias("answer"))


def citations(ranked: DataFrame, papers: DataFrame | None = None, most: int = MOST_CITATIONS, snippet: int = SNIPPET_CHARS) -> DataFrame:
    """(query_id, id, doc_id, chunk_id, title, source, snippet, relevance): the first hit of each document, at most so many.

    papers: doc_id, title_cn, journal of the documents' own chunks, for hits that lack a title or journal.
    """
    hits = ranked.where(present(F.col("content")).isNotNull() & F.col("doc_id").isNotNull())
    hits = top_k(hits.withColumnRenamed("rank", "_r"), 1, ("query_id", "doc_id"), [F.asc("_r")], "_one")
    hits = top_k(hits, most, order=[F.asc("_r")], rank="id")
    if papers is not None:
        hits = hits.join(papers.select("doc_id", F.col("title_cn").alias("_title"), F.col("journal").alias("_journal")), "doc_id", "left")
    else:
        hits = hits.withColumns({"_title": F.lit(None).cast("string"), "_journal": F.lit(None).cast("string")})
    return hits.select(
        "query_id", "id", "doc_id", "chunk_id",
        F.coalesce(present(F.col("title_cn")), present(F.col("_title")), F.lit(UNKNOWN_TITLE)).alias("title"),
        F.coalesce(present(F.col("journal")), present(F.col("_journal")), F.lit(DEFAULT_JOURNAL)).alias("source"),
        cut(F.col("content"), snippet).alias("snippet"), F.col("score").alias("relevance"),
    )


def retrieval_metrics(fused: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, n_vector, n_text, overlap, routing, best): hits of each source among the fused, and the first few."""
    vector, text = F.col("rank_vector").isNotNull(), F.col("rank_text").isNotNull()
    best = F.slice(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.round("score_rrf", 3).alias("score")))), 1, top)
    out = fused.groupBy("query_id").agg(F.count_if(vector).alias("n_vector"), F.count_if(text).alias("n_text"), F.count("*").alias("_n"), best.alias("_best"))
    routing = F.when((F.col("n_vector") > 0) & (F.col("n_text") > 0), "both").when(F.col("n_vector") > 0, "milvus_only").otherwise("es_only")
    shown = F.array_join(F.transform("_best", lambda b: F.concat_ws(":", b["chunk_id"].cast("string"), F.format_number(b["score"], 3))), ",")
    return out.select("query_id", "n_vector", "n_text", (F.col("n_vector") + F.col("n_text") - F.col("_n")).alias("overlap"), routing.alias("routing"), shown.alias("best"))


def rerank_metrics(ranked: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, n_hits, n_scored, best): counts, and the best positive scores to 3 places."""
    scores = F.slice(F.sort_array(F.collect_list(F.when(F.col("score_rerank") > 0, F.round("score_rerank", 3))), asc=False), 1, top)
    return ranked.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count_if(F.col("score_rerank") > 0).alias("n_scored"), F.array_join(F.transform(scores, lambda s: F.format_number(s, 3)), ",").alias("best"))


def band(score: Column) -> Column:
    # Bands of relevance.
    return F.when(score >= 0.9, "high").when(score >= 0.75, "good").when(score >= 0.6, "fair").otherwise("low")


def bands(hits: DataFrame, score: str = "score") -> DataFrame:
    return hits.groupBy(band(F.col(score)).alias("band")).agg(F.count("*").alias("n_hits"), F.round(F.avg(score), 6).alias("mean_score"))


def markers(answers: DataFrame, text: str = "content") -> DataFrame:
    """answers with citation (null if there is none): a row for each number in [1], [1,4] or [doc-2], in order as pos."""
    found = F.regexp_extract_all(F.col(text), F.lit("\\[((?:doc-)?\\d+(?:\\s*,\\s*\\d+)*)\\]"), F.lit(1))
    numbers = F.flatten(F.transform(found, lambda m: F.transform(F.split(m, ","), lambda n: F.regexp_extract(n, "(\\d+)", 1).cast("int"))))
    return answers.select("*", F.posexplode_outer(numbers).alias("pos", "citation"))


def marker_rates(marked: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, n_used, n_dangling, n_uncited) of markers (query_id, citation) against citations (query_id, id)."""
    used = marked.where("citation is not null").select("query_id", F.col("citation").alias("id")).distinct().withColumn("_used", F.lit(1))
    both = used.join(cited.select("query_id", "id").distinct().withColumn("_cited", F.lit(1)).hint("merge"), ["query_id", "id"], "full")
    return both.groupBy("query_id").agg(
        F.count_if((F.col("_used") == 1) & (F.col("_cited") == 1)).alias("n_used"),
        F.count_if((F.col("_used") == 1) & F.col("_cited").isNull()).alias("n_dangling"),
        F.count_if(F.col("_used").isNull()).alias("n_uncited"),
    )


def distinct_citations(messages: DataFrame) -> DataFrame:
    """(conv_id, id, ord, citation): of messages (conv_id, ord, citations), the first citation of each id."""
    each = messages.select("conv_id", "ord", F.posexplode("citations").alias("at", "citation"))
    first = each.groupBy("conv_id", F.col("citation.id").alias("id")).agg(F.min_by(F.struct("ord", "citation"), F.struct("ord", "at")).alias("f"))
    return first.select("conv_id", "id", "f.ord", "f.citation")
