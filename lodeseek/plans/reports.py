"""Queries of reports, model plug-ins and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate, plugins, ranking, reports, vector_index
from ..operators.phrases import matches
from ..sources import tables
from ..sources.tables import table
from .ledger import tasks


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", F.col("turn").alias("ord"), "role", F.col("text").alias("content"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn") * 10).alias("created_at"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of seven users, last changed by their newest message."""
    return messages(spark, sf_dir).groupBy("conv_id").agg((F.max("conv_id") % 7).alias("user_id"), F.max("created_at").alias("updated_at"))


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conversation_list(conversations(spark, sf_dir), messages(spark, sf_dir)).select("user_id", "conv_id", "rank", "n_messages")


def message_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two before each conversation's fourth message; every third cursor is no timestamp."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + 30)
    cursors = conversations(spark, sf_dir).select("conv_id", F.when(F.col("conv_id") % 3 == 0, "yesterday").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("before"))
    return reports.message_page(messages(spark, sf_dir), cursors, 2).select("conv_id", "ord", "place")


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.history_windows(messages(spark, sf_dir)).select("conv_id", "ord", "n_history", "rewrite_history")


def kb_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("kb_id")).agg(F.min("doc_id").alias("created_at"))
    return reports.kb_overview(bases.union(spark.range(1).select(F.lit("empty"), F.lit(-1).cast("long"))), tasks(spark, sf_dir))


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kb_documents(tasks(spark, sf_dir)).select("kb_id", "id", "rank")


def user_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.user_list(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("created_at"), F.col("c_name").alias("username")))


def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "documents").select(F.col("text").alias("slug")).where("slug like 'T%'")
    return reports.taken_names(table(spark, sf_dir, "documents").select(F.col("text").alias("slug")), existing, "slug")


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit(" "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(name).alias("slug"), text.valid_slug(text.slug(name)).alias("valid"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir)
    gone = rows.where("user_id in (1, 4)").select(F.col("user_id").alias("id"))
    users, kept, said = reports.without_users(rows.select(F.col("user_id").alias("id")).distinct(), rows, messages(spark, sf_dir), gone)
    left = reports.without_bases(tasks(spark, sf_dir), table(spark, sf_dir, "documents").where("source like 'src1%'").select(F.col("source").alias("kb_id")))
    count = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return count("users", users).union(count("conversations", kept)).union(count("messages", said)).union(count("orphans", left.where("kb_id is null")))


def derived_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", reports.first_title(F.col("text")).alias("title"), reports.renamed_title(F.when(F.col("role") == "user", F.col("text")).otherwise("  ")).alias("renamed"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.md5("text").alias("md5"))
    return reports.lookup(tasks(spark, sf_dir), wanted, "md5").select("id", "md5", "status")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.embed(tables.chunks(spark, sf_dir), plugins.hashing_encoder).select("chunk_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v), 4).alias("square"))


def coverage_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are words of the regions' and parts' names beside common words of the items, in three tiers."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    tier = F.when(F.col("n") % 3 == 0, "high").when(F.col("n") % 3 == 1, "medium").otherwise("low")
    terms = words.where("n between 3 and 20").select(F.concat(F.lit("d"), F.col("n").cast("string")).alias("domain"), "term", tier.alias("coverage"))
    return plugins.coverage(tables.queries(spark, sf_dir), terms)


def query_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first word stands for the next two of its first line."""
    words = text.tokens(F.substring_index("text", "\n", 1))
    firsts = table(spark, sf_dir, "documents").where(F.size(words) >= 3).groupBy(words[0].alias("phrase")).agg(F.min(F.struct(words[1].alias("a"), words[2].alias("b"))).alias("w"))
    return plugins.expanded(tables.queries(spark, sf_dir), firsts.select("phrase", F.array("w.a", "w.b").alias("terms")))


def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the beginnings of first lines, of one to four words, stand in all documents."""
    docs = table(spark, sf_dir, "documents")
    phrases = docs.select(F.array_join(F.slice(text.tokens(F.substring_index("text", "\n", 1)), F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")), " ").alias("phrase"))
    found = matches(docs, phrases.distinct(), "doc_id")
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["pos"].cast("string"), m["phrase"])), ",")
    n_words = F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + m["n_words"])
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), n_words.alias("n_words"), F.md5(shown).alias("digest"))


def intent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as a model would give them, some of them broken."""
    good = F.to_json(F.struct(F.lit("d").alias("domain"), F.lit("high").alias("coverage"), F.concat(F.lit("about "), F.col("query")).alias("rewritten_query"), F.split("query", " ").alias("keywords")))
    asked = tables.queries(spark, sf_dir)
    replies = asked.select("query_id", F.when(F.col("query_id") % 3 == 0, "no json").otherwise(good).alias("reply"))
    return plugins.with_intent(asked, replies).select("query_id", "rewritten_query", "domain", "coverage", F.size("keywords").alias("n_keywords"), "suggestion")


def embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors against themselves with every third component a little larger."""
    a = tables.chunk_vectors(spark, sf_dir)
    b = a.select("chunk_id", F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when(i % 3 == 0, v * 1.5).otherwise(v)).alias("embedding"))
    return evaluate.verdict(evaluate.drift(a, b))


def coverage_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("expected"), (1 - F.col("toxic")).alias("predicted"))
    return evaluate.accuracy(rows)


def coverage_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("predicted")))


def overlap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits; those whose own document is labelled good count as relevant."""
    hits = vector_index.exact_top_k(tables.query_vectors(spark, sf_dir), tables.chunk_vectors(spark, sf_dir), 10)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    relevant = hits.select("query_id", "chunk_id").join(good, "chunk_id", "left_semi")
    return evaluate.overlap_at(hits, relevant)


def top_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).withColumn("score", F.length("content"))
    return ranking.top_k(rows, 3, ("role",), [F.desc("score"), F.asc("conv_id"), F.asc("ord")]).select("role", "conv_id", "ord", "rank")


QUERIES = {f.__name__: f for f in (
    conversation_list, message_page, history_window, kb_overview, kb_documents, user_list, name_conflicts, slugify, cascade_delete, derived_titles, point_lookup,
    hash_embedding, coverage_class, query_expand, phrase_matches, intent_fields, embedding_drift, coverage_accuracy, coverage_confusion, overlap_at_k, top_messages,
)}

_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_C = "c as (select conv_id, conv_id % 7 as user_id, conv_id * 1000 + max(turn) * 10 as updated_at, count(*) as n_messages from conversations group by conv_id)"

ORACLES = {
    "conversation_list": f"with {_C}, r as (select *, row_number() over (partition by user_id order by updated_at desc, conv_id)::int as rank from c) select user_id, conv_id, rank, n_messages from r where rank <= 50",
    "message_page": "with r as (select conv_id, turn as ord, row_number() over (partition by conv_id order by turn desc) as back from conversations where conv_id % 3 = 0 or turn < 3) select conv_id, ord, row_number() over (partition by conv_id order by ord)::int as place from r where back <= 2",
    "history_window": """with r as (select conv_id, turn, role || ': ' || substr(text, 1, 300) as line from conversations)
        select conv_id, turn as ord, count(*) over (partition by conv_id order by turn rows between 20 preceding and 1 preceding) as n_history,
               coalesce(array_to_string(list(line) over (partition by conv_id order by turn rows between 4 preceding and 1 preceding), chr(10)), '') as rewrite_history from r""",
    "kb_overview": "with b as (select source as kb_id, min(doc_id) as created_at from documents group by 1 union all select 'empty', -1), t as (select case when lang <> 'es' then source end as kb_id, quality from documents d left join labels l on l.doc_id = d.doc_id) select b.kb_id, created_at, count(t.kb_id) as doc_count, count(*) filter (t.kb_id is not null and quality = 1) > 0 as has_ready_docs from b left join t on t.kb_id = b.kb_id group by 1, 2",
    "kb_documents": "with r as (select source as kb_id, doc_id as id, row_number() over (partition by source order by doc_id desc)::int as rank from documents where lang <> 'es') select * from r where rank <= 200",
    "user_list": "select c_custkey as id, c_nationkey as created_at, c_name as username from customer order by 2, 1",
    "name_conflicts": "select text as slug, count(*) as n, text like 'T%' as exists from documents group by 1 having count(*) > 1 or text like 'T%'",
    "slugify": "with s as (select doc_id, regexp_replace(lower(trim(' ' || text)), '[^a-z0-9_]', '_', 'g') as slug from documents) select doc_id, slug, length(slug) between 2 and 50 as valid from s",
    "cascade_delete": f"with {_C} select 'users' as what, count(distinct user_id) as n from c where user_id not in (1, 4) union all select 'conversations', count(*) from c where user_id not in (1, 4) union all select 'messages', sum(n_messages)::bigint from c where user_id not in (1, 4) union all select 'orphans', count(*) from documents where lang = 'es' or source like 'src1%'",
    "derived_titles": "select conv_id, turn, case when length(text) > 30 then substr(text, 1, 30) || '...' else text end as title, case when role = 'user' and trim(text) <> '' then substr(trim(text), 1, 50) else '新对话' end as renamed from conversations",
    "point_lookup": "select d.doc_id as id, md5(text) as md5, case quality when 1 then 'parsed' when 0 then 'failed' else 'pending' end as status from documents d left join labels l on l.doc_id = d.doc_id where md5(text) in (select md5(text) from documents where lang = 'de')",
    "coverage_class": f"""with w as (select item_id, unnest({_TOK.format('text')}) as term from benchmark), n as (select term, count(*) as n from w group by 1 having n between 3 and 20),
        m as (select distinct item_id, n.n, case n % 3 when 0 then 0 when 1 then 1 else 2 end as tier, 'd' || n as domain from w join n on n.term = w.term),
        b as (select item_id, min((tier, domain)) as b from m group by 1)
        select k.item_id as query_id, coalesce(b[2], '') as domain, case b[1] when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'out_of_domain' end as coverage from benchmark k left join b on b.item_id = k.item_id""",
    "phrase_matches": f"""with recursive k as (select distinct array_to_string(w, ' ') as phrase, len(w) as n from (select list_slice({_TOK.format("string_split(text, chr(10))[1]")}, 1, doc_id % 4 + 1) as w from documents) where len(w) > 0),
        t as (select doc_id, {_TOK.format("text")} as ws from documents), x as (select doc_id, ws, unnest(range(len(ws))) as pos from t),
        g as (select doc_id, pos, n, array_to_string(ws[pos + 1 : pos + n], ' ') as phrase from x, range(1, 5) s(n) where pos + n <= len(ws)),
        m as (select doc_id, pos, max(g.n) as n, arg_max(g.phrase, g.n) as phrase from g join k on k.phrase = g.phrase and k.n = g.n group by all),
        r as (select doc_id, min(pos) as pos, arg_min(n, pos) as n, arg_min(phrase, pos) as phrase from m group by doc_id
              union all select m.doc_id, min(m.pos), arg_min(m.n, m.pos), arg_min(m.phrase, m.pos) from r join m on m.doc_id = r.doc_id and m.pos >= r.pos + r.n group by m.doc_id)
        select doc_id, count(*) as n_matches, sum(n)::bigint as n_words, md5(string_agg(pos || ':' || phrase, ',' order by pos)) as digest from r group by doc_id""",
    "query_expand": f"""with d as (select {_TOK.format("string_split(text, chr(10))[1]")} as w from documents), f as (select w[1] as phrase, min((w[2], w[3])) as t from d where len(w) >= 3 group by 1),
        q as (select item_id, unnest({_TOK.format('text')}) as phrase, unnest(range(len({_TOK.format('text')}))) as pos from benchmark),
        m as (select item_id, pos, 0 as at_, t[1] as term from q join f on f.phrase = q.phrase union all select item_id, pos, 1, t[2] from q join f on f.phrase = q.phrase),
        o as (select item_id, term, min((pos, at_)) as o from m group by all), k as (select *, row_number() over (partition by item_id order by o, term) as n from o),
        a as (select item_id, string_agg(term, ' ' order by n) as more from k where n <= 6 group by 1)
        select b.item_id as query_id, case when length(more) > 5 and more <> text then text || ' ' || more else text end as query from benchmark b left join a on a.item_id = b.item_id""",
    "intent_fields": "select item_id as query_id, case when item_id % 3 = 0 then text else 'about ' || text end as rewritten_query, case when item_id % 3 = 0 then '' else 'd' end as domain, case when item_id % 3 = 0 then 'unknown' else 'high' end as coverage, case when item_id % 3 = 0 then 0 else len(string_split(text, ' ')) end::int as n_keywords, '' as suggestion from benchmark",
    "embedding_drift": """with a as (select vec_id, embedding::double[] as x from embeddings), b as (select vec_id, x, list_transform(x, lambda v, i: case when (i - 1) % 3 = 0 then v * 1.5 else v end) as y from a),
        c as (select round(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 6) as c, round(list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 6) as d from b)
        select count(*) as n, min(c) as least, round(avg(c), 6) as mean, max(d) as max_diff, case when min(c) >= 0.99 then 'pass' when min(c) >= 0.95 then 'warn' else 'fail' end as verdict from c""",
    "coverage_accuracy": "select count(*) as n, count(*) filter (quality = 1 - toxic) as n_ok, round(avg((quality = 1 - toxic)::int), 6) as accuracy from labels",
    "coverage_confusion": "select quality as expected, toxic as predicted, count(*) as n from labels group by all",
    "overlap_at_k": """with e as (select vec_id, embedding::double[] as v from embeddings),
        s as (select b.vec_id as query_id, a.vec_id as chunk_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) as score from e a, e b where b.vec_id in (select item_id from benchmark)),
        r as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s)
        select query_id, count(*) filter (rank <= 3 and chunk_id in (select doc_id from labels where quality = 1)) as n_relevant, true as non_increasing from r where rank <= 10 group by 1""",
    "top_messages": "with r as (select role, conv_id, turn as ord, row_number() over (partition by role order by length(text) desc, conv_id, turn)::int as rank from conversations) select * from r where rank <= 3",
}
