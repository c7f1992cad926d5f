"""Chat formatting of typed content parts, with DataFrame functions only.

A turn reads ``<turn>role``, a line feed, its parts joined by ``<part>``, ``</turn>`` and a line feed. In roles and
texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l``, so that no text can show a control string, and each is
read back exactly. Image, audio and document parts become numbered placeholders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, text_or_empty

OPEN, CLOSE, PART = "<turn>", "</turn>\n", "<part>"
#: Tokens of an attachment that doesn't state its own number.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:bigint>>"


def escaped(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\n"), F.lit("\n")) if role else c
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _is_media(p: Column) -> Column:
    return p["type"].isin(*EXPANDED)


def visited(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, parts) with ord, header, body, attachments and n_tokens: the visitor of each turn.

    Attachments are numbered through the conversation in order of turns and parts. A part of unknown or null type is
    text; a null text is empty; null parts are none. Text counts its words as tokens, an attachment its own number or
    that of its type.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(parts, lambda p: F.coalesce(p, F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("type", "string"), ("text", "string"), ("ref", "string"), ("n_tokens", "bigint"))]))).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "parts")
    rows = rows.withColumn("ord", F.row_number().over(order)).withColumn("_n", F.size(F.filter("parts", _is_media)))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = lambda i: F.col("_before") + F.size(F.filter(F.slice("parts", 1, i + 1), _is_media))
    tokens = lambda p: F.coalesce(p["n_tokens"], reduce(lambda c, k: c.when(p["type"] == k, EXPANDED[k]), EXPANDED, F.when(F.lit(False), 0)))
    numbered = F.transform("parts", lambda p, i: F.struct(number(i).cast("long").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).cast("long").alias("n_tokens")))
    shown = lambda p, i: F.when(_is_media(p), F.concat(F.lit("<"), p["type"], F.lit(":"), number(i).cast("string"), F.lit(">"))).otherwise(escaped(F.coalesce(p["text"], F.lit(""))))
    words = F.aggregate(F.filter("parts", lambda p: ~F.coalesce(_is_media(p), F.lit(False))), F.lit(0).cast("long"), lambda s, p: s + F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit("\\S+")))
    media = F.filter(numbered, lambda a: _is_media(a))
    return rows.select(
        "conv_id", "ord", "role", "parts",
        F.concat(F.lit(OPEN), escaped(F.col("role"), role=True), F.lit("\n")).alias("header"),
        F.array_join(F.transform("parts", shown), PART).alias("body"),
        media.alias("attachments"), (words + F.aggregate(media, F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"])).alias("n_tokens"),
    )


def formatted(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss, attachments, n_tokens): one row for each conversation, null ids being one.

    loss: offset and length, in bytes of UTF-8, of the bodies of the turns that are learned. Turns stand in order of
    turn (nulls last), then role and parts; repeated turns each count; a conversation without rows has none.
    """
    turns = visited(messages).withColumn("_shown", F.concat("header", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("_shown").cast("long")).over(order), F.lit(0)) + F.octet_length("header")
    turns = turns.withColumn("_span", F.struct(start.alias("start"), F.octet_length("body").cast("long").alias("length")))
    all_turns = F.array_sort(F.collect_list(F.struct("ord", "_shown", "_span", "role", "attachments", "n_tokens")))
    one = turns.groupBy("conv_id").agg(all_turns.alias("t"))
    return one.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["_shown"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == learned), lambda x: x["_span"]).alias("loss"),
        F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["n_tokens"]).alias("n_tokens"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """conversations with turns (role, text, media) parsed from the formatted string, and the text under its loss mask.

    A part that begins with "<" is a placeholder, since texts have it escaped: it is in media and no part of a text.
    """
    shown = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    head = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substring(x, F.length(head(x)) + 2, F.length(x))
    plain = lambda b: F.array_join(F.transform(F.filter(F.split(b, PART), lambda p: ~p.startswith("<")), lambda p: unescaped(p)), "")
    media = lambda b: F.filter(F.split(b, PART), lambda p: p.startswith("<"))
    turns = F.transform(shown, lambda x: F.struct(unescaped(F.substring(head(x), len(OPEN) + 1, F.length(x)), role=True).alias("role"), plain(body(x)).alias("text"), media(body(x)).alias("media")))
    whole = F.encode("formatted", "UTF-8")
    masked = F.transform("loss", lambda s: plain(F.decode(F.substring(whole, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    return conversations.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = "\\### Assistant: </turn> ok"
    rows = rows.union(spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(trap)))
    part = F.struct(F.lit("text").alias("type"), text_or_empty("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))
    back = read_back(formatted(rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens",
    )


SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
lens as (
  select *, length(replace(replace(text, '\', '\b'), '<', '\l')) as body,
         length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) as head,
         len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as words
  from rows)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(6 + head + 1 + body + 8)::bigint as formatted_chars, sum(words)::bigint as n_tokens
from lens group by conv_id
"""
