"""Row types of the library derived from the test tables, for Spark and for SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import ref_key
from lectern.operators.ranking import row_numbers
from lectern.sources.tables import read_table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents", "doc_id")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(F.col("doc_id").alias("pos"), "text")


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """One passage per document; the book is named after its source."""
    chapter = F.floor(F.col("doc_id") / 50) + 1
    num = F.col("doc_id") % 50 + 1
    return documents(spark, folder).select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("Source "), F.substring("source", 4, 10)).alias("book"),
        F.col("source").alias("abbr"),
        chapter.alias("chapter"),
        num.alias("num"),
        "text",
        "lang",
        ref_key(F.col("source"), chapter, num).alias("ref"),
    )


PASSAGES = """passages as (
  select doc_id as pos, 'Source ' || substr(source, 4) as book, source as abbr,
    doc_id // 50 + 1 as chapter, doc_id % 50 + 1 as num, text, lang,
    source || ' ' || (doc_id // 50 + 1) || ':' || (doc_id % 50 + 1) as ref
  from documents)"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("pos"), F.col("embedding").alias("v"), "label"
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages of the two roles a history has."""
    return (
        read_table(spark, folder, "conversations")
        .filter(F.col("role") != "system")
        .select("conv_id", "turn", "role", F.col("text").alias("content"))
    )


MESSAGES = """messages as (
  select conv_id, turn, role, text as content from conversations where role <> 'system')"""


def live_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Each user message with the answer that follows it, if any, and a passage, if any.

    The answer is found by an equi-join on conversation and turn, so a long conversation is
    spread like any other data.
    """
    rows = messages(spark, folder)
    asked = rows.filter(F.col("role") == "user")
    replies = rows.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("content").alias("response")
    )
    verse = passages(spark, folder).filter(F.col("lang") != "en").select(
        F.col("pos").alias("_pos"),
        F.concat(
            "book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("num").cast("string")
        ).alias("verse_reference"),
        F.col("text").alias("verse_text"),
    )
    paired = row_numbers(asked.join(replies, ["conv_id", "turn"], "left"), "conv_id", "turn", "ord")
    return (
        paired.withColumn("ord", (F.col("ord") - 1).cast("int"))
        .withColumn("_pos", F.col("conv_id") + F.col("ord"))
        .join(verse, "_pos", "left")
        .select(
            F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("ord").cast("string")).alias("id"),
            F.col("conv_id").cast("string").alias("conversation_id"),
            F.col("turn").alias("seq"),
            "ord",
            F.col("content").alias("question"),
            "verse_reference",
            "verse_text",
            "response",
            F.when(F.col("response").isNull(), "streaming").otherwise("done").alias("status"),
        )
    )


LIVE_TURNS = f"""{PASSAGES}, {MESSAGES}, paired as (
  select u.conv_id, u.turn, u.content as question, a.content as response,
    cast(row_number() over (partition by u.conv_id order by u.turn) - 1 as int) as ord
  from messages u left join messages a
    on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  where u.role = 'user'),
live as (
  select t.conv_id || '-' || t.ord as id, cast(t.conv_id as varchar) as conversation_id,
    t.turn as seq, t.ord, t.question,
    p.book || ' ' || p.chapter || ':' || p.num as verse_reference, p.text as verse_text,
    t.response, case when t.response is null then 'streaming' else 'done' end as status
  from paired t left join passages p on p.pos = t.conv_id + t.ord and p.lang <> 'en')"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """The finished turns as stored, an hour apart, from the conversation's first event on."""
    start = read_table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("conversation_id"), F.col("ts")
    )
    done = live_turns(spark, folder).filter("status = 'done'")
    return done.join(start, "conversation_id").select(
        "id",
        "conversation_id",
        "ord",
        "question",
        "verse_reference",
        "verse_text",
        "response",
        F.lit(False).alias("liked"),
        F.expr("ts + make_dt_interval(0, ord)").alias("created_at"),
    )


TURNS = f"""{LIVE_TURNS}, turns as (
  select l.id, l.conversation_id, l.ord, l.question, l.verse_reference, l.verse_text, l.response,
    false as liked, e.ts + l.ord * interval 1 hour as created_at
  from live l join events e on cast(e.event_id as varchar) = l.conversation_id
  where l.status = 'done')"""


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations: owner by number, time of an event, the system message as title."""
    rows = read_table(spark, folder, "conversations")
    titles = rows.filter("role = 'system'").select("conv_id", F.col("text").alias("title"))
    start = read_table(spark, folder, "events").select(F.col("event_id").alias("conv_id"), "ts")
    return (
        rows.select("conv_id")
        .distinct()
        .join(titles, "conv_id", "left")
        .join(start, "conv_id")
        .select(
            F.col("conv_id").cast("string").alias("id"),
            (F.col("conv_id") % 150).cast("string").alias("user_id"),
            F.nullif(F.substring("title", 1, 200), F.lit("")).alias("title"),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("updated_at"),
        )
    )


HEADERS = """headers as (
  select cast(c.conv_id as varchar) as id, cast(c.conv_id % 150 as varchar) as user_id,
    nullif(substr(s.text, 1, 200), '') as title, e.ts as created_at, e.ts as updated_at
  from (select distinct conv_id from conversations) c
  left join conversations s on s.conv_id = c.conv_id and s.role = 'system'
  join events e on e.event_id = c.conv_id)"""


def seconds(name: str):
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_seconds(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') as {name.split('.')[-1]}"


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
