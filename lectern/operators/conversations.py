"""Conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.dates import long_date
from lectern.functions.text import cap, export_text, title_or_null
from lectern.operators.ranking import row_numbers

CONVERSATIONS = "id string, user_id string, title string, created_at timestamp, updated_at timestamp"
TURNS = (
    "id string, conversation_id string, ord int, question string, verse_reference string,"
    " verse_text string, response string, liked boolean, created_at timestamp"
)
RULE = "─" * 40
SHORT_RULE = "—" * 20


def conversation_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """Missing times become ``now``."""
    return rows.withColumns(
        {c: F.coalesce(F.col(c), now) for c in ("created_at", "updated_at")}
    )


def turn_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """A missing like is false, a missing time ``now``."""
    return rows.withColumns(
        {
            "liked": F.coalesce("liked", F.lit(False)),
            "created_at": F.coalesce("created_at", now),
        }
    )


def constraint_report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """``(rule, violations)``: missing values and turns without a conversation."""

    def nulls(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
        counted = df.agg(
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"{table}.{c} not null") for c in columns]
        )
        return counted.unpivot([], [F.col(f"`{c}`") for c in counted.columns], "rule", "violations")

    orphans = turns.join(
        conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti"
    ).agg(F.count("*").alias("violations"))
    return (
        nulls(conversations, "conversations", ["id", "user_id", "created_at", "updated_at"])
        .unionByName(
            nulls(turns, "turns", ["id", "conversation_id", "ord", "question", "response", "liked"])
        )
        .unionByName(orphans.select(F.lit("turns.conversation_id exists").alias("rule"), "violations"))
    )


def new_conversations(requests: DataFrame, now: Column) -> DataFrame:
    """Rows to append for ``(id, user_id, title)`` requests."""
    return requests.select(
        "id",
        "user_id",
        title_or_null(F.coalesce("title", F.lit(""))).alias("title"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def accept_turns(inserts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Capped rows to append, and the rejected ones (question or response missing)."""
    valid = F.col("question").isNotNull() & F.col("response").isNotNull()
    accepted = inserts.filter(valid).withColumns(
        {
            "question": cap(F.col("question"), fixed.QUESTION_LIMIT),
            "response": cap(F.col("response"), fixed.RESPONSE_LIMIT),
        }
    )
    return accepted, inserts.filter(~valid)


def seed_titles(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """An untitled conversation takes its turn 0 question; the first inserted wins."""
    first = (
        turns.filter(F.col("ord") == 0)
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(F.min_by("question", F.struct("created_at", "id")).alias("_q"))
    )
    return (
        conversations.join(first, "id", "left")
        .withColumn("title", F.coalesce("title", cap(F.col("_q"), fixed.SEEDED_TITLE_LIMIT)))
        .drop("_q")
    )


def touch(conversations: DataFrame, inserted: DataFrame) -> DataFrame:
    """``updated_at`` moves to the latest inserted turn."""
    latest = inserted.groupBy(F.col("conversation_id").alias("id")).agg(
        F.max("created_at").alias("_at")
    )
    # greatest() skips nulls, so conversations without inserts keep their time
    return (
        conversations.join(latest, "id", "left")
        .withColumn("updated_at", F.greatest("updated_at", "_at"))
        .drop("_at")
    )


def apply_likes(turns: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change per (conversation, ord) sets ``liked``; bad changes are ignored."""
    last = (
        changes.filter("ord is not null and liked is not null")
        .groupBy("conversation_id", "ord")
        .agg(F.max_by("liked", F.struct("ts", "change_id")).alias("_liked"))
    )
    return (
        turns.join(last, ["conversation_id", "ord"], "left")
        .withColumn("liked", F.coalesce("_liked", "liked"))
        .select(*turns.columns)
    )


def owned_conversations(conversations: DataFrame, users: DataFrame) -> DataFrame:
    """The conversations of the given users (``user_id``)."""
    return conversations.join(users.select("user_id"), "user_id", "left_semi")


def owned_turns(turns: DataFrame, conversations: DataFrame, users: DataFrame) -> DataFrame:
    """The turns whose conversation belongs to one of the users."""
    mine = owned_conversations(conversations, users).select(F.col("id").alias("conversation_id"))
    return turns.join(mine, "conversation_id", "left_semi")


def recent(conversations: DataFrame, limit: int = fixed.RECENT_LIMIT) -> DataFrame:
    """Newest conversations of each user, cut per task before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.asc("id"))
    return (
        conversations.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= limit)
        .select("user_id", "position", "id", "title", "created_at", "updated_at")
    )


def load(requests: DataFrame, conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Requested conversations with their turns, one row per turn.

    ``found`` is false for an unknown id; a conversation without turns is one row with null
    ``ord``. Rows are told apart by ``ord``: a conversation of any length stays many rows and
    is never gathered into one.
    """
    heads = requests.select("id").join(
        conversations.select("id", "title", "created_at", "updated_at", F.lit(True).alias("found")),
        "id",
        "left",
    ).withColumn("found", F.coalesce("found", F.lit(False)))
    body = turns.select(
        F.col("conversation_id").alias("id"),
        "ord", "question", "verse_reference", "verse_text", "response", "liked",
    )
    return heads.join(body, "id", "left")


def delete(
    conversations: DataFrame, turns: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the conversations ``doomed(id)``."""
    ids = doomed.select("id")
    return (
        conversations.join(ids, "id", "left_anti"),
        turns.join(ids.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_anti"),
    )


def unsaved(live_turns: DataFrame, saved: DataFrame) -> DataFrame:
    """Finished turns not yet stored; ``ord`` is the place in the conversation."""
    placed = row_numbers(live_turns, "conversation_id", "seq", "ord").withColumn(
        "ord", F.col("ord") - 1
    )
    return placed.filter((F.col("status") == "done") & (F.col("response") != "")).join(
        saved.select("id"), "id", "left_anti"
    )


def exportable(live_turns: DataFrame) -> DataFrame:
    """Done turns with a response or a passage."""
    return live_turns.filter(
        (F.col("status") == "done")
        & ((F.coalesce("response", F.lit("")) != "") | F.col("verse_reference").isNotNull())
    ).select("conversation_id", "ord", "question", "verse_reference", "verse_text", "response")


def transcript_parts(
    turns: DataFrame,
    date: Column,
    heading: str = "CONVERSACIÓN",
    footer: str = "",
) -> DataFrame:
    """The transcript of each conversation as ``(conversation_id, part, text)``.

    The texts of a conversation, joined in ``part`` order (-1 the header, then one part per
    turn by ``ord``, last the footer), are its transcript. Parts are rows, so a conversation
    of any length is written without being gathered.
    """
    passage = F.concat(
        F.col("verse_reference"), F.lit('\n"'), export_text(F.col("verse_text")), F.lit('"\n\n')
    )
    body = turns.select(
        "conversation_id",
        F.col("ord").cast("bigint").alias("part"),
        F.concat(
            F.lit("Tu pregunta:\n"),
            F.col("question"),
            F.lit("\n\n"),
            F.coalesce(passage, F.lit("")),
            F.coalesce(F.concat(F.nullif("response", F.lit("")), F.lit("\n\n")), F.lit("")),
            F.lit(RULE + "\n\n"),
        ).alias("text"),
    )
    ends = turns.groupBy("conversation_id").agg(F.max("ord").alias("last"))
    head = F.concat(
        F.lit(heading + "\nConversación del "), long_date(date, weekday=True), F.lit("\n" + RULE + "\n\n")
    )
    edges = ends.select(
        "conversation_id",
        F.explode(
            F.array(
                F.struct(F.lit(-1).cast("bigint").alias("part"), head.alias("text")),
                F.struct((F.col("last") + 1).cast("bigint").alias("part"), F.lit(footer).alias("text")),
            )
        ).alias("e"),
    ).select("conversation_id", "e.part", "e.text")
    return edges.unionByName(body)


def _quoted() -> Column:
    return F.concat(F.lit('"'), F.col("verse_text"), F.lit('"\n— '), F.col("verse_reference"))


def share_text(turns: DataFrame, signature: str = "") -> DataFrame:
    """The text of a single shared turn; ``signature`` closes it."""
    parts = F.array(
        F.col("question"),
        F.concat(F.lit("\n"), _quoted()),
        F.concat(F.lit("\n"), F.nullif("response", F.lit(""))),
        F.lit("\n— " + signature if signature else None).cast("string"),
    )
    return turns.select(
        "conversation_id",
        "ord",
        F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n").alias("text"),
    )


def share_parts(turns: DataFrame, title: str = "Conversación") -> DataFrame:
    """The share text of each conversation as parts; joined in ``ord`` order they are it.

    Part of the first turn carries the title, later ones the rule in front.
    """
    starts = turns.groupBy("conversation_id").agg(F.min("ord").alias("_first"))
    first = F.col("ord") == F.col("_first")
    lines = F.array(
        F.concat(F.lit("Pregunta: "), F.col("question")),
        F.concat(F.lit("\n"), _quoted()),
        F.concat(F.lit("\n"), F.nullif("response", F.lit(""))),
    )
    opening = F.when(first, F.lit(f"{title}\n\n")).otherwise(F.lit(f"\n\n{SHORT_RULE}\n\n"))
    return turns.join(starts, "conversation_id").select(
        "conversation_id",
        "ord",
        F.concat(opening, F.array_join(F.filter(lines, lambda l: l.isNotNull()), "\n")).alias("text"),
    )
