"""From questions and retrieved rows to request tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern import fixed
from lectern.session import written


def ask_filter(questions: DataFrame, text: str = "question") -> tuple[DataFrame, DataFrame]:
    """Trimmed non-empty questions, and the rejected rows."""
    from lectern.functions.text import web_trim

    trimmed = questions.withColumn(text, web_trim(F.coalesce(F.col(text), F.lit(""))))
    return trimmed.filter(F.col(text) != ""), trimmed.filter(F.col(text) == "")


def with_fallback(vector_hits: DataFrame, lexical_hits: DataFrame, passages: DataFrame) -> DataFrame:
    """G1: a query's vector hits when any of them has a passage, else its lexical hits.

    Hits are looked up in ``passages`` (pos, …) first: those without a passage are dropped, and a
    query with nothing left counts as one without vector hits. Ranks are those of the search.
    """
    columns = ["query_id", "pos", "score", "rank"]
    found = vector_hits.join(passages.select("pos"), "pos", "left_semi").select(*columns, F.lit("vector").alias("mode"))
    answered = found.select("query_id").distinct()
    words = lexical_hits.join(answered, "query_id", "left_anti").select(*columns, F.lit("bm25").alias("mode"))
    return found.unionByName(words)


def search_with_fallback(
    queries: DataFrame, vector_hits: DataFrame, passages: DataFrame, words: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """G1: as ``with_fallback``, with ``words`` (a lexical search) asked only for queries without vector hits.

    The vector hits that have a passage are written once; what follows reads them twice.
    """
    columns = ["query_id", "pos", "score", "rank"]
    found = vector_hits.join(passages.select("pos"), "pos", "left_semi").select(*columns, F.lit("vector").alias("mode"))
    found = written(found, "vector-hits")
    left = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(words(left).select(*columns, F.lit("bm25").alias("mode")))


def history_window(messages: DataFrame, size: int = fixed.HISTORY_LIMIT) -> DataFrame:
    """The last ``size`` messages of each conversation.

    ``row_number`` under a limit is cut per task before the shuffle, so a conversation that
    holds much of the data sends no more than ``size`` rows per task.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n")


def expanded_queries(
    questions: DataFrame,
    messages: DataFrame,
    size: int = fixed.HISTORY_LIMIT,
    last: int = fixed.EXPANSION_MESSAGES,
) -> DataFrame:
    """``(conv_id, query)``: last user messages of the window, in order, then the question."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = (
        history_window(messages, size)
        .filter(F.col("role") == "user")
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= last)
        .groupBy("conv_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("turn", "content"))), lambda m: m["content"]),
                " ",
            ).alias("recent")
        )
    )
    return questions.join(recent, "conv_id", "left").select(
        "conv_id", F.concat_ws(" ", "recent", "question").alias("query")
    )


def turns_to_messages(turns: DataFrame, last: int = fixed.HISTORY_LIMIT) -> DataFrame:
    """``(conv_id, turn, role, content)`` of the last completed turns with a response."""
    w = Window.partitionBy("conversation_id").orderBy(F.desc("ord"))
    kept = (
        turns.filter((F.col("status") == "done") & (F.col("response") != ""))
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= last)
    )
    passage = F.when(
        F.col("verse_reference").isNotNull(),
        F.struct(F.col("verse_reference").alias("reference"), F.col("verse_text").alias("text")),
    )
    answer = F.to_json(
        F.struct(passage.alias("verse"), "response"), {"ignoreNullFields": "false"}
    )
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit("assistant").alias("role"), answer.alias("content")),
    )
    return kept.select(
        F.col("conversation_id").alias("conv_id"), "ord", F.posexplode(pair).alias("i", "m")
    ).select("conv_id", (F.col("ord") * 2 + F.col("i")).alias("turn"), "m.role", "m.content")


def _ranked_text(rows: DataFrame, key: str, line, separator: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["line"]), separator).alias("block")
    )


def passage_context(hits: DataFrame) -> DataFrame:
    """``(query_id, block)``; a query has at most k rows here."""
    line = F.format_string("[%s %s:%s] %s", "book", F.col("chapter").cast("string"), F.col("num").cast("string"), "text")
    return _ranked_text(hits, "query_id", line, "\n\n")


def qa_context(hits: DataFrame) -> DataFrame:
    """Numbered question/answer blocks; numbering restarts at 1 over the rows kept."""
    w = Window.partitionBy("query_id").orderBy("rank")
    numbered = hits.withColumn("_i", F.row_number().over(w))
    line = F.format_string("[%d] %s\n%s", "_i", "question", "answer")
    return _ranked_text(numbered, "query_id", line, "\n\n")


def request_rows(
    questions: DataFrame, history: DataFrame, passages: DataFrame, qa: DataFrame
) -> DataFrame:
    """``(query_id, seq, role, parts)``: the history, then one user message of 2-3 parts.

    ``questions`` (query_id, question); ``history`` (query_id, turn, role, content);
    ``passages`` and ``qa`` are context blocks. Calling a model is left to the caller.
    """
    w = Window.partitionBy("query_id").orderBy("turn")
    asked = passages.select("query_id")
    past = (
        history.join(asked, "query_id", "left_semi")
        .withColumn("seq", F.row_number().over(w))
        .select("query_id", "seq", "role", F.array("content").alias("parts"))
    )
    lengths = past.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    parts = F.array(
        F.concat(F.lit(fixed.PASSAGES_PART), F.col("passages")),
        F.concat(F.lit(fixed.QA_PART), F.nullif("qa", F.lit(""))),
        F.concat(F.lit(fixed.QUESTION_PART), F.col("question")),
    )
    final = (
        questions.join(passages.withColumnRenamed("block", "passages"), "query_id")
        .join(qa.withColumnRenamed("block", "qa"), "query_id", "left")
        .join(lengths, "query_id", "left")
        .select(
            "query_id",
            (F.coalesce("n", F.lit(0)) + 1).alias("seq"),
            F.lit("user").alias("role"),
            F.filter(parts, lambda p: p.isNotNull()).alias("parts"),
        )
    )
    return past.unionByName(final)


def unanswered(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Default answer rows for the queries without any hit."""
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id",
        F.lit(None).cast("string").alias("reference"),
        F.lit(None).cast("string").alias("text"),
        F.lit(fixed.NOTHING_FOUND).alias("response"),
    )
