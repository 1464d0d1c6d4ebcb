"""The three jobs end to end, as compositions of the operators.

``build_store`` turns raw documents into a passage table, a BM25 index and a vector store,
three jobs joined by files. ``ask`` turns a table of questions with their history into
request rows and default answers. ``finish`` turns received deltas into answer records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.text import embedding_input
from lectern.operators import answers, assemble, embedding, lexical, passages, segment, vector_search
from lectern.sources import vector_store


@dataclass
class Store:
    """What questions are answered from."""

    passages: DataFrame  # pos, book, abbr, chapter, num, text, ref
    index: lexical.LexicalIndex
    vectors: DataFrame  # pos, ref, q, scale, model, dim

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Store:
        return cls(
            spark.read.parquet(f"{path}/passages"),
            lexical.LexicalIndex.read(spark, f"{path}/index"),
            vector_store.read_vector_store(spark, f"{path}/store"),
        )


def build_store(docs: DataFrame, path: str, books: list[str] | None = None, dim: int = 64) -> Store:
    """Raw documents ``(doc_id, value)`` to a stored, searchable corpus.

    ``pos`` orders the passages: document, then book, chapter and number. Each stage is
    written before the next reads it, so a lost executor costs a task and not the job.
    """
    spark = docs.sparkSession
    found = segment.structure(docs, segment.book_dimension(spark, books), books)
    # ids rise with the sorted ranges, so they are unique and follow the order of the corpus
    order = ["doc_id", "ord", "chapter", "num"]
    placed = found.repartitionByRange(*order).sortWithinPartitions(*order)
    passages.with_refs(placed.withColumn("pos", F.monotonically_increasing_id())).write.mode(
        "overwrite"
    ).parquet(f"{path}/passages")

    rows = spark.read.parquet(f"{path}/passages")
    lexical.LexicalIndex.build(rows).write(f"{path}/index")
    inputs = rows.select("pos", "ref", embedding_input(F.col("ref"), F.col("text")).alias("text"))
    vectors = inputs.select("pos", "ref", embedding.hashed_vector(F.col("text"), dim).alias("v")).withColumns(
        {"model": F.lit(f"hashed-{dim}"), "dim": F.lit(dim)}
    )
    vector_store.write_vector_store(vector_search.quantize_store(vectors), f"{path}/store")
    return Store.read(spark, path)


def ask(
    questions: DataFrame,
    messages: DataFrame,
    store: Store,
    query_vectors: DataFrame | None = None,
    qa_hits: DataFrame | None = None,
    k: int = fixed.DEFAULT_K,
) -> tuple[DataFrame, DataFrame]:
    """Request rows, and default answers for the questions without any hit.

    ``questions`` (query_id, question); ``messages`` (query_id, turn, role, content). The
    search text is the question behind the last user messages; ``query_vectors`` (query_id,
    v) are the vectors of those texts where there are any, all others are searched by words.
    ``qa_hits`` (query_id, rank, score, question, answer) below the threshold are left out.
    """
    accepted, _ = assemble.ask_filter(questions)
    history = messages.withColumnRenamed("query_id", "conv_id")
    expanded = assemble.expanded_queries(
        accepted.withColumnRenamed("query_id", "conv_id"), history
    ).select(F.col("conv_id").alias("query_id"), F.col("query").alias("text"))
    hits = lexical.search(expanded, store.index, k).withColumn("mode", F.lit("bm25"))
    if query_vectors is not None:
        hits = assemble.with_fallback(vector_search.nearest(query_vectors, store.vectors, k), hits, store.passages)
    context = assemble.passage_context(hits.join(store.passages, "pos"))
    spark = questions.sparkSession
    if qa_hits is None:
        id_type = questions.schema["query_id"].dataType.simpleString()
        qa = spark.createDataFrame([], f"query_id {id_type}, block string")
    else:
        qa = assemble.qa_context(vector_search.relevant(qa_hits))
    recent = assemble.history_window(history).withColumnRenamed("conv_id", "query_id")
    return assemble.request_rows(accepted, recent, context, qa), assemble.unanswered(accepted, hits)


def finish(deltas: DataFrame, store: Store) -> DataFrame:
    """Answer records of finished answers, quotations checked against the corpus."""
    return answers.results(deltas, store.passages)
