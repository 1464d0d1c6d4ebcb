"""BM25: index tables and search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.binding import items, let
from lectern.functions.text import tokens
from lectern.operators import topk


def tokenized(docs: DataFrame, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """``(pos, tokens, len)`` of a corpus; ``len`` counts repeats."""
    return docs.select("pos", tokens(F.col(text), stop_words).alias("tokens")).withColumn(
        "len", F.size("tokens")
    )


def postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(pos, term, tf, len)``. A document is one row, so its repeats are counted there:
    equal tokens stand together once sorted, and nothing is shuffled at any size."""
    counted = tokenized(docs, text).select("pos", "len", let(F.array_sort("tokens"), _runs).alias("runs"))
    return items(counted, ["pos", "len"], "runs", "run").select("pos", "run.term", "run.tf", "len")


def _runs(ordered: Column) -> Column:
    """Array of struct(term, tf) of a sorted array."""

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))

    starts = F.filter(F.transform(ordered, lambda x, i: i), begins)

    def counted(starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, k: F.struct(
                F.get(ordered, at).alias("term"),
                (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - at).cast("bigint").alias("tf"),
            ),
        )

    return let(starts, counted)


def document_lengths(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(pos, len)`` of all documents, empty ones too."""
    return tokenized(docs, text).select("pos", "len")


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(term, df)``. A row's distinct terms are found in the row, so one shuffle on the
    term, with counts combined before it, is all that is needed."""
    distinct = tokenized(docs, text).withColumn("tokens", F.array_distinct("tokens"))
    return (
        items(distinct, [], "tokens", "term")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row ``(n, avg_len)`` over all documents."""
    return tokenized(docs, text).agg(
        F.count("*").alias("n"),
        (F.coalesce(F.sum("len"), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))).alias("avg_len"),
    )


@dataclass
class LexicalIndex:
    """The stored form of a corpus: tokens per document, term counts, one row of statistics."""

    documents: DataFrame  # pos, tokens, len
    terms: DataFrame  # term, df
    statistics: DataFrame  # n, avg_len

    @classmethod
    def build(cls, docs: DataFrame, text: str = "text") -> LexicalIndex:
        return cls(
            tokenized(docs, text), document_frequencies(docs, text), corpus_statistics(docs, text)
        )

    def write(self, path: str) -> None:
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        # sorted by term: a lookup of query terms reads few row groups
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode(
            "overwrite"
        ).parquet(f"{path}/terms")
        self.statistics.write.mode("overwrite").parquet(f"{path}/statistics")

    @classmethod
    def read(cls, spark, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("documents", "terms", "statistics")))


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """``(query_id, term, qtf)``: the tokens of each query with their repeats counted."""
    asked = queries.select("query_id", tokens(F.col(text)).alias("tokens"))
    return (
        items(asked, ["query_id"], "tokens", "term")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def inverse_frequency(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf, length, avg_len):
    k1, b = fixed.BM25_K1, fixed.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * (length / avg_len)))


def _statistic(index: LexicalIndex, name: str):
    """A corpus statistic as a scalar subquery."""
    return index.statistics.select(name).scalar()


def score_pairs(pairs: DataFrame, index: LexicalIndex) -> DataFrame:
    """BM25 of given ``(query_id, pos, text)`` pairs, ``text`` being the query.

    Unknown terms add nothing; repeated query tokens count each time. Pair and document meet
    on ``pos``; the term frequencies are counted inside that row, and only matched terms go
    on to the join with the term table.
    """

    def count_in(t):
        return F.struct(
            t.alias("term"), F.size(F.filter("tokens", lambda x: x == t)).alias("tf")
        )

    matched = (
        pairs.select("query_id", "pos", tokens(F.col("text")).alias("query_tokens"))
        .join(index.documents, "pos")
        .select("query_id", "pos", "len", F.explode(F.transform("query_tokens", count_in)).alias("m"))
        .select("query_id", "pos", "len", "m.term", "m.tf")
        .filter("tf > 0")
    )
    part = inverse_frequency(_statistic(index, "n"), F.col("df")) * saturation(
        F.col("tf"), F.col("len"), _statistic(index, "avg_len")
    )
    scored = (
        matched.join(index.terms, "term").groupBy("query_id", "pos").agg(F.sum(part).alias("score"))
    )
    return (
        pairs.select("query_id", "pos")
        .join(scored, ["query_id", "pos"], "left")
        .select("query_id", "pos", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    )


def query_vectors(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """``(query_id, terms, weights)``: terms known to the corpus with idf times repeats."""
    weight = inverse_frequency(_statistic(index, "n"), F.col("df")) * F.col("qtf")
    return (
        query_terms(queries)
        .join(index.terms, "term")
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("parts"))
        .select(
            "query_id",
            F.col("parts.term").alias("terms"),
            F.col("parts.weight").alias("weights"),
        )
    )


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of the given lengths: owner of each element, and its place in the list."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def bm25_kernel(queries: pa.Table) -> topk.Prepared:
    """Scores of batches of tokenized documents for a block of weighted queries."""
    n_queries = queries.num_rows
    q_lists = queries.column("terms").combine_chunks()
    q_terms = q_lists.flatten()
    vocabulary = pc.unique(q_terms)
    v = len(vocabulary)
    # the block as lists of (query, weight) per term
    q_of = _expand(np.diff(q_lists.offsets.to_numpy()))[0]
    term_at = pc.index_in(q_terms, value_set=vocabulary).to_numpy()
    by_term = np.argsort(term_at, kind="stable")
    per_term = np.bincount(term_at, minlength=v)
    list_start = np.cumsum(per_term) - per_term
    list_query = q_of[by_term]
    list_weight = queries.column("weights").combine_chunks().flatten().to_numpy()[by_term]

    def prepared(rows: pa.Table) -> np.ndarray:
        n_rows = rows.num_rows
        if v == 0 or n_rows == 0:
            return np.full((n_rows, n_queries), np.nan)
        # the batch as (row, term, tf), terms outside the block left out
        lists = rows.column("tokens").combine_chunks()
        hit = pc.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
        row_ids = _expand(np.diff(lists.offsets.to_numpy()))[0]
        found = hit >= 0
        keys, tf = np.unique(row_ids[found] * v + hit[found], return_counts=True)
        row_of, term_of = np.divmod(keys, v)
        impact = saturation(
            tf, rows.column("len").to_numpy()[row_of], rows.column("avg_len").to_numpy()[row_of]
        )
        scores = np.zeros(n_rows * n_queries)
        fan_out = per_term[term_of]
        done = np.cumsum(fan_out)
        last = done[-1] if len(done) else 0
        cuts = np.searchsorted(done, np.arange(topk.SCORE_CELLS, last, topk.SCORE_CELLS))
        for s in np.split(np.arange(len(keys)), cuts):
            owner, place = _expand(fan_out[s])
            at = list_start[term_of[s]][owner] + place
            scores += np.bincount(
                row_of[s][owner] * n_queries + list_query[at],
                weights=impact[s][owner] * list_weight[at],
                minlength=len(scores),
            )
        scores = scores.reshape(n_rows, n_queries)
        return np.where(scores > 0, scores, np.nan)

    return prepared


def search(
    queries: DataFrame,
    index: LexicalIndex,
    k: int = fixed.DEFAULT_K,
    block_bytes: int = topk.BLOCK_BYTES,
) -> DataFrame:
    """``(query_id, pos, score, rank)``, positive scores only, ties in corpus order.

    Ranked on the score to ten decimals, where the order of a floating-point sum does not show;
    ``score`` is given to six.
    """
    rows = index.documents.withColumn("avg_len", _statistic(index, "avg_len"))
    hits = topk.top_k(rows, query_vectors(queries, index), bm25_kernel, k, block_bytes)
    return hits.withColumn("score", F.round("score", 6))
