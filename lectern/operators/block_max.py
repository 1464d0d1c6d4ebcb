"""BM25 over stored postings, read by term and cut off by block maxima.

Documents are dealt into ranges of RANGE_DOCS. The index holds one row a (term, range): the
postings of the term in the range and ``top``, the greatest saturation among them. Rows lie in
folders by a hash of the term, so a search reads the folders of its terms only, and of most rows
just the columns (term, range, top).

A query's bound for a range is the sum of weight times ``top`` over its terms; no document of the
range scores higher. The ranges with the highest bounds are scored first. Their k-th score is a
floor, and of all other ranges only those whose bound reaches it are read. So the result is that
of scoring everything. Ranges and groups of queries bound what a task holds, whatever a term's
frequency or the number of queries; only counts go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern import fixed
from lectern.operators import lexical
from lectern.operators.lexical import _expand
from lectern.operators.topk import DIGITS
from lectern.session import written

#: Documents of a range, folders of the index, ranges that give a query its floor, terms of queries that a task holds.
RANGE_DOCS, BUCKETS, SEEDS, GROUP_TERMS = 4096, 64, 2, 100_000
#: Names of blocks that may be broadcast; of more, blocks are shuffled to them.
NEEDED_ROWS = 500_000
_BLOCK = "term string, range bigint, top double, pos array<bigint>, tf array<int>, len array<int>"


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _range_rows(docs: pa.Table, number: int, avg_len: float) -> pa.RecordBatch:
    """Posting rows of one range of documents (pos, tokens, len), by term."""
    lists = docs.column("tokens").combine_chunks()
    counts = pc.list_value_length(lists).fill_null(0).to_numpy()
    words = lists.flatten().dictionary_encode()
    owner, n = _expand(counts)[0], docs.num_rows
    keys, tf = np.unique(words.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    term, doc = np.divmod(keys, n)
    length = docs.column("len").to_numpy()[doc]
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    impact = lexical.saturation(tf, length, avg_len)
    offsets = pa.array(np.r_[starts, len(term)].astype(np.int32))

    def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.array(values, kind))

    return pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(term[starts])),
            pa.array(np.full(len(starts), number, np.int64)),
            pa.array(np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0)),
            listed(docs.column("pos").to_numpy()[doc], pa.int64()),
            listed(tf, pa.int32()),
            listed(length, pa.int32()),
        ],
        ["term", "range", "top", "pos", "tf", "len"],
    )


def _range_maker(avg_len: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == size:
                    yield _range_rows(pa.Table.from_batches(held), number, avg_len)
                    number, held, rows = number + 1, [], 0
        if held:
            yield _range_rows(pa.Table.from_batches(held), number, avg_len)

    return run


@dataclass
class BlockIndex:
    """The stored index of a corpus."""

    STATISTICS = "n bigint, avg_len double, ranges bigint"  # ranges: at most
    blocks: DataFrame  # term, range, top, pos, tf, len, bucket
    terms: DataFrame  # term, df
    statistics: DataFrame  # n, avg_len, ranges

    @classmethod
    def write(cls, docs: DataFrame, path: str, text: str = "text", range_docs: int = RANGE_DOCS) -> BlockIndex:
        """Index a corpus (pos, text) below ``path`` and read the index.

        Texts are tokenized twice: for the lengths, and for the postings, whose ``top`` needs the mean
        length. Posting rows are made where the documents lie; the one shuffle brings rows of a
        folder together, a million documents a file.
        """
        spark = docs.sparkSession
        known = lexical.corpus_statistics(docs, text).first()
        # every partition may end in a range that is not full
        ranges = known["n"] // range_docs + docs.rdd.getNumPartitions()
        spark.createDataFrame([(*known, ranges)], cls.STATISTICS).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
        rows = lexical.tokenized(docs, text).mapInArrow(_range_maker(known["avg_len"] or 1.0, range_docs), _BLOCK)
        part = F.pmod(F.xxhash64("range"), F.lit(1 + known["n"] // 1_000_000))
        rows.withColumn("bucket", _bucket()).repartition("bucket", part).sortWithinPartitions("bucket", "term", "range").write.partitionBy(
            "bucket"
        ).mode("overwrite").parquet(f"{path}/blocks")
        blocks = spark.read.schema(f"{_BLOCK}, bucket int").parquet(f"{path}/blocks")
        blocks.groupBy("term").agg(F.sum(F.size("tf")).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockIndex:
        blocks = spark.read.schema(f"{_BLOCK}, bucket int").parquet(f"{path}/blocks")
        terms = spark.read.schema("term string, df bigint").parquet(f"{path}/terms")
        return cls(blocks, terms, spark.read.schema(cls.STATISTICS).parquet(f"{path}/statistics"))

    def of_buckets(self, numbers: list[int]) -> BlockIndex:
        """The index with the rows of some folders only; the others are not read."""
        return BlockIndex(self.blocks.where(F.col("bucket").isin(numbers)), self.terms, self.statistics)


def weighted_terms(queries: DataFrame, index: BlockIndex) -> DataFrame:
    """``(query_id, term, weight, bucket)``: known terms of each query, idf times repeats."""
    n = index.statistics.select("n").scalar()
    weight = lexical.inverse_frequency(n, F.col("df")) * F.col("qtf")
    return lexical.query_terms(queries).join(index.terms, "term").select("query_id", "term", weight.alias("weight"), _bucket().alias("bucket"))


def bounds(asked: DataFrame, index: BlockIndex) -> DataFrame:
    """``(query_id, range, bound)``: what no document of the range scores above."""
    tops = index.blocks.select("bucket", "term", "range", "top")
    return (
        tops.join(asked, ["bucket", "term"])
        .groupBy("query_id", "range")
        .agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
    )


def _scorer(k: int, avg_len: float, query_type: pa.DataType):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        lists = {c: blocks.column(c).combine_chunks() for c in ("pos", "tf", "len")}
        counts = pc.list_value_length(lists["pos"]).to_numpy()
        starts = np.cumsum(counts) - counts
        pos, doc = np.unique(lists["pos"].flatten().to_numpy(), return_inverse=True)
        impact = lexical.saturation(lists["tf"].flatten().to_numpy(), lists["len"].flatten().to_numpy(), avg_len)
        vocabulary = blocks.column("term").combine_chunks()
        out: list[list] = [[], [], []]
        for query, terms, weights in zip(*(queries.column(c) for c in ("query_id", "terms", "weights"))):
            at = pc.index_in(terms.values, value_set=vocabulary)
            held = at.is_valid().to_numpy(zero_copy_only=False)
            at, weight = at.drop_null().to_numpy(), weights.values.to_numpy()[held]
            owner, place = _expand(counts[at])
            entry = starts[at][owner] + place
            score = np.bincount(doc[entry], weights=impact[entry] * weight[owner], minlength=len(pos))
            hit = np.flatnonzero(score > 0)
            best = hit[np.lexsort((pos[hit], -np.round(score[hit], DIGITS)))[:k]]
            out[0] += [query.as_py()] * len(best)
            out[1].append(pos[best])
            out[2].append(score[best])
        return pa.table(
            {
                "query_id": pa.array(out[0], query_type),
                "pos": pa.array(np.concatenate(out[1]) if out[1] else [], pa.int64()),
                "score": pa.array(np.concatenate(out[2]) if out[2] else [], pa.float64()),
            }
        )

    return run


def _scored(pairs: DataFrame, asked: DataFrame, vectors: DataFrame, groups: int, index: BlockIndex, k: int, avg_len: float, most_needed: int) -> DataFrame:
    """The k best documents of each (query_id, range). Only blocks that some pair needs are read;
    their names are broadcast if there can be no more than NEEDED_ROWS."""
    kind = vectors.schema["query_id"].dataType
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group")
    needed = pairs.join(asked, "query_id").select("bucket", "term", "range")
    if most_needed <= NEEDED_ROWS:
        needed = F.broadcast(needed.distinct())
    blocks = index.blocks.join(needed, ["bucket", "term", "range"], "left_semi").drop("bucket", "top")
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = pairs.select("query_id", "range").join(vectors, "query_id").withColumn("group", group)
    return (
        blocks.groupBy("range", "group")
        .cogroup(queries.groupBy("range", "group"))
        .applyInArrow(
            _scorer(k, avg_len, to_arrow_type(kind)), f"query_id {kind.simpleString()}, pos bigint, score double"
        )
    )


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", DIGITS)), "pos")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    queries: DataFrame, index: BlockIndex, k: int = fixed.DEFAULT_K, seeds: int = SEEDS, group_terms: int = GROUP_TERMS
) -> DataFrame:
    """``(query_id, pos, score, rank)``, positive scores only, ties in corpus order.

    Equal to scoring every document: a range is left out only if its bound is below the k-th score
    of the ranges seen first, by more than sums of doubles differ. Ranked on ten decimals; ``score``
    is given to six. Queries without a known term have no rows.
    """
    known = index.statistics.first()
    avg_len = known["avg_len"] or 1.0
    asked = written(weighted_terms(queries, index), "bm25-terms")
    # at most BUCKETS numbers
    counted = {r["bucket"]: r["count"] for r in asked.groupBy("bucket").count().collect()}
    index, n_terms = index.of_buckets(sorted(counted)), sum(counted.values())
    vectors = asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("p"))
    vectors = vectors.select("query_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))
    groups = 1 + n_terms // group_terms
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    bounded = written(bounds(asked, index), "bm25-bounds")
    first = bounded.withColumn("_n", F.row_number().over(by_bound)).where(F.col("_n") <= seeds).drop("_n")
    seen = written(_scored(first, asked, vectors, groups, index, k, avg_len, n_terms * seeds), "bm25-seeds")
    floor = _ranked(seen, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = bounded.join(first.select("query_id", "range"), ["query_id", "range"], "left_anti").join(floor, "query_id", "left")
    reach = rest.where(F.col("floor").isNull() | (F.col("bound") * (1 + 1e-12) + 1e-9 >= F.col("floor")))
    hits = seen.unionByName(_scored(reach.select("query_id", "range"), asked, vectors, groups, index, k, avg_len, n_terms * known["ranges"]))
    return _ranked(hits, k).withColumn("score", F.round("score", 6))
