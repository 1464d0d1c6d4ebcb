"""Exact top-k of every query against every row, without forming the pairs.

Both searches that score a whole store (vectors, BM25) and the nearest-place list share this
plan. One side, the smaller one, is cut into blocks of bounded size. Each block goes to all
tasks and the other side is scored where it lies, in Arrow batches, by one numpy kernel call
for a batch; the work that depends on the block alone is done once in a task. A task keeps only
its k best rows per query, so what is shuffled is tasks x queries x k rows, whatever the size of
the store. The results of the tasks are merged in two steps: first of a group of neighbouring
tasks, then of a query.

The blocks are fetched while the plan is built, one after the other: the driver holds one block,
never a whole side. More blocks mean more passes over the other side, with the same memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the shared side that a task holds at a time.
BLOCK_BYTES = 64 << 20
#: Cells of a score matrix made at a time.
SCORE_CELLS = 4_000_000
#: Scores that agree in this many decimals are ties. Sums of doubles differ beyond it with the
#: order of their terms.
DIGITS = 10
#: Neighbouring tasks whose results meet first.
GROUP_TASKS = 1_000

# prepared = kernel(shared block); prepared(batch) -> float64 matrix (batch x block); NaN marks
# "no candidate"
Prepared = Callable[[pa.Table], np.ndarray]
Kernel = Callable[[pa.Table], Prepared]


class _Best:
    """The k best rows of each query of a block seen so far in one task, by rounded score."""

    def __init__(self, n_queries: int, k: int, digits: int) -> None:
        self.k = k
        self.digits = digits
        self.query = np.zeros(0, dtype=np.int64)
        self.pos = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.floor = np.full(n_queries, -np.inf)

    def add(self, by_query: np.ndarray, pos: np.ndarray) -> None:
        """``by_query`` is queries x rows; ties at the k-th score are all looked at."""
        by_query = np.where(np.isnan(by_query), -np.inf, by_query)
        keys = np.round(by_query, self.digits)
        floor = self.floor
        if keys.shape[1] > self.k:
            cut = keys.shape[1] - self.k
            floor = np.maximum(floor, np.partition(keys, cut, axis=1)[:, cut])
        qi, ri = np.nonzero((keys >= floor[:, None]) & (keys > -np.inf))
        query = np.concatenate([self.query, qi])
        at = np.concatenate([self.pos, pos[ri]])
        score = np.concatenate([self.score, by_query[qi, ri]])
        key = np.round(score, self.digits)
        order = np.lexsort((at, -key, query))
        query, at, score, key = query[order], at[order], score[order], key[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        kept = place < self.k
        full = place == self.k - 1
        self.floor[query[full]] = key[full]
        self.query, self.pos, self.score = query[kept], at[kept], score[kept]

    def rows(self, query_ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(self.query)),
                pa.array(self.pos),
                pa.array(self.score),
                pa.array(np.round(self.score, self.digits)),
            ],
            names=["query_id", "pos", "score", "_key"],
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as stream:
                stream.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()])], names=["chunk"])


def _cut(table: pa.Table, block_bytes: int) -> Iterator[pa.Table]:
    step = max(1, int(table.num_rows * block_bytes / max(1, table.nbytes)))
    for start in range(0, table.num_rows, step):
        yield table.slice(start, step)


def _blocks(side: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """The rows of a side as broadcast Arrow tables of about ``block_bytes``; a larger single
    row stands alone. One partition at a time comes to the driver."""
    held: list[pa.Table] = []
    size = 0

    def shared() -> Broadcast:
        block = pa.concat_tables(held).combine_chunks()
        return side.sparkSession.sparkContext.broadcast(block)

    for row in side.mapInArrow(_pack, "chunk binary").toLocalIterator():
        for part in _cut(pa.ipc.open_stream(row.chunk).read_all(), block_bytes):
            if held and size + part.nbytes > block_bytes:
                yield shared()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield shared()


def _ids(queries: pa.Table) -> pa.Array:
    return queries.column("query_id").combine_chunks()


def _over_rows(block: Broadcast, kernel: Kernel, k: int, digits: int):
    """Rows stream by, the block holds queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value
        best, prepared = _Best(queries.num_rows, k, digits), kernel(queries)
        for part in _parts(batches, queries.num_rows):
            best.add(prepared(part).T, part.column("pos").to_numpy())
        yield best.rows(_ids(queries))

    return run


def _over_queries(block: Broadcast, kernel: Kernel, k: int, digits: int):
    """Queries stream by, the block holds rows: a query's best of the block are known at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = block.value
        prepared, pos = kernel(rows), rows.column("pos").to_numpy()
        for part in _parts(batches, rows.num_rows):
            best = _Best(part.num_rows, k, digits)
            best.add(prepared(part), pos)
            yield best.rows(_ids(part))

    return run


def _parts(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.Table]:
    step = max(1, SCORE_CELLS // max(1, block_rows))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield pa.Table.from_batches([batch.slice(start, step)])


def _merge(parts: DataFrame, k: int) -> DataFrame:
    best_first = [F.desc("_key"), F.asc("pos")]
    group = F.floor(F.spark_partition_id() / GROUP_TASKS)
    some = Window.partitionBy("query_id", "_group").orderBy(*best_first)
    parts = parts.withColumn("_group", group).withColumn("rank", F.row_number().over(some))
    every = Window.partitionBy("query_id").orderBy(*best_first)
    merged = parts.filter(F.col("rank") <= k).drop("_group", "rank")
    return merged.withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= k).drop("_key")


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    kernel: Kernel,
    k: int,
    block_bytes: int = BLOCK_BYTES,
    share_rows: bool = False,
    digits: int = DIGITS,
) -> DataFrame:
    """``(query_id, pos, score, rank)``: the k best rows of each query, ties by ``pos``.

    ``rows`` has a bigint ``pos``, ``queries`` a ``query_id``; all other columns are the
    kernel's. The queries are shared in blocks unless ``share_rows`` says that the rows are the
    smaller side. ``kernel`` takes a block of the shared side and returns the function that
    scores batches of the other. Scores that agree in ``digits`` decimals are ties; they are returned
    whole.
    """
    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, pos bigint, score double, _key double"
    shared, streamed, over = (rows, queries, _over_queries) if share_rows else (queries, rows, _over_rows)
    found = None
    for block in _blocks(shared, block_bytes):
        part = streamed.mapInArrow(over(block, kernel, k, digits), out)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], out)
    return _merge(found, k)
