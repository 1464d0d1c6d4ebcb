"""Exact top-k by a bit-sliced index over quantised vector components.

A block of the index holds, for each component, the binary digits of its values in all rows of
the block: one bitmap a digit. A query is a sum of components times small integers, so its
scores are a sum of shifted slices; full adders over whole bitmaps (three bitmaps of a place
become one and a carry) give the slices of all scores of the block at once. The top rows are then
read off from the most significant slice downward, and the rows that tie at the boundary are
settled by id. Blocks of queries meet blocks of rows; only the k best of a pair of blocks are
rows of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ready, written

#: Rows of an index block and queries of a query block.
ROWS = 32_768
QUERIES = 1024
SCALE = 64


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``row``, ``id`` and ``q`` (array<bigint>): floor(scale * x) of each component x as double.

    Vectors that are null or hold null or non-finite components take no part; empty ones do, and
    score 0. Rows are never merged: ``row`` tells those with one key, or without a key, apart.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & (F.abs(e.cast("double")) < float("inf")) & ~F.isnan(e))
    values = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    kept = df.where(x.isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), values.alias("q"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones are filled up with zeros."""
    lists = batch.column("q")
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


@dataclass(frozen=True)
class Labels:
    """Number and id of the rows of a block; ``known`` is false where there is no id."""

    rows: np.ndarray
    ids: np.ndarray
    known: np.ndarray

    FIELDS = "rows binary, ids binary, known binary"

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Labels:
        ids = batch.column("id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return cls(batch.column("row").to_numpy(), ids.fill_null(0).to_numpy(), known)

    @classmethod
    def read(cls, row: dict) -> Labels:
        return cls(np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool))

    def packed(self) -> dict:
        return {"rows": self.rows.tobytes(), "ids": self.ids.tobytes(), "known": self.known.tobytes()}

    def at(self, places) -> Labels:
        return Labels(self.rows[places], self.ids[places], self.known[places])

    def names(self) -> list[int | None]:
        return [i if k else None for i, k in zip(self.ids.tolist(), self.known.tolist())]


def _blocks(size: int, pack):
    """mapInArrow body: ``pack(labels, cells)`` of up to ``size`` rows at a time, in order of id, no id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts):
            width = max(c.shape[1] for _, c in parts)
            cells = np.concatenate([np.pad(c, ((0, 0), (0, width - c.shape[1]))) for _, c in parts])
            labels = Labels(*[np.concatenate([getattr(p, n) for p, _ in parts]) for n in ("rows", "ids", "known")])
            order = np.lexsort((labels.rows, labels.ids, ~labels.known))
            labels = labels.at(order)
            return pa.RecordBatch.from_pylist([labels.packed() | pack(cells[order])])

        parts, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - held)
                parts.append((Labels.of(part), _matrix(part)))
                at, held = at + part.num_rows, held + part.num_rows
                if held == size:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return run


class Slices:
    """The bit slices of one block of rows."""

    def __init__(self, labels: Labels, low: list[int], size: list[int], planes: np.ndarray):
        self.labels, self.low, self.size = labels, low, size
        self.words = (len(labels.rows) + 63) // 64
        self.first = np.cumsum([0, *size]).tolist()
        self.flip = len(planes)
        self.planes = np.concatenate([planes, ~planes])
        self.all = _bitmap(np.ones(len(labels.rows), bool))

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of the scores of all rows, and the constant to add to each score."""
        places: list[list[int]] = []
        constant = 0
        for weight, low, first, size in zip(query.tolist(), self.low, self.first, self.size):
            constant += weight * low
            place = 0
            while weight:  # digits -1, 0, 1 with no two neighbours set
                if weight & 1:
                    digit = 2 - (weight & 3)
                    weight -= digit
                    if digit < 0:  # minus a slice sum is its complement less a constant
                        constant -= ((1 << size) - 1) << place
                    while len(places) < place + size:
                        places.append([])
                    begin = first if digit > 0 else first + self.flip
                    for b in range(size):
                        places[place + b].append(begin + b)
                weight >>= 1
                place += 1
        out, carried, at = [], [], 0
        while at < len(places) or carried:
            column = np.concatenate([self.planes[places[at] if at < len(places) else []], *carried])
            carried = []
            while len(column) > 2:  # a full adder for every three bitmaps of this place at once
                third = len(column) // 3
                a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                half = a ^ b
                total = half ^ c
                half &= c
                half |= a & b
                carried.append(half)
                column = np.concatenate([total, column[3 * third :]])
            if len(column) == 2:
                carried.append(column[:1] & column[1:])
                column = column[:1] ^ column[1:]
            out.append(column[0] if len(column) else np.zeros(self.words, np.uint64))
            at += 1
        return out, constant

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[list[int | None], list[int]]:
        """Ids and scores of the k best rows other than row ``own``, ties to smaller ids, no id last."""
        slices, constant = self.scores(query)
        tied = self.all.copy()
        for at in np.flatnonzero(self.labels.rows == own).tolist():
            tied[at >> 6] &= ~(np.uint64(1) << np.uint64(at & 63))
        sure = np.zeros(self.words, np.uint64)
        count = 0
        for plane in reversed(slices):
            upper = tied & plane
            more = int(np.bitwise_count(upper).sum())
            if count + more > k:
                tied = upper
            else:
                sure |= upper
                count += more
                tied &= ~plane
                if count == k:
                    break
        rows = self.rows(sure)
        if count < k:  # all of ``tied`` have one score
            rows = np.sort(np.concatenate([rows, self.rows(tied)[: k - count]]))
        values = [constant] * len(rows)
        for b, plane in enumerate(slices):
            bits = plane[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)
            values = [v + (int(x) << b) for v, x in zip(values, bits)]
        return self.labels.at(rows).names(), values


def _bitmap(bits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits) + 63) // 64 * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def sliced(cells: np.ndarray) -> dict:
    """One index block: for each component its least value and the digits of what is above it."""
    low, size, planes = cells.min(0).tolist(), [], []
    for d, least in enumerate(low):
        above = cells[:, d].astype(np.uint64) - np.uint64(least & (1 << 64) - 1)
        size.append(int(above.max()).bit_length())
        planes += [_bitmap((above >> np.uint64(b) & np.uint64(1)).astype(bool)) for b in range(size[d])]
    return {"low": low, "size": size, "planes": b"".join(p.tobytes() for p in planes)}


def _index_block(row: dict) -> Slices:
    labels = Labels.read(row)
    planes = np.frombuffer(row["planes"], np.uint64).reshape(-1, (len(labels.rows) + 63) // 64)
    return Slices(labels, row["low"], row["size"], planes)


def _query_block(cells: np.ndarray) -> dict:
    return {"width": cells.shape[1], "cells": cells.tobytes()}


def _queries(row: dict) -> Iterator[tuple[int, int | None, np.ndarray]]:
    labels = Labels.read(row)
    cells = np.frombuffer(row["cells"], np.int64).reshape(len(labels.rows), row["width"])
    return zip(labels.rows.tolist(), labels.names(), cells)


def search(vectors: DataFrame, is_query: Column, k: int = 20, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of each row that ``is_query`` selects.

    ``vectors`` (row, id, q) is what ``quantised`` gives; ``is_query`` is a condition on ``id``.
    Every row but the query's own is a candidate, also one with the query's id or without an id;
    each row of a repeated id that ``is_query`` selects asks, and has its ranks. Scores are integer
    inner products, missing components count as zero; ties go to the smaller id, rows without
    one come last. A score beyond 64 bits is given as the nearest such number. Fewer than ``k``
    other rows: all of them. An empty table gives no rows.
    """
    spark = ready(vectors.sparkSession)
    held = written(vectors, "vectors")
    total = held.count()
    kept = held.coalesce(max(1, -(-total // rows)))
    number = F.monotonically_increasing_id()
    index = kept.mapInArrow(_blocks(rows, sliced), f"{Labels.FIELDS}, low array<bigint>, size array<bigint>, planes binary")
    index = written(index.withColumn("block", number), "index")
    asked = kept.where(is_query).mapInArrow(_blocks(queries, _query_block), f"{Labels.FIELDS}, width bigint, cells binary")
    asked = written(asked.withColumn("part", number), "queries")
    # each index block meets each query block once: the numbers of the blocks are two short lists
    numbers = [r["part"] for r in asked.select("part").collect()]
    if not numbers:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    blocks = [r["block"] for r in index.select("block").collect()]
    left = index.withColumn("part", F.explode(F.array(*[F.lit(n).cast("bigint") for n in numbers])))
    right = asked.withColumn("block", F.explode(F.array(*[F.lit(n).cast("bigint") for n in blocks])))

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        columns = ([], [], [], [])
        if a.num_rows and b.num_rows:
            slices = _index_block(a.to_pylist()[0])
            limit = 1 << 63
            for own, name, query in _queries(b.to_pylist()[0]):
                ids, values = slices.top(query, own, k)
                columns[0].extend([own] * len(ids))
                columns[1].extend([name] * len(ids))
                columns[2].extend(ids)
                columns[3].extend(max(-limit, min(limit - 1, v)) for v in values)
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["own", "query_id", "vec_id", "score"])

    best = (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInArrow(pair, "own bigint, query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("own").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
