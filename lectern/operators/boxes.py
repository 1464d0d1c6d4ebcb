"""Exact nearest places by bounding boxes (K4).

Places and centres lie on a curve that visits the cells of a latitude/longitude grid one quarter
after the other, so neighbours on the curve are mostly neighbours on the ground. Along the curve
they are packed into blocks of few rows, each with the box around its unit vectors. The distance of
two boxes bounds that of their points. A block of centres first meets the nearest blocks that hold k
places; the k-th distances found are its floors, and of all other blocks it meets those whose box
is within reach. However many places there are, a centre is compared with a few blocks.

Boxes are made of the points inside: a block that spans a jump of the curve, the date line or a pole
has a large box and leaves less out, but nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern import fixed
from lectern.operators.pivots import EARTH, SUMMARY_ROWS, _ranked, metres
from lectern.operators.topk import SCORE_CELLS
from lectern.session import written

#: Bytes of the places of a block (16 each); the centres of a block take four times as much.
BLOCK_BYTES = 8 << 10
#: Store blocks that a block of centres meets at a time.
GROUP_BLOCKS = 1024
#: Blocks of centres in a task.
TASK_BLOCKS = 16
#: By how much calculated chords may be off.
SLACK = 1e-9
#: The same for cosines; wide enough for the micrometre that makes a tie.
COSINE_SLACK = 1e-12
_SIDES = [f"{side}{axis}" for axis in "xyz" for side in ("lo_", "hi_")]


def _spread_bits(v: np.ndarray) -> np.ndarray:
    """16 bits with a zero between any two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = (v | v << shift) & mask
    return v


def _curve(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Place on the curve of the cell of 2^16 x 2^16 that holds a point."""
    top = (1 << 16) - 1
    row = np.clip((lat + 90) / 180 * top, 0, top).astype(np.int64)
    column = np.clip((lng + 180) % 360 / 360 * top, 0, top).astype(np.int64)
    return _spread_bits(row) << 1 | _spread_bits(column)


def _packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Block rows (block, n, six sides of the box, ids, points) of rows (id, lat, lng), ``most`` to a block."""
    kind = rows.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _curve(batch.column("lat").to_numpy(), batch.column("lng").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        points = np.stack([table.column(c).to_numpy() for c in ("lat", "lng")], 1)
        unit, ids = EARTH.unit(points), table.column("id").chunk(0)
        sides = [pa.array([side[axis]]) for axis in range(3) for side in (unit.min(0), unit.max(0))]
        whole, flat = pa.array([0, len(ids)], pa.int32()), pa.array([0, 2 * len(ids)], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(flat, pa.array(points.ravel()))]
        counts = [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64())]
        return pa.RecordBatch.from_arrays([*counts, *sides, *lists], ["block", "n", *_SIDES, "ids", "points"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - size))
                batch = batch.slice(held[-1].num_rows)
                size += held[-1].num_rows
                if size == most:
                    yield block(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(held, number)

    # range partitioning reads its input twice, so the placed rows are written first
    on_curve = written(rows.mapInArrow(placed, f"id {kind}, lat double, lng double, cell bigint"), f"{name}-placed")
    dealt = on_curve.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    sides = ", ".join(f"{s} double" for s in _SIDES)
    return written(dealt.mapInArrow(packed, f"block bigint, n bigint, {sides}, ids array<{kind}>, points array<double>"), name)


def _best_scores(asked: DataFrame, store: DataFrame) -> DataFrame:
    """``(query_block, block, n, best)`` of all pairs of blocks; ``best`` is what no pair of their points exceeds."""
    ours = asked.select(F.col("block").alias("query_block"), *[F.col(s).alias(f"q_{s}") for s in _SIDES])
    theirs = store.select("block", "n", *_SIDES)
    if theirs.count() <= SUMMARY_ROWS:
        theirs = F.broadcast(theirs)
    square = F.lit(0.0)
    for axis in "xyz":
        apart = F.greatest(F.lit(0.0), F.col(f"lo_{axis}") - F.col(f"q_hi_{axis}"), F.col(f"q_lo_{axis}") - F.col(f"hi_{axis}"))
        square = square + apart * apart
    chord = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.sqrt(square) - SLACK))
    best = EARTH.best(2 * F.asin(chord / 2))
    return ours.crossJoin(theirs).select("query_block", "block", "n", best.alias("best"))


def _near(centres: np.ndarray, places: np.ndarray, floor: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (centre, place) by number that can be among the k nearest or reach the floor, by cosine alone."""
    cosine = EARTH.unit(centres) @ EARTH.unit(places).T
    least = np.full(len(centres), -2.0)
    if floor is not None:
        least = np.cos(np.clip(-floor / fixed.EARTH_RADIUS_M, 0, np.pi)) - COSINE_SLACK
    # where more than k are left, the k-th cosine tells; the rest is not worth a distance
    many = np.flatnonzero((cosine >= least[:, None]).sum(1) > k)
    cut = len(places) - k
    if len(many):
        least[many] = np.maximum(least[many], np.partition(cosine[many], cut, axis=1)[:, cut] - COSINE_SLACK)
    return np.nonzero(cosine >= least[:, None])


def _best(centres: np.ndarray, floor: np.ndarray | None, pos: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(centre, place, score, rank from 0) of the k nearest places of each centre that reach its floor."""
    step, found = max(1, SCORE_CELLS // len(centres)), []
    for start in range(0, len(pos), step):
        query, row = _near(centres, places[start : start + step], floor, k)
        found.append((query, row + start))
    query, row = (np.concatenate(x) for x in zip(*found))
    score = -metres(centres[query], places[row])
    key = np.round(score, EARTH.digits)
    # what is no number goes last and is left out
    order = np.lexsort((pos[row], -key, query))
    query, row, score, key = (x[order] for x in (query, row, score, key))
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = (place < k) & ~np.isnan(key)
    if floor is not None:
        kept &= key >= floor[query]
    return query[kept], row[kept], score[kept], place[kept]


def _points(blocks: pa.Table) -> np.ndarray:
    return np.concatenate([np.asarray(p.values) for p in blocks.column("points")]).reshape(-1, 2)


def _meetings(needs: DataFrame, asked: DataFrame, store: DataFrame):
    """Each block of centres with the store blocks it needs, GROUP_BLOCKS at a time."""
    by_best = Window.partitionBy("query_block").orderBy(F.desc("best"), "block")
    part = F.floor((F.row_number().over(by_best) - 1) / GROUP_BLOCKS)
    needs = needs.select("query_block", "block", part.alias("part"))
    centres = asked.withColumnRenamed("block", "query_block").join(needs.select("query_block", "part").distinct(), "query_block")
    # new names, since both sides come from the same pairs
    to = needs.select("block", F.col("query_block").alias("to_block"), F.col("part").alias("to_part"))
    blocks = store.select("block", "ids", "points").join(to, "block")
    # blocks are few bytes and much work, so the number of tasks goes by their count
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, asked.count() // TASK_BLOCKS)
    centres, blocks = centres.repartition(tasks, "query_block", "part"), blocks.repartition(tasks, "to_block", "to_part")
    return centres.groupBy("query_block", "part").cogroup(blocks.groupBy("to_block", "to_part"))


def _floors(first: DataFrame, asked: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """``(query_block, floors)``: rounded scores of each centre's k-th place in the blocks it meets first."""

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for q in range(queries.num_rows):
            centres = _points(queries.slice(q, 1))
            pos = np.concatenate([np.asarray(p.values) for p in blocks.column("ids")])
            query, _, score, place = _best(centres, None, pos, _points(blocks), k)
            floor = np.full(len(centres), -np.inf)
            floor[query[place == k - 1]] = np.round(score[place == k - 1], EARTH.digits)
            out.append((queries.column("query_block")[q].as_py(), floor))
        return pa.table({"query_block": pa.array([b for b, _ in out], pa.int64()), "floors": pa.array([f for _, f in out], pa.list_(pa.float64()))})

    parts = _meetings(first, asked.select("block", "points"), store).applyInArrow(run, "query_block bigint, floors array<double>")
    # a block of centres that meets many has floors from each part; the best of them holds
    best = F.reduce(F.collect_list("floors"), F.lit(None).cast("array<double>"), lambda a, b: F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: F.greatest(x, y))))
    return parts.groupBy("query_block").agg(best.alias("floors"))


def _found(needs: DataFrame, asked: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """``(query_id, pos, score)`` of the k nearest rows of each query in the blocks it needs, none below its floor."""
    kind = asked.schema["ids"].dataType.elementType
    names = pa.schema([("query_id", to_arrow_type(kind)), ("pos", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [names.empty_table()]
        for q in range(queries.num_rows):
            pos = np.concatenate([np.asarray(p.values) for p in blocks.column("ids")])
            floor = np.array(queries.column("floors")[q].values)
            query, row, score, _ = _best(_points(queries.slice(q, 1)), floor, pos, _points(blocks), k)
            ids = queries.column("ids")[q].values.take(pa.array(query))
            out.append(pa.Table.from_arrays([ids, pa.array(pos[row], pa.int64()), pa.array(score)], schema=names))
        return pa.concat_tables(out)

    return _meetings(needs, asked, store).applyInArrow(run, f"query_id {kind.simpleString()}, pos bigint, score double")


def nearest(queries: DataFrame, rows: DataFrame, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, pos, score, rank)``: the k nearest rows of each query, by negative metres, ties by ``pos``.

    ``queries`` (query_id, lat, lng), ``rows`` (pos bigint, lat, lng), in finite degrees. Scores that
    agree in a micrometre are ties. Equal to scoring all.
    """
    most = max(1, block_bytes // 16)
    store = _packed(rows.select(F.col("pos").alias("id"), "lat", "lng"), most, "boxes-store")
    asked = _packed(queries.select(F.col("query_id").alias("id"), "lat", "lng"), 4 * most, "boxes-queries")
    pairs = written(_best_scores(asked, store), "boxes-pairs")
    by_best = Window.partitionBy("query_block").orderBy(F.desc("best"), "block")
    before = F.sum("n").over(by_best.rowsBetween(Window.unboundedPreceding, -1))
    first = pairs.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < k)
    floors = written(_floors(first, asked, store, k), "boxes-floors")
    needs = pairs.join(floors.select("query_block", F.array_min("floors").alias("least")), "query_block")
    needs = needs.where(F.col("best") + 10.0**-EARTH.digits >= F.col("least"))
    asked = asked.select("block", "ids", "points").join(floors.withColumnRenamed("query_block", "block"), "block")
    return _ranked(_found(needs, asked, store, k), k, EARTH.digits)
