"""Exact nearest rows by pivots and triangle bounds.

Rows and queries are points on a sphere. Each goes to the nearest of a few pivots; by (pivot,
angle) they are sorted and packed into block rows of bounded bytes with the least and greatest
angle inside. The angle between two points of two blocks is at least what the triangle
inequality says from the angle between the pivots, so a pair of blocks has a best score. Every query
block first meets the blocks of best score that hold k rows; the k-th scores found are its floor,
and of all other blocks it meets those whose best score reaches the floor.

Blocks meet by a co-group on their numbers: a store block, and a bounded number of the query
blocks that need it. Nothing but the pivots (a sample of PIVOTS rows) and counts goes to the
driver. Where nothing can be left out, this is a nested loop over blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern import fixed
from lectern.operators.topk import SCORE_CELLS, _Best
from lectern.session import written

#: Rows of the sample that become pivots; bytes of a store block and of a query block; query blocks in a task.
PIVOTS, STORE_BYTES, QUERY_BYTES, QUERY_BLOCKS = 64, 16 << 20, 2 << 20, 16
#: Block summaries that may be broadcast to the query blocks.
SUMMARY_ROWS = 500_000
#: Radians by which calculated angles may be off.
SLACK = 1e-6


@dataclass(frozen=True)
class Space:
    """Points given by arrays of numbers: their unit vectors, scores, and the best score at an angle."""

    unit: Callable[[np.ndarray], np.ndarray]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    best: Callable[[Column], Column]
    digits: int


def _normed(v: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return v / np.where(length == 0, 1.0, length)


#: Cosines of vectors; of a zero vector they are 0.
COSINE = Space(_normed, lambda q, x: _normed(q) @ _normed(x).T, F.cos, 10)


def _on_earth(v: np.ndarray) -> np.ndarray:
    lat, lng = np.radians(v[:, 0]), np.radians(v[:, 1])
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], 1)


def metres(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Metres between (latitude, longitude) in degrees, the last axis; the others go together."""
    (lat1, lng1), (lat2, lng2) = np.moveaxis(np.radians(q), -1, 0), np.moveaxis(np.radians(x), -1, 0)
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lng2 - lng1) / 2) ** 2
    return 2 * fixed.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


#: Negative metres of great circles between (latitude, longitude) in degrees.
EARTH = Space(_on_earth, lambda q, x: -metres(q[:, None], x[None]), lambda angle: -fixed.EARTH_RADIUS_M * angle, 6)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    if lists.null_count or not (pc.list_value_length(lists).to_numpy() == width).all():
        raise ValueError(f"vectors must all have {width} dimensions")
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), width)


def choose_pivots(rows: DataFrame, count: int = PIVOTS, n: int | None = None) -> np.ndarray | None:
    """Vectors of ``count`` rows at most, by a hash of ``id``; None without rows."""
    n = rows.count() if n is None else n
    thin = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // (16 * count)))) == 0)
    for sample in (thin, rows):
        chosen = sample.orderBy(F.xxhash64("id"), "id").limit(count).collect()
        if chosen:
            return np.array([r["v"] for r in chosen], np.float64)
    return None


def _packed(rows: DataFrame, space: Space, pivots: np.ndarray, block_bytes: int, name: str, dealt: bool) -> DataFrame:
    """Block rows (block, pivot, lo, hi, n, ids, points) of rows (id, v); points without a direction have pivot -1.

    Rows are dealt by pivot and angle over all tasks, or only sorted where they lie.
    """
    kind = rows.schema["id"].dataType
    units, width = space.unit(pivots), pivots.shape[1]
    most = max(1, block_bytes // (8 * width))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1 << 16):
                part = batch.slice(start, 1 << 16)
                unit = space.unit(_matrix(part.column("v"), width))
                near = unit @ units.T
                pivot = near.argmax(1) if len(near) else np.zeros(0, np.int64)
                angle = np.arccos(np.clip(near.max(1, initial=-1.0), -1, 1))
                lost = ~unit.any(1)
                pivot, angle = np.where(lost, -1, pivot), np.where(lost, 0.0, angle)
                columns = [*part.columns, pa.array(pivot, pa.int32()), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "pivot", "angle"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows_held = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            points, ids = table.column("v").chunk(0), table.column("id").chunk(0)
            angle = table.column("angle").to_numpy()
            whole = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([table.column("pivot")[0].as_py()], pa.int32()),
                    pa.array([angle.min()]),
                    pa.array([angle.max()]),
                    pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(whole, ids),
                    pa.ListArray.from_arrays(pa.array([0, len(points.flatten())], pa.int32()), points.flatten().cast(pa.float64())),
                ],
                ["block", "pivot", "lo", "hi", "n", "ids", "points"],
            )

        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            for start, end in zip(cuts := np.r_[0, np.flatnonzero(np.diff(pivot)) + 1], [*cuts[1:], len(pivot)]):
                part = batch.slice(start, end - start)
                while part.num_rows:
                    if held and (rows_held == most or held[-1].column("pivot")[0] != part.column("pivot")[0]):
                        yield block()
                        number, held, rows_held = number + 1, [], 0
                    held.append(part.slice(0, most - rows_held))
                    part = part.slice(held[-1].num_rows)
                    rows_held += held[-1].num_rows
        if held:
            yield block()

    near = rows.select("id", "v").mapInArrow(placed, f"id {kind.simpleString()}, v array<double>, pivot int, angle double")
    if dealt:  # range partitioning reads its input twice, so the placed rows are written first
        near = written(near, f"{name}-placed").repartitionByRange("pivot", "angle", "id")
    near = near.sortWithinPartitions("pivot", "angle", "id")
    schema = f"block bigint, pivot int, lo double, hi double, n bigint, ids array<{kind.simpleString()}>, points array<double>"
    return written(near.mapInArrow(packed, schema), name)


def _best_scores(asked: DataFrame, store: DataFrame, space: Space, pivots: np.ndarray) -> DataFrame:
    """``(query_block, block, n, best)`` of all pairs of blocks."""
    units = space.unit(pivots)
    between = np.arccos(np.clip(units @ units.T, -1, 1))
    rows = [(i, j, float(between[i, j])) for i in range(len(units)) for j in range(len(units))]
    # a point without a direction scores 0 with all: it counts as a right angle away
    rows += [(i, j, np.pi / 2) for i in range(-1, len(units)) for j in range(-1, len(units)) if min(i, j) < 0]
    apart = asked.sparkSession.createDataFrame(rows, "query_pivot int, pivot int, apart double")  # (PIVOTS + 1)^2 rows
    ours = asked.select(F.col("block").alias("query_block"), F.col("pivot").alias("query_pivot"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    theirs = store.select("block", "pivot", "lo", "hi", "n")
    if theirs.count() <= SUMMARY_ROWS:
        theirs = F.broadcast(theirs)
    least = F.greatest(
        F.lit(0.0),
        F.col("apart") - F.col("q_hi") - F.col("hi"),
        F.col("lo") - F.col("apart") - F.col("q_hi"),
        F.col("q_lo") - F.col("apart") - F.col("hi"),
    )
    angle = F.greatest(F.lit(0.0), F.least(least, F.lit(np.pi)) - SLACK)
    return ours.join(F.broadcast(apart), "query_pivot").join(theirs, "pivot").select("query_block", "block", "n", space.best(angle).alias("best"))


def _scored(pairs: DataFrame, asked: DataFrame, store: DataFrame, space: Space, k: int, groups: int, width: int) -> DataFrame:
    """The k best rows of each query in each store block that its block is paired with.

    Where ``asked`` holds the queries' floors, rows below them are left out.
    """
    kind = asked.schema["ids"].dataType.elementType
    arrow = to_arrow_type(kind)

    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for b in range(blocks.num_rows):
            pos = np.asarray(blocks.column("ids")[b].values)
            points = np.asarray(blocks.column("points")[b].values).reshape(-1, width)
            for q in range(queries.num_rows):
                ids = queries.column("ids")[q].values
                centre = np.asarray(queries.column("points")[q].values).reshape(-1, width)
                best, step = _Best(len(ids), k, space.digits), max(1, SCORE_CELLS // len(ids))
                if "floors" in queries.column_names:
                    best.floor = np.array(queries.column("floors")[q].values)
                for start in range(0, len(pos), step):
                    best.add(space.score(centre, points[start : start + step]), pos[start : start + step])
                out.append(best.rows(ids).drop_columns(["_key"]))
        names = pa.schema([("query_id", arrow), ("pos", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(out, names) if out else names.empty_table()

    group = F.pmod(F.xxhash64("query_block"), F.lit(groups)).cast("int").alias("group")
    wanted = pairs.select("block", "query_block", group)
    blocks = store.select("block", "ids", "points").join(wanted.select("block", "group").distinct(), "block")
    # new names, since both sides come from the same pairs
    to = wanted.select("query_block", F.col("block").alias("to_block"), F.col("group").alias("to_group"))
    kept = [c for c in ("ids", "points", "floors") if c in asked.columns]
    queries = asked.select(F.col("block").alias("query_block"), *kept).join(to, "query_block").drop("query_block")
    return (
        blocks.groupBy("block", "group")
        .cogroup(queries.groupBy("to_block", "to_group"))
        .applyInArrow(run, f"query_id {kind.simpleString()}, pos bigint, score double")
    )


def _ranked(hits: DataFrame, k: int, digits: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", digits)), "pos")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    k: int,
    space: Space = COSINE,
    pivots: int = PIVOTS,
    store_bytes: int = STORE_BYTES,
    query_bytes: int = QUERY_BYTES,
    query_blocks: int = QUERY_BLOCKS,
) -> DataFrame:
    """``(query_id, pos, score, rank)``: the k best rows of each query, ties by ``pos``.

    ``queries`` (query_id, v), ``rows`` (pos bigint, v); v is array<double>, of one length. Scores
    that agree in the space's digits are ties; they are returned whole. Equal to scoring all.
    """
    spark = rows.sparkSession
    store_rows = rows.select(F.col("pos").alias("id"), "v")
    asked_rows = queries.select(F.col("query_id").alias("id"), "v")
    kind = queries.schema["query_id"].dataType.simpleString()
    n = store_rows.count()
    width = len(store_rows.first()["v"] or []) if n else 0
    if not width:
        return spark.createDataFrame([], f"query_id {kind}, pos bigint, score double, rank int")
    # as many pivots as the rows fill blocks; with a single block there is nothing to leave out
    count = min(pivots, -(-n * 8 * width // store_bytes))
    chosen = choose_pivots(store_rows, count, n)
    store = _packed(store_rows if count > 1 else store_rows.coalesce(1), space, chosen, store_bytes, "pivots-store", count > 1)
    asked = _packed(asked_rows, space, chosen, query_bytes, "pivots-queries", False)
    groups = 1 + asked.count() // query_blocks
    pairs = _best_scores(asked, store, space, chosen)
    if count == 1:
        return _ranked(_scored(pairs.select("query_block", "block"), asked, store, space, k, groups, width), k, space.digits)
    pairs = written(pairs, "pivots-pairs")
    by_best = Window.partitionBy("query_block").orderBy(F.desc("best"), "block")
    before = F.sum("n").over(by_best.rowsBetween(Window.unboundedPreceding, -1))
    first = pairs.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < k).select("query_block", "block")
    seen = written(_scored(first, asked, store, space, k, groups, width), "pivots-seeds")
    kth = _ranked(seen, k, space.digits).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    # floors by query and, as the least of them, by block; a query with fewer than k rows so far has none
    floor = F.coalesce(F.round("kth", space.digits), F.lit(float("-inf")))
    members = asked.select(F.col("block").alias("query_block"), F.posexplode("ids").alias("at", "query_id"))
    floors = members.join(kth, "query_id", "left").groupBy("query_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", floor.alias("floor")))), lambda x: x["floor"]).alias("floors")
    )
    floors = written(floors, "pivots-floors")
    rest = pairs.join(first, ["query_block", "block"], "left_anti").join(floors, "query_block")
    rest = rest.where(F.col("best") + 10.0**-space.digits >= F.array_min("floors"))
    asked = asked.join(floors.withColumnRenamed("query_block", "block"), "block")
    hits = seen.unionByName(_scored(rest.select("query_block", "block"), asked, store, space, k, groups, width))
    return _ranked(hits, k, space.digits)
