"""Nearest places by boxes against scoring everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import boxes, places
from lectern.operators.pivots import metres


def spots(seed=3):
    rng = np.random.default_rng(seed)
    points = np.stack([rng.uniform(-90, 90, 700), rng.uniform(-180, 180, 700)], 1).round(1)
    points[::7] = points[0]  # a hundred at one place
    points[1] = 89.9, -179.9
    return points


def frame(spark, points, name):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, f"{name} bigint, lat double, lng double").repartition(3)


@pytest.mark.parametrize("group_blocks", [1024, 3])
def test_equals_scoring_all(spark, monkeypatch, group_blocks):
    monkeypatch.setattr(boxes, "GROUP_BLOCKS", group_blocks)
    points, asked = spots(), spots(4)[:90]
    got = places.nearest(frame(spark, asked, "centre_id"), frame(spark, points, "pos"), 5, block_bytes=16 * 16)
    far = np.round(metres(asked[:, None], points[None]), 6)
    want = [(c, int(p), r + 1) for c in range(len(asked)) for r, p in enumerate(np.lexsort((np.arange(len(points)), far[c]))[:5])]
    assert sorted((r["centre_id"], r["pos"], r["rank"]) for r in got.collect()) == sorted(want)


def test_few_blocks_meet(spark):
    """Places that fit a single block of 16 MB are cut small, and more than half the pairs of blocks are out of reach."""
    rng = np.random.default_rng(1)
    points = np.stack([rng.uniform(-60, 60, 9000), rng.uniform(-180, 180, 9000)], 1)
    rows = frame(spark, points, "id")
    store, asked = boxes._packed(rows, 128, "s"), boxes._packed(rows, 512, "q")
    pairs = boxes._best_scores(asked, store)
    assert store.count() > 60
    assert pairs.where(F.col("best") > -1_000_000).count() < pairs.count() / 2


def test_numbers_that_are_no_position(spark):
    shops = spark.createDataFrame([(1, 1.0, 1.0), (2, float("nan"), 1.0), (3, float("inf"), 1.0), (4, None, 1.0)], "pos bigint, lat double, lng double")
    centres = shops.select(F.col("pos").alias("centre_id"), "lat", "lng")
    assert [(r.centre_id, r.pos, r.distance, r["rank"]) for r in places.nearest(centres, shops, 3).collect()] == [(1, 1, 0.0, 1)]
    assert places.nearest(centres, shops.limit(0), 3).count() == 0
    assert places.nearest(centres.limit(0), shops, 3).count() == 0
