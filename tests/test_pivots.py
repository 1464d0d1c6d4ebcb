"""Nearest rows by pivots against scoring everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import pivots, places, vector_search
from lectern.operators.pivots import COSINE


def points(kind, n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.normal(size=(8, dim))
        v = centres[rng.integers(0, 8, n)] + 0.05 * rng.normal(size=(n, dim))
    elif kind == "copies":  # a third of all rows are the same
        v = rng.normal(size=(n, dim))
        v[:: 3] = v[0]
    else:
        v = rng.normal(size=(n, dim))
    v[5] = 0
    v[11] = -v[12]
    v[13] = 3 * v[14]
    return v


def brute(v, asked, k):
    norms = np.linalg.norm(v, axis=1)
    out = []
    for q in asked:
        bottom = norms * norms[q]
        s = np.round((v @ v[q]) / np.where(bottom == 0, 1, bottom), 10) + 0.0
        out += [(q, i, r + 1) for r, i in enumerate(sorted(range(len(v)), key=lambda i: (-s[i], i))[:k])]
    return sorted(out)


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "pos bigint, v array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["clusters", "copies", "spread"])
@pytest.mark.parametrize("sizes", [{}, {"pivots": 7, "store_bytes": 900, "query_bytes": 200, "query_blocks": 2}])
def test_equals_scoring_all(spark, kind, sizes):
    v = points(kind, 400)
    store = frame(spark, v)
    asked = store.filter("pos % 20 = 0 or pos in (5, 11, 13)").select(F.col("pos").alias("query_id"), "v")
    rows = pivots.nearest(asked, store, 7, **sizes).collect()
    ids = [i for i in range(400) if i % 20 == 0 or i in (5, 11, 13)]
    assert sorted((r["query_id"], r["pos"], r["rank"]) for r in rows) == brute(v, ids, 7)


def test_best_scores_hold_and_leave_blocks_out(spark):
    v = points("clusters", 600)
    store = frame(spark, v)
    ids = store.select(F.col("pos").alias("id"), "v")
    chosen = pivots.choose_pivots(ids, 16)
    blocks = pivots._packed(ids, COSINE, chosen, 20 * 8 * 6, "t", True)
    asked = pivots._packed(ids.where("id % 20 = 0"), COSINE, chosen, 4 * 8 * 6, "q", False)
    members = {r["block"]: r["ids"] for r in blocks.collect()}
    askers = {r["block"]: r["ids"] for r in asked.collect()}
    assert sorted(i for m in members.values() for i in m) == list(range(600)) and max(map(len, members.values())) <= 20
    tight = 0
    for r in pivots._best_scores(asked, blocks, COSINE, chosen).collect():
        real = COSINE.score(v[askers[r["query_block"]]], v[members[r["block"]]]).max()
        assert real <= r["best"] + 1e-9
        tight += r["best"] < 0.9
    assert tight > len(members)  # far clusters are known to be far


def test_no_vector_goes_to_the_driver(spark, monkeypatch):
    v = points("spread", 300)
    store = frame(spark, v)
    asked = store.filter("pos % 20 = 0").select(F.col("pos").alias("query_id"), "v")
    collected = []
    plain = type(store).collect
    monkeypatch.setattr(type(store), "collect", lambda df: collected.append(rows := plain(df)) or rows)
    pivots.nearest(asked, store, 3, pivots=8)
    assert all(len(rows) <= 8 for rows in collected)


def test_few_or_no_rows(spark):
    v = points("spread", 20)
    store = frame(spark, v)
    asked = store.select(F.col("pos").alias("query_id"), "v")
    assert pivots.nearest(asked.limit(0), store, 3).count() == 0
    assert pivots.nearest(asked, store.limit(0), 3).count() == 0
    assert pivots.nearest(asked, store, 50).count() == 400
    with pytest.raises(Exception, match="dimensions"):
        pivots.nearest(asked.withColumn("v", F.slice("v", 1, 2)), store, 3).collect()


def test_scale_zero_is_a_zero_vector(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 0.0])], "pos bigint, v array<double>")
    quantized = vector_search.quantize_store(rows.withColumn("ref", F.col("pos").cast("string")))
    asked = rows.filter("pos = 0").select(F.col("pos").alias("query_id"), "v")
    got = [(r["pos"], r["score"]) for r in vector_search.nearest_pruned(asked, quantized, 3).orderBy("rank").collect()]
    assert got == [(0, 1.0), (1, 0.0), (2, -1.0)]


def test_places_across_the_date_line_and_the_poles(spark):
    rng = np.random.default_rng(5)
    spots = [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for _ in range(150)]
    spots += [(89.9, 0.0), (89.9, 180.0), (0.0, 179.99), (0.0, -179.99), (10.0, 10.0), (10.0, 10.0), (-90.0, 5.0)]
    spots += [(48.0 + i * 1e-6, 11.0) for i in range(200)]  # a dense cell

    def metres(a, b):
        (p, q), (r, s) = (tuple(map(math.radians, x)) for x in (a, b))
        x = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    shops = spark.createDataFrame([(i, *x) for i, x in enumerate(spots)] + [(999, None, 1.0)], "pos bigint, lat double, lng double")
    centres = shops.where("pos % 3 = 0").select(F.col("pos").alias("centre_id"), "lat", "lng")
    for block_bytes in (16 << 20, 500):
        got = sorted((r["centre_id"], r["pos"], r["rank"]) for r in places.nearest(centres, shops, 4, block_bytes).collect())
        want = []
        for c in range(0, len(spots), 3):
            best = sorted(range(len(spots)), key=lambda i: (round(metres(spots[c], spots[i]), 6), i))[:4]
            want += [(c, i, r + 1) for r, i in enumerate(best)]
        assert got == sorted(want)
