"""Vector codes against a plain reckoning in Python integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import common, walsh_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, key int, code int, _side int"


def rows_of(spark, vectors, labels=None):
    rows = [(i, v, labels[n] if labels else 0, "q", 1, 2, 3) for n, (i, v) in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [
        (i, [max(-(1 << 63), min((1 << 63) - 1, math.floor(4096 * float(np.float32(x))))) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    length = -(-max(len(v) for _, v, _ in kept) // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[(v + [0] * (parts * length - len(v)))[p * length : (p + 1) * length] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for c in cut:
                got[near(p, c[p])[1]].append(c[p])
            for k, xs in got.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], defaultdict(int)
    for (i, _, label), c in zip(kept, cut):
        best = [near(p, c[p]) for p in range(parts)]
        error = sum(d for d, _ in best)
        totals[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    whole = lambda x: x if x < 1 << 63 else None
    return [(i, code, whole(e), whole(totals[label]), digest) for i, code, e, label in out]


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=repr)


def test_transform_and_distances():
    rng = np.random.default_rng(1)
    for size in (1, 2, 4, 8, 32):
        rows = rng.integers(-9, 9, (5, size))
        out = walsh_codes.walsh(rows)
        unit = walsh_codes.walsh(np.eye(size, dtype=np.int64)).T
        assert (np.diff([(np.diff(r) != 0).sum() for r in unit]) == 1).all() or size == 1  # sequency 0, 1, 2, …
        assert ((out**2).sum(1) == size * (rows**2).sum(1)).all()
    points, entries = rng.integers(-3, 3, (400, 4)), rng.integers(-3, 3, (9, 4))
    index, apart = walsh_codes.nearest(points, entries)
    want = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (index == want.argmin(1)).all() and (apart == want.min(1)).all()


@pytest.mark.parametrize("width", [3, 24, 64])
def test_equals_plain_reckoning(spark, width):
    rng = random.Random(width)
    vectors = [(i, [rng.choice([rng.gauss(0, 1), 0.25, -0.25]) for _ in range(width)]) for i in range(150)]
    vectors += [(7, list(vectors[9][1])), vectors[3], vectors[3], (None, vectors[5][1]), (200, None), (201, [None] * width)]
    vectors += [(202, [math.nan] * width), (203, [math.inf] + [0.0] * (width - 1)), (204, []), (205, [1.5])]
    labels = [rng.choice([None, 0, 1, 2]) for _ in vectors]
    want = brute([(i, v, label) for (i, v), label in zip(vectors, labels)])
    assert got(walsh_codes.compress(rows_of(spark, vectors, labels))) == sorted(want, key=repr)


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([3e38, -3e38, 1e9, 2e15, 0.5, 40000.0]) for _ in range(16)]) for i in range(40)]
    vectors += [(100 + i, [rng.random() for _ in range(16)]) for i in range(10)]
    labels = [0] * 40 + [1] * 10
    want = brute([(i, v, label) for (i, v), label in zip(vectors, labels)])
    assert got(walsh_codes.compress(rows_of(spark, vectors, labels))) == sorted(want, key=repr)


def test_few_equal_or_no_vectors(spark):
    few = [(2, [1.0] * 8), (1, [1.0] * 8), (1, [2.0] * 8)]
    assert got(walsh_codes.compress(rows_of(spark, few))) == sorted(brute([(i, v, 0) for i, v in few]), key=repr)
    assert got(walsh_codes.compress(rows_of(spark, few).limit(0))) == []
    assert got(walsh_codes.compress(rows_of(spark, [(1, None)]))) == []


def test_attach_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    rows = spark.createDataFrame([(i, None if i % 3 else i % 4) for i in range(200)], "id int, label int")
    side = spark.createDataFrame([(None, 10), (0, 11), (1, 12), (2, 13), (3, 14)], "label int, v int")
    met = common.attach(rows, side, "label", "id").collect()
    assert sorted((r["id"], r["v"]) for r in met) == [(i, 10 if i % 3 else 11 + i % 4) for i in range(200)]
