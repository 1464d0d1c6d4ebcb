"""Vector codes: eight parts of a vector, each replaced by the number of its nearest codebook entry.

Everything is integer arithmetic. Parts and entries are filled with zeros to a power of two and
taken through the integer Walsh-Hadamard transform, its rows ordered by sequency (sign changes).
By Parseval's identity the squared differences of the transforms add up to the padded length
times the squared Euclidean distance. They are added from the lowest sequency on; an entry whose
running sum is above the whole distance of the entry that led after the first term is out, since
sums only grow. What is left at the end decides, ties to the lower number.

Codebooks (entries x vector length numbers) are the only thing that goes to the driver, summed in
the tasks first. Components that could leave 64 bits are calculated in Python's integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import attach, ready, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that a kernel takes at a time.
ROWS = 2048


def padded(length: int) -> int:
    """The least power of two that is not below ``length`` (1 for an empty part)."""
    return 1 << max(0, length - 1).bit_length()


def sequency(size: int) -> np.ndarray:
    """Row numbers of the natural Hadamard matrix, fewest sign changes first."""
    bits = size.bit_length() - 1
    grey = [s ^ s >> 1 for s in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in grey])


def walsh(rows: np.ndarray) -> np.ndarray:
    """The transform of the last axis (a power of two long), in order of sequency."""
    size = rows.shape[-1]
    out, half = rows, 1
    while half < size:
        pairs = out.reshape(*rows.shape[:-1], size // (2 * half), 2, half)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack([a + b, a - b], axis=-2).reshape(rows.shape)
        half *= 2
    return out[..., sequency(size)]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry and scaled squared distance of each point; all transformed."""
    gap = points[:, None, 0] - entries[None, :, 0]
    sums = gap * gap
    leader = sums.argmin(1)
    bound = ((points - entries[leader]) ** 2).sum(1)
    row, entry = np.nonzero((sums <= bound[:, None]).astype(bool))
    held = sums[row, entry]
    for s in range(1, points.shape[1]):
        gap = points[row, s] - entries[entry, s]
        held = held + gap * gap
        alive = (held <= bound[row]).astype(bool)
        row, entry, held = row[alive], entry[alive], held[alive]
    # the leader is never out, so every point has a survivor; survivors stand by point, then entry
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(held, starts)
    hits = np.flatnonzero((held == np.repeat(least, np.diff(np.r_[starts, len(row)]))).astype(bool))
    firsts = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]
    return entry[firsts], least


class Codebooks:
    """``entries``: (parts, entries, part length) integers. Sent with the tasks; small."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def transformed(self, exact: bool) -> np.ndarray:
        parts, count, length = self.entries.shape
        out = np.zeros((parts, count, padded(length)), object if exact else np.int64)
        out[:, :, :length] = self.entries
        return walsh(out)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entry numbers and (n, parts) squared distances of (n, parts, length) integers."""
        n, count, length = parts.shape
        size = padded(length)
        top = max((abs(int(x)) for a in (parts, self.entries) if a.size for x in (a.max(), a.min())), default=0)
        exact = top * size >= isqrt((1 << 60) // (4 * size * count))
        points = np.zeros((n, count, size), object if exact else np.int64)
        points[:, :, :length] = parts
        points, entries = walsh(points), self.transformed(exact)
        found = [nearest(points[:, p], entries[p]) for p in range(count)]
        return np.stack([i for i, _ in found], 1), np.stack([d // size for _, d in found], 1)


def quantised(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE
) -> DataFrame:
    """``key``, ``label``, ``q`` (array<bigint>): floor(scale * x) of each component.

    Rows whose vector is null or holds a null, a NaN or an infinity are left out. Numbers beyond
    64 bits become the largest or smallest of 64 bits.
    """
    rows = df.select(df[key].alias("key"), df[label].alias("label"), df[vector].alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("v").isNotNull() & whole).select(
        "key", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q")
    )


def _matrix(lists: pa.Array, parts: int, length: int) -> np.ndarray:
    """(n, parts, length) integers; a vector shorter than that goes on with zeros."""
    sizes = pa.compute.list_value_length(lists).to_numpy()
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lists), parts * length), np.int64)
    out[np.arange(parts * length)[None, :] < sizes[:, None]] = flat
    return out.reshape(len(lists), parts, length)


def _chunks(batches: Iterator[pa.RecordBatch], parts: int, length: int):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            chunk = batch.slice(start, ROWS)
            yield chunk, _matrix(chunk.column("q"), parts, length)


def _sums(vectors: DataFrame, books: Codebooks) -> dict[int, tuple[list[int], int]]:
    """slot (part * entries + entry) -> sums by position, number of parts; one row a task and slot first."""
    parts, count, length = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * count, length), object)
        seen = np.zeros(parts * count, np.int64)
        for _, matrix in _chunks(batches, parts, length):
            index, _ = books.assign(matrix)
            slots = (index + np.arange(parts) * count).ravel()
            order = slots.argsort(kind="stable")
            used, starts, times = np.unique(slots[order], return_index=True, return_counts=True)
            flat = matrix.reshape(-1, length)[order]
            if len(flat) and np.abs(flat.astype(float)).max(initial=0) * len(flat) >= 2**62:
                flat = flat.astype(object)
            sums[used] += np.add.reduceat(flat, starts, axis=0)
            seen[used] += times
        used = np.flatnonzero(seen)
        places = np.tile(np.arange(length), len(used))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, length), pa.int32()),
                pa.array(places, pa.int32()),
                pa.array([Decimal(int(x)) for x in sums[used].ravel()], pa.decimal128(38, 0)),
                pa.array(np.repeat(seen[used], length), pa.int64()),
            ],
            ["slot", "place", "total", "n"],
        )

    rows = vectors.select("q").mapInArrow(run, "slot int, place int, total decimal(38,0), n bigint")
    found: dict[int, tuple[list[int], int]] = {}
    # at most parts * entries * length rows
    for r in rows.groupBy("slot", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        found.setdefault(r["slot"], ([0] * length, int(r["n"])))[0][r["place"]] = int(r["total"])
    return found


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of quantised vectors; None without vectors.

    Entries begin as the parts of the smallest keys (null keys last, equal keys by their vectors;
    fewer vectors make fewer entries). Each round assigns all parts and replaces an entry by the
    floor of its mean; an entry without parts stays. The common length is the longest one, filled
    up to a multiple of ``parts``; shorter vectors go on with zeros.
    """
    width = vectors.agg(F.max(F.size("q")).alias("w")).first()["w"]
    if width is None:
        return None
    length = -(-width // parts)
    first = vectors.select("key", "q").orderBy(F.col("key").asc_nulls_last(), "q").limit(entries).collect()
    books = np.zeros((parts, len(first), length), np.int64)
    for i, r in enumerate(first):
        books[:, i].flat[: len(r["q"])] = r["q"]
    for _ in range(rounds):
        now = Codebooks(books)
        books = books.copy()
        for slot, (sums, n) in _sums(vectors, now).items():
            books[slot // len(first), slot % len(first)] = [s // n for s in sums]
    return Codebooks(books)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``key``, ``label``, ``code`` (entry numbers by part, two hex digits each) and ``error`` of each vector.

    An error beyond 64 bits is null.
    """
    parts, _, length = books.entries.shape
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, matrix in _chunks(batches, parts, length):
            if not chunk.num_rows:
                continue
            index, apart = books.assign(matrix)
            codes = index.astype(np.uint8).tobytes().hex()
            errors = [int(e) for e in apart.sum(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("key"),
                    chunk.column("label"),
                    pa.array([codes[i : i + 2 * parts] for i in range(0, len(codes), 2 * parts)], pa.string()),
                    pa.array([e if e < 1 << 63 else None for e in errors], pa.int64()),
                ],
                ["key", "label", "code", "error"],
            )

    return vectors.select("key", "label", "q").mapInArrow(
        run, f"key {kinds['key']}, label {kinds['label']}, code string, error bigint"
    )


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """``key``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` for each usable row of ``df``.

    Rows without a usable vector are left out (see ``quantised``); an empty vector counts as
    zeros. Repeated keys and rows stay rows of their own and all count. ``label_error`` sums the
    errors of equal labels, null labels together; it is null if a sum leaves 64 bits. Equal
    distances go to the lower entry. An empty table gives no rows. Other columns are not read.
    """
    ready(df.sparkSession)
    vectors = written(quantised(df, key, vector, label), "codes-vectors")
    books = train(vectors, **options)
    coded = written(encode(vectors, books or Codebooks(np.zeros((PARTS, 1, 1), np.int64))), "codes")
    # an error beyond 64 bits leaves its label's sum unknown too
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("bigint")
    totals = coded.groupBy("label").agg(total.alias("label_error"))
    return attach(coded, totals, "label", "key").select(
        F.col("key").alias(key),
        "code",
        "error",
        "label_error",
        F.lit(books.digest() if books else None).alias("codebooks_sha256"),
    )


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in DuckDB: each round assigns every part to the nearest entry and takes floored means."""
    steps = [
        f"""v as (
            select row_number() over (order by vec_id) as r, vec_id, label,
                list_transform(embedding, lambda x: cast(floor({SCALE} * x::double) as bigint)) as q
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        w as (select cast(ceil(max(len(q)) / {parts}.0) as bigint) as m from v),
        parts as (
            select r, cast(p as bigint) as part,
                list_transform(range(m), lambda j: coalesce(q[p * m + j + 1], 0)) as x
            from v, w, range({parts}) t(p)),
        c0 as (select part, r - 1 as entry, x as e from parts where r <= {entries})"""
    ]

    def assigned(k: int) -> str:
        # squared distance of integers; exact in a double below 2^53
        return f"""a{k} as (
            select r, part, min({{'d': d, 'entry': entry}}) as best from (
                select r, parts.part, entry,
                    cast(list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
                from parts join c{k} on parts.part = c{k}.part)
            group by r, part)"""

    for k in range(rounds):
        steps.append(assigned(k))
        steps.append(f"""m{k} as (
            select part, entry, list(cast(floor_mean as bigint) order by j) as e from (
                select part, entry, j, (s - ((s % n) + n) % n) // n as floor_mean from (
                    select a.part, a.best.entry as entry, j, cast(sum(x[j + 1]) as bigint) as s, count(*) as n
                    from a{k} a join parts using (r, part), w, range(m) t(j)
                    group by all))
            group by part, entry),
        c{k + 1} as (
            select c.part, c.entry, coalesce(m.e, c.e) as e
            from c{k} c left join m{k} m on c.part = m.part and c.entry = m.entry)""")
    steps.append(assigned(rounds))
    steps.append(f"""coded as (
            select r, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error
            from a{rounds} group by r),
        books as (
            select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds})""")
    return f"""with {", ".join(steps)}
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from coded join v using (r), books"""
