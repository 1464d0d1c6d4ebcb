"""SimHash near-duplicates: covering bit masks find every pair of fingerprints within the radius.

Every bit position carries a non-zero vector of radius+1 bits. A mask belongs to each non-zero
vector v and holds the positions whose vector has an odd product with v. Two fingerprints that
differ in ``radius`` places or fewer leave some v with even products at all of those places, so
they agree on the whole mask of v and meet in its table.

Copies share a fingerprint and are collapsed first. Inside a bucket only links that connect are
kept, never all pairs. A bucket above ``BUCKET`` distinct fingerprints is not gathered: its
members meet at the points one or two flips away instead (``_by_centres``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ready, row_key, slices, written

RADIUS = 3
WORDS = 3
SEED = 42
#: Distinct fingerprints of a bucket that one task compares in place.
BUCKET = 8192


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks, as unsigned numbers."""
    vectors = [1 + place % ((1 << radius + 1) - 1) for place in range(bits)]
    return [
        sum(1 << place for place, m in enumerate(vectors) if bin(m & v).count("1") % 2)
        for v in range(1, 1 << radius + 1)
    ]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = WORDS, block: int = 1 << 16) -> int:
    """The unsigned fingerprint of a text: majority of the hash bits of its shingles."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        tokens, words = [b" ".join(tokens)], 1
    ones = np.zeros(64, np.int64)
    total = len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, block):
        part = tokens[start : start + block + words - 1]
        columns = [part[i : len(part) - words + 1 + i] for i in range(words)]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*columns)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``key`` and ``fp`` (bigint) of every row; null text counts as empty, with fingerprint zero."""
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = [signed(fingerprint(t, words)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fps, pa.int64())], ["key", "fp"])

    return rows.mapInArrow(run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def spanning_links(fps: np.ndarray, radius: int = RADIUS, cells: int = 1 << 21) -> list[tuple[int, int]]:
    """(member, root) links that connect what links within the radius connect."""
    rest = np.unique(fps).view(np.uint64)
    links = []
    while len(rest) > 1:
        root, frontier, rest = int(rest[:1].view(np.int64)[0]), rest[:1], rest[1:]
        while len(frontier) and len(rest):
            met = np.zeros(len(rest), bool)
            step = max(1, cells // len(rest))
            for i in range(0, len(frontier), step):
                met |= (np.bitwise_count(frontier[i : i + step, None] ^ rest) <= radius).any(0)
            frontier, rest = rest[met], rest[~met]
            links += [(int(x), root) for x in frontier.view(np.int64)]
    return links


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        lists = batch.column("members")
        flat, ends = lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy())
        for end, members in zip(ends, np.split(flat, ends[:-1])):
            links += spanning_links(members)
        a, b = zip(*links) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _by_centres(members: DataFrame, radius: int) -> DataFrame:
    """Links of large buckets, in proportion to their size.

    Two fingerprints within three flips have a point that is one flip or less from the one and
    two or less from the other; and whoever is that near to such a point is linked through it.
    So members are grouped by the points within two flips (of the bits that the mask leaves
    free), with partial aggregation, and tied to the least member of the point.
    """
    near = (radius - 1) // 2
    far = radius - near
    free = [~m & ((1 << 64) - 1) for m in masks(radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = []
        for mask in free:
            layers = [[0]]
            places = [1 << i for i in range(64) if mask >> i & 1]
            for _ in range(far):
                layers.append(sorted({x | p for x in layers[-1] for p in places if not x & p}))
            both = [(x, depth <= near) for depth, layer in enumerate(layers) for x in layer]
            flips.append((np.array([x for x, _ in both], np.uint64), np.array([n for _, n in both])))
        for batch in batches:
            for fp, number in zip(batch.column("fp").to_pylist(), batch.column("number").to_pylist()):
                change, close = flips[number]
                centres = (np.int64(fp).view(np.uint64) ^ change).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(change), number, np.int32)),
                        pa.array(centres),
                        pa.array(np.full(len(change), fp, np.int64)),
                        pa.array(close),
                    ],
                    ["number", "centre", "fp", "close"],
                )

    points = members.select("fp", "number").mapInArrow(run, "number int, centre bigint, fp bigint, close boolean")
    hubs = (
        points.groupBy("number", "centre")
        .agg(F.min("fp").alias("hub"), F.max("close").alias("tied"), F.count("*").alias("n"))
        .where("tied and n > 1")
        .select("number", "centre", "hub")
    )
    return points.join(hubs, ["number", "centre"]).where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints that keep all connections within ``radius``."""
    cells = F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])
    keyed = distinct.select("fp", F.posexplode(cells).alias("number", "cell"))
    sizes = keyed.groupBy("number", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes, "simhash-buckets")
    small = (
        keyed.join(sizes.where(F.col("n") <= bucket), ["number", "cell"])
        .groupBy("number", "cell")
        .agg(F.collect_list("fp").alias("members"))
        .select("members")
        .mapInArrow(_in_buckets, "a bigint, b bigint")
    )
    large = keyed.join(sizes.where(F.col("n") > bucket), ["number", "cell"])
    return small.union(_by_centres(large, radius)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every node of ``edges`` (a, b): root is the least node it reaches.

    Alternates two star steps until nothing changes. Each round ends in a checkpoint in the
    shared folder; minima are aggregated before they are shuffled.
    """
    ready(edges.sparkSession)
    held = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().checkpoint()
    print_of = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = None
    while True:
        now = held.select(print_of.alias("p")).first()["p"]
        if now == before:
            return held.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(
                held.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct()
            )
        before = now
        both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        tied = wide.join(least, "a")
        narrow = tied.select("a", F.col("m").alias("b")).union(
            tied.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        held = narrow.distinct().checkpoint()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` for every row of ``df``.

    ``component_id`` is the smallest key reachable over links of ``radius`` or fewer differing
    bits, the row's own included; null keys take part but never name a component unless it has
    no other. Repeated rows and repeated keys stay rows of their own. Null, empty and wordless
    texts share the fingerprint zero. Other columns of ``df`` are not read.
    """
    ready(df.sparkSession)
    prints = written(fingerprints(df.select(key, text), key, text), "simhash")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(distinct.select("fp"), radius, bucket))
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component; columns are kept.

    Rows are told apart by their whole content (``row_key``), not by doc_id. The one that stays has the
    smallest doc_id of its component (null last; ties: the smaller key); of rows equal in every
    column one stays. So different texts under one doc_id are weighed each by itself, and copies
    without a doc_id are copies like any other. An empty table stays empty. The rows meet the keys
    that go by a shuffle on the key, at every size: the keys grow with the copies.
    """
    ready(docs.sparkSession)
    tagged = docs.withColumn("_key", row_key(docs))
    name = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    found = near_duplicates(tagged.select(name.alias("_name"), "text"), "_name", "text")
    rows = written(found.select(F.col("_name.key").alias("_key"), F.col("component_id.key").alias("first")), "simhash-rows")
    gone = written(rows.where("_key <> first").select("_key").distinct(), "simhash-gone")
    again = rows.where("_key = first").groupBy("_key").count().where("count > 1").select("_key")
    again = written(again, "simhash-again")
    kept = tagged.join(gone.hint("shuffle_hash"), "_key", "left_anti")
    if not again.isEmpty():  # equal rows: only these are brought together, combined before the shuffle
        kept = kept.join(again, "_key", "left_anti").union(kept.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*docs.columns)
