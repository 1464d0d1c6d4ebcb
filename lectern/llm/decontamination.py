"""Benchmark passages in documents, paraphrased ones too: latent semantic retrieval, then a check.

1. Terms. An item of the benchmark is known by its content words: words that few items of the
   whole benchmark share. An item with too few of these keeps all its words. Each document becomes the
   sequence of such terms with their places, in one pass over whole texts.
2. Space. Documents are read as overlapping passages of ``WINDOW`` words. Their TF-IDF matrix is
   stacked on the items' own rows, which are repeated often enough to lead; a randomised SVD of it
   (sketch, one power step) gives the latent space. The products of all pairs of terms are summed
   over all passages once, in Spark tasks, and both steps read these sums. With as many
   dimensions as a block has items and some to spare, the space holds the items themselves.
3. Search. A passage whose latent cosine with an item reaches ``COSINE`` is a candidate.
4. Check. The longest common subsequence of the item's and the surrounding text's terms must
   cover ``COVER`` of the item, and that of its answer's terms ``ANSWER`` of the answer, unless
   the item is covered nearly whole (``VERBATIM``).

Items are taken in blocks of ``BLOCK``; what is broadcast is bounded by the terms of a block. A block
of so many terms that their pairs would not fit a task (``PAIRS``) multiplies its passages in each step.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ready, row_key, slices, written

WINDOW = 64
COSINE = 0.45
COVER = 0.6
ANSWER = 0.5
#: Cover from which an item counts whatever became of its answer.
VERBATIM = 0.8
#: Least cover of an item that has too few content words.
PLAIN = 0.8
#: Items searched at a time, and dimensions of the latent space beyond their number.
BLOCK = 256
SPARE = 32
#: Share of all items above which a word is no content word; content words an item needs.
COMMON = 0.1
CONTENT = 8
#: Terms whose sums are added together.
BAND = 512
#: Pairs of terms that a task holds at most, and those of a band of their sums.
PAIRS = 1 << 25
PAIR_BAND = 1 << 17
#: Passages that are multiplied with a basis at a time; few enough to stay in a core's cache.
ROWS = 64
#: Passages whose pairs of terms are made at a time; few enough to stay in a core's cache.
LAID = 1024
#: Terms whose passages are laid out at a time; a longer document stands alone.
PART = 1 << 17

WORD = re.compile(r"\w+")
_SIGN = re.compile(r"[^\w\s\x00-\x7f]")
_BLANKED = bytes(32 if i < 128 and not WORD.match(chr(i)) else i for i in range(256))
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


@dataclass(frozen=True)
class Items:
    """One block of items: ids, term numbers in order, and how many of the last are the answer's."""

    ids: list
    terms: dict[str, int]
    sequences: list[list[int]]
    answers: list[int]
    covers: list[float]
    lengths: list[int]


def common_words(items: DataFrame, count: int, share: float = COMMON) -> set[str]:
    """Words that more than ``share`` of the ``count`` items hold (and more than two).

    Few words can be so frequent: no more than 1 / ``share`` times the words of an average item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, answer in zip(batch.column("text").to_pylist(), batch.column("answer").to_pylist()):
                words = sorted({*WORD.findall((text or "").lower()), *WORD.findall((answer or "").lower())})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    held = items.select("text", "answer").mapInArrow(run, "word string").groupBy("word").count()
    return {r["word"] for r in held.where(F.col("count") > max(2, share * count)).collect()}


def read_items(rows: list, frequent: set[str], cover: float = COVER) -> Items:
    """Items of one block from (item_id, text, answer); the answer is the last sentence if null.

    ``frequent`` are the words that are no content words.
    """
    texts, answers = [], []
    for r in rows:
        body, answer = r["text"] or "", r["answer"]
        if answer is None:
            ends = [m[0] for m in SENTENCE.finditer(body) if WORD.search(m[0])]
            texts.append(WORD.findall(body.lower()))
            answers.append(len(WORD.findall(ends[-1].lower())) if len(ends) > 1 else 0)
        else:
            tail = WORD.findall(answer.lower())
            texts.append(WORD.findall(body.lower()) + tail)
            answers.append(len(tail))
    keep: set[str] = set()
    covers = []
    for t in texts:
        rare = {w for w in t if w not in frequent}
        known = sum(w in rare for w in t) >= CONTENT
        keep |= rare if known else set(t)
        covers.append(cover if known else max(cover, PLAIN))
    terms = {w: i for i, w in enumerate(sorted(keep))}
    sequences = [[terms[w] for w in t if w in terms] for t in texts]
    counts = [sum(w in terms for w in t[len(t) - n :]) for t, n in zip(texts, answers)]
    return Items([r["item_id"] for r in rows], terms, sequences, counts, covers, [len(t) for t in texts])


def find_words(text: str) -> list[str]:
    """What ``WORD`` finds in the lower-cased text; blanks for signs and a split are faster."""
    text = text.lower()
    if not text.isascii():
        text = _SIGN.sub(" ", text)
    return text.encode().translate(_BLANKED).decode().split()


def common_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := places.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def term_sequences(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n_words, terms and places of the documents that hold one of the terms."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(items.terms)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for part in slices(batches, "text"):
            words = [find_words(t or "") for t in part.column("text").to_pylist()]
            lengths = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(lengths)
            numbers = np.fromiter(map(number, chain.from_iterable(words), repeat(-1)), np.int32, int(lengths.sum()))
            at = np.flatnonzero(numbers >= 0)
            row = np.searchsorted(ends, at, side="right")
            counts = np.bincount(row, minlength=len(part))
            keep = np.flatnonzero(counts)
            offsets = pa.array(np.append(0, np.cumsum(counts[keep])), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(keep, pa.int64())),
                    pa.array(lengths[keep], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(numbers[at], pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(at - (ends - lengths)[row], pa.int32())),
                ],
                ["doc_id", "n_words", "terms", "places"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, terms array<int>, places array<int>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of term sequences cut after about ``PART`` terms."""
    for batch in batches:
        sizes = batch.column("terms").value_lengths().to_numpy()
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART, prepend=-1)).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(batch)]):
            yield batch.slice(low, high - low)


def passages(batch: pa.RecordBatch, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, passage, term) counts of overlapping passages of a batch of term sequences, in this order.

    Returns row and passage of each passage, and the number of the passage, term and count of
    each entry. Passage p of a row covers the words from p * window / 2 on.
    """
    half = window // 2
    lengths = batch.column("terms").value_lengths().to_numpy()
    terms, places = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "places"))
    local = places // half
    ends = np.cumsum(lengths)
    base = np.cumsum(np.append(0, local[ends - 1] + 1))  # a row's last word has its highest passage
    number = local + np.repeat(base[:-1], lengths)
    keys = np.concatenate([number, number[local > 0] - 1]) << 32 | np.concatenate([terms, terms[local > 0]])
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    counts, keys = np.diff(np.append(starts, len(keys))), keys[starts]
    entry = keys >> 32
    fresh = np.diff(entry, prepend=-1) > 0
    held = entry[fresh]
    row = np.searchsorted(base, held, side="right") - 1
    return np.stack([row, held - base[row]]), np.cumsum(fresh) - 1, keys & (1 << 32) - 1, counts


def _dense(entry: np.ndarray, term: np.ndarray, weight: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct terms, weights) of ``ROWS`` rows at a time; ``entry`` numbers the rows from 0."""
    count = int(entry[-1]) + 1 if len(entry) else 0
    slot = np.empty(width, np.int64)
    for first in range(0, count, ROWS):
        low, high = np.searchsorted(entry, [first, first + ROWS])
        terms = term[low:high]
        distinct = np.unique(terms)
        slot[distinct] = np.arange(len(distinct))
        rows = np.zeros((min(ROWS, count - first), len(distinct)), weight.dtype)
        rows[entry[low:high] - first, slot[terms]] = weight[low:high]
        yield first, distinct, rows


def _laid(entry: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """(terms, weights, held) of ``LAID`` passages at a time, a column for each, those of most terms first.

    Row i has the i-th terms of the first ``held[i]`` passages; what stands behind these is filling.
    """
    sizes = np.bincount(entry)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    for low in range(0, len(order), LAID):
        some = order[low : low + LAID]
        places = np.arange(sizes[some[0]])
        at = np.minimum(starts[some] + places[:, None], len(term) - 1)
        yield term[at], weight[at], np.searchsorted(-sizes[some], -places).tolist()


def _passage_stats(sequences: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Passages that hold each term, over all documents, and the number of all passages that hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(width, np.int64), 0
        for batch in _parts(batches):
            found, _, term, _ = passages(batch)
            held += np.bincount(term, minlength=width)
            total += found.shape[1]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *some.tolist()], pa.int64()), pa.array([total, *held[some].tolist()], pa.int64())], ["term", "n"]
        )

    rows = sequences.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in rows}
    return np.array([by.get(t, 0) for t in range(width)], float), by.get(-1, 0)


_SUMS = "band bigint, task bigint, part binary"


def _bands(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_SUMS``, one for each band of this task's sums."""
    task = TaskContext.get().partitionId()
    for band, part in parts:
        columns = [pa.array([band], pa.int64()), pa.array([task], pa.int64()), pa.array([part.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["band", "task", "part"])


def _summed(partial: DataFrame) -> DataFrame:
    """(band, part): the parts of all tasks added by bands."""

    def add(parts: pa.Table) -> pa.Table:
        in_order = parts.sort_by("task")  # sums of doubles differ with the order of their terms
        total = sum(np.frombuffer(p.as_py()) for p in in_order.column("part"))
        return pa.table({"band": in_order.column("band").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    return partial.groupBy("band").applyInArrow(add, "band bigint, part binary")


def _collected(partial: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' parts, which are bands of ``BAND`` rows of a matrix."""
    summed = np.zeros(shape)
    for r in _summed(partial).collect():
        summed[r["band"] : r["band"] + BAND] = np.frombuffer(r["part"]).reshape(-1, shape[1])
    return summed


def _product(sequences: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis for the normalised TF-IDF rows A of all passages.

    One partial sum for each core; these are added by bands of ``BAND`` terms in Spark, and the driver
    holds the sum alone.
    """
    shared = sequences.sparkSession.sparkContext.broadcast((idf, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = shared.value
        out = np.zeros(basis.shape)
        for batch in _parts(batches):
            _, entry, term, tf = passages(batch)
            for _, terms, part in _dense(entry, term, tf * idf[term], len(idf)):
                part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
                out[terms] += part.T @ (part @ basis[terms])
        yield from _bands((band, out[band : band + BAND]) for band in range(0, len(out), BAND))

    tasks = sequences.sparkSession.sparkContext.defaultParallelism
    return _collected(sequences.select("terms", "places").coalesce(tasks).mapInArrow(run, _SUMS), basis.shape)


def _pair_sums(sequences: DataFrame, idf: np.ndarray) -> DataFrame:
    """(band, part): A' A for the normalised TF-IDF rows A of all passages, by bands of its rows.

    A passage holds few of the terms, so its pairs are far fewer than the entries of a product with a
    dense basis. A band leaves out the columns before its first row, and is zero below the diagonal.
    """
    shared = sequences.sparkSession.sparkContext.broadcast(idf)
    size = max(1, PAIR_BAND // len(idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        width = len(idf)
        out = np.zeros(width * width)
        for batch in _parts(batches):
            found, entry, term, tf = passages(batch)
            weight = tf * idf[term]
            weight /= np.maximum(np.sqrt(np.bincount(entry, weight * weight, found.shape[1])), 1e-12)[entry]
            for terms, weights, held in _laid(entry, term, weight):
                lines = terms * width
                for last, n in enumerate(held):  # terms of a passage stand in order: each meets those up to itself
                    pairs = lines[: last + 1, :n] + terms[last, :n]
                    np.add.at(out, pairs.ravel(), (weights[: last + 1, :n] * weights[last, :n]).ravel())
        square = out.reshape(width, width)
        yield from _bands((low, square[low : low + size, low:]) for low in range(0, width, size))

    tasks = sequences.sparkSession.sparkContext.defaultParallelism
    return _summed(sequences.select("terms", "places").coalesce(tasks).mapInArrow(run, _SUMS))


def _pair_product(sums: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A' A basis from the pair sums."""
    shared = sums.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        out = np.zeros(basis.shape)
        for batch in batches:
            for low, part in zip(batch.column("band").to_pylist(), batch.column("part")):
                above = np.frombuffer(part.as_buffer()).reshape(-1, len(basis) - low).copy()
                rows = np.arange(len(above))
                out[low : low + len(rows)] += above @ basis[low:]
                above[rows, rows] = 0.0
                out[low:] += above.T @ basis[low : low + len(rows)]
        yield from _bands((band, out[band : band + BAND]) for band in range(0, len(out), BAND))

    tasks = sums.sparkSession.sparkContext.defaultParallelism
    return _collected(sums.orderBy("band").coalesce(tasks).mapInArrow(run, _SUMS), basis.shape)


def _multiplier(sequences: DataFrame, idf: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The map from a basis to A' A basis; pairs of terms are summed once, if a task can hold them."""
    if len(idf) ** 2 > PAIRS:
        return lambda basis: _product(sequences, idf, basis)
    sums = written(_pair_sums(sequences, idf), "pairs")
    return lambda basis: _pair_product(sums, basis)


def _item_rows(items: Items, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items.ids), len(idf)))
    for i, s in enumerate(items.sequences):
        np.add.at(out[i], s, 1.0)
    out *= idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def latent_space(sequences: DataFrame, items: Items, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """idf and the leading right singular vectors (terms x dimensions) of items and passages.

    Both come from the passages of all documents, none left out; the items' rows weigh as much as
    all passages together.
    """
    width = len(items.terms)
    held, total = _passage_stats(sequences, width)
    idf = np.log((1 + total) / (1 + held)) + 1e-6
    own = _item_rows(items, idf)
    weight = max(1.0, total) / max(1, len(own))
    rank = min(width, len(own) + SPARE)

    product = _multiplier(sequences, idf)

    def multiply(basis):
        return product(basis) + weight * (own.T @ (own @ basis))

    basis = np.linalg.qr(multiply(np.random.default_rng(seed).standard_normal((width, rank))))[0]
    image = multiply(basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    return idf, basis @ turn[:, np.argsort(-values)]


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, cosine, cover, answer_cover, start_word: benchmark items found in documents.

    One row for each document and item, from the passage that covers the item best (ties: higher
    cosine, then the earliest). ``benchmark`` has item_id, text and perhaps answer; without one the
    last sentence counts as the answer, and an item of one sentence has no answer to check. Null
    and empty items match nothing; nor do null and empty texts. Repeated documents of one id give
    one row with the best passage among them. A text of any length is read whole; other columns
    of ``docs`` are not read.
    """
    spark = ready(docs.sparkSession)
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, cover double, answer_cover double, start_word bigint"
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    usable = benchmark.where(F.col("text").rlike(r"[\p{L}\p{N}_]")).select("item_id", "text", answer.alias("answer")).distinct()
    count = usable.count()
    blocks = -(-count // BLOCK)
    frequent = common_words(usable, count) if count else set()
    numbered = usable.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = numbered.where(F.col("b") == b).orderBy("item_id", "text").collect()
        if rows:
            items = read_items(rows, frequent, cover)
            sequences = written(term_sequences(docs, items), "terms")
            found = found.union(_search(sequences, items, *latent_space(sequences, items), cosine, schema))
    best = F.max_by(F.struct("cosine", "cover", "answer_cover", "start_word"), F.struct("cover", "cosine", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def _search(sequences, items, idf, space, cosine, schema) -> DataFrame:
    """Candidates by latent cosine, checked against the terms around the passage."""
    own = _item_rows(items, idf) @ space
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    shared = sequences.sparkSession.sparkContext.broadcast((items, idf, space.astype(np.float32), own.astype(np.float32)))
    spans = [n // 2 for n in items.lengths]

    def check(item: int, terms: np.ndarray, places: np.ndarray, passage: int):
        items = shared.value[0]
        sequence, tail = items.sequences[item], items.answers[item]
        begin = passage * (WINDOW // 2)
        low, high = np.searchsorted(places, [begin - spans[item], begin + WINDOW + spans[item]])
        around = terms[low:high].tolist()
        part = common_length(sequence, around) / len(sequence)
        answer = common_length(sequence[len(sequence) - tail :], around) / tail if tail else None
        return part, answer

    def near(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, float]]:
        """(row, item, passage, cosine) of the candidates."""
        _, idf, space, own = shared.value
        (row, local), entry, term, tf = passages(batch)
        for first, terms, part in _dense(entry, term, (tf * idf[term]).astype(np.float32), len(idf)):
            vectors = part @ space[terms]
            cosines = vectors @ own.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            for p, item in zip(*np.nonzero(cosines >= cosine)):
                yield int(row[first + p]), int(item), int(local[first + p]), float(cosines[p, item])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value[0]
        for batch in _parts(batches):
            out = [[] for _ in range(6)]
            ids = batch.column("doc_id")
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy()).tolist()
            terms, places = (batch.column(c).flatten().to_numpy() for c in ("terms", "places"))
            best: dict[tuple[int, int], tuple] = {}
            for row, item, at, value in near(batch):
                whole = slice(ends[row - 1] if row else 0, ends[row])
                part, answer = check(item, terms[whole], places[whole], at)
                if part >= items.covers[item] and (part >= VERBATIM or answer is None or answer >= ANSWER):
                    option = (part, value, -at, answer)
                    if (row, item) not in best or option[:3] > best[row, item][:3]:
                        best[row, item] = option
            for (row, item), (part, value, at, answer) in best.items():
                found = (ids[row].as_py(), items.ids[item], value, part, answer, -at * (WINDOW // 2))
                for column, x in zip(out, found):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field("doc_id").type), _array(out[1], schema)]
                + [pa.array(c, pa.float64()) for c in out[2:5]] + [pa.array(out[5], pa.int64())],
                ["doc_id", "item_id", "cosine", "cover", "answer_cover", "start_word"],
            )

    return sequences.mapInArrow(run, schema)


def _array(values: list, schema: str) -> pa.Array:
    text = "item_id string" in schema
    return pa.array(values, pa.string() if text else pa.int64()) if text or "item_id bigint" in schema else pa.array(values)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in whose text an item is found; columns are kept.

    Rows are known by their whole content (``row_key``): another text under the same doc_id stays, and
    a row without a doc_id goes like any other. An empty table stays empty.
    """
    tagged = docs.withColumn("_key", row_key(docs))
    found = contaminated(tagged.select(F.col("_key").alias("doc_id"), "text"), benchmark)
    gone = written(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")  # its size is then known
    return tagged.join(gone, "_key", "left_anti").select(*docs.columns)
