"""Language of texts by prediction by partial matching, as automata over bytes.

For each language the contexts of up to ``ORDER`` bytes are counted with the bytes that follow.
Escape method C with exclusion gives every byte after every context an exact code length; a
context unknown to the tree falls back to its longest known suffix. As the statistics are
frozen, a language is an automaton: its states are the contexts, ``step[state, byte]`` is the
next one and ``cost[state, byte]`` the code length in bits. The language with the shortest code
wins. Many stretches of text run through the automata side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import ready, slices, written

ORDER = 4
#: Training documents of a language: those with the smallest hash of their id.
SAMPLE = 400
#: Contexts whose code lengths are worked out at a time.
ROWS = 2048
#: Bytes of a text that one lane reads.
LANE = 512


@dataclass(frozen=True)
class Model:
    """Symbols are bytes mapped by ``symbol``; the last symbol stands for "before the text".

    ``grams`` are (depth, context, byte, n) arrays of a language. Only they travel; a worker makes
    the automata from them once.
    """

    languages: tuple[str, ...]
    symbol: np.ndarray
    width: int
    grams: tuple[tuple[np.ndarray, ...], ...]
    order: int

    @cached_property
    def automata(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Flat ``step`` and ``cost`` of each language."""
        return [_compile(list(zip(*(a.tolist() for a in g))), self.symbol, self.width) for g in self.grams]


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """(lang, depth, context, byte, n), combined within a slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts: dict[str, list[np.ndarray]] = {}
            for t, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                texts.setdefault(lang, []).append(np.frombuffer((t or "").encode(), np.uint8))
            for lang, arrays in texts.items():
                for depth in range(order + 1):
                    codes = []
                    for a in arrays:
                        if len(a) <= depth:
                            continue
                        code = np.zeros(len(a) - depth, np.int64)
                        for i in range(depth + 1):
                            code = code << 8 | a[i : len(a) - depth + i]
                        codes.append(code)
                    seen, n = np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(seen), pa.string()),
                            pa.array(np.full(len(seen), depth, np.int32)),
                            pa.array(seen >> 8),
                            pa.array((seen & 255).astype(np.int32)),
                            pa.array(n.astype(np.int64)),
                        ],
                        ["lang", "depth", "context", "byte", "n"],
                    )

    found = rows.mapInArrow(run, "lang string, depth int, context bigint, byte int, n bigint")
    return found.groupBy("lang", "depth", "context", "byte").agg(F.sum("n").alias("n"))


def _compile(grams: list[tuple], symbol: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The automaton of one language from (depth, context, byte, n): flat ``step`` (already times ``width``) and ``cost``."""
    names = sorted({(d, c) for d, c, _, _ in grams} | {(0, 0)})
    place = {c: i for i, c in enumerate(names)}
    depth = np.array([d for d, _ in names])
    counts = np.zeros((len(names), width))
    for d, c, byte, n in grams:
        counts[place[d, c], symbol[byte]] += n
    parent = np.array([place.get((d - 1, c & ((1 << 8 * (d - 1)) - 1)), 0) if d else 0 for d, c in names])

    step = np.zeros((len(names), width), np.int32)
    for level in range(int(depth.max()) + 1):  # its own longer context if known, else as its suffix goes on
        at = np.flatnonzero(depth == level)
        if level:
            step[at] = step[parent[at]]
        for longer in np.flatnonzero(depth == level + 1):
            context = names[longer][1]
            if (before := place.get((level, context >> 8))) is not None:
                step[before, symbol[context & 255]] = longer
    step[:, width - 1] = np.arange(len(names))

    def lengths(at: np.ndarray, out: np.ndarray, level: int) -> np.ndarray:
        """Code lengths at contexts ``at`` of one depth; symbols in ``out`` are excluded."""
        if level < 0:
            left = 256.0 - out.sum(1, keepdims=True)
            return np.broadcast_to(np.log2(np.maximum(left, 1.0)), out.shape)
        seen = np.where(out, 0.0, counts[at])
        kinds = (seen > 0).sum(1, keepdims=True)
        total = np.maximum(seen.sum(1, keepdims=True) + kinds, 1.0)
        escape = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / total), 0.0)
        with np.errstate(divide="ignore"):
            coded = -np.log2(seen / total)
        rest = lengths(parent[at], out | (seen > 0), level - 1)
        return np.where(seen > 0, coded, escape + rest)

    cost = np.zeros((len(names), width), np.float32)
    for d in np.unique(depth):
        level = np.flatnonzero(depth == d)
        for first in range(0, len(level), ROWS):
            at = level[first : first + ROWS]
            cost[at] = lengths(at, np.zeros((len(at), width), bool), int(d))
    cost[:, width - 1] = 0.0
    return (step * width).astype(np.int32).ravel(), cost.ravel()


def train(docs: DataFrame, allowed: Column, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Fit on ``sample`` documents of each non-null ``lang`` among those ``allowed``.

    The ids with the smallest hash are chosen, and every context of their whole texts is kept.
    Spark sums the counts; the driver gets the distinct (context, byte) pairs, 14 bytes each, which
    the sample bounds. Null texts teach nothing; without rows no language is learned.
    """
    ready(docs.sparkSession)
    first = Window.partitionBy("lang").orderBy("hash", "doc_id")
    ids = (
        docs.where(allowed & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
        .select("lang", "doc_id", F.xxhash64("doc_id").alias("hash"))
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= sample)
        .select("doc_id", "lang")
        .distinct()
    )
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text")
    grams = written(_grams(rows, order), "ppm")
    found = grams.orderBy("lang", "depth", "context", "byte").toArrow()
    lang = np.array(found.column("lang").to_pylist(), dtype=object)
    kinds = (("depth", np.int8), ("context", np.uint32 if order <= 4 else np.int64), ("byte", np.uint8), ("n", np.int64))
    columns = [found.column(name).to_numpy().astype(kind) for name, kind in kinds]
    seen = np.unique(columns[2])
    # bytes no language knows share one symbol that never has a count; the last is "before the text"
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    names = sorted(set(lang.tolist()))
    split = tuple(tuple(c[lang == name] for c in columns) for name in names)
    return Model(tuple(names), symbol, len(seen) + 2, split, order)


def code_lengths(model: Model, texts: list[bytes], lane: int = LANE) -> np.ndarray:
    """Bits of every text under every language.

    A text is cut into lanes of ``lane`` bytes. A lane first reads the ``order`` bytes before it,
    at no cost: a state depends on no more than those.
    """
    order, pad = model.order, model.width - 1
    data = [model.symbol[np.frombuffer(t, np.uint8)] for t in texts]
    spans = sorted(((min(lane, len(d) - s), i, s) for i, d in enumerate(data) for s in range(0, len(d), lane)), reverse=True)
    bits = np.zeros((len(texts), len(model.languages)))
    if not spans:
        return bits
    lengths = np.array([n for n, _, _ in spans])
    owner = np.array([i for _, i, _ in spans])
    columns = np.full((len(spans), order + lengths[0]), pad, np.int32)
    for row, (n, i, s) in enumerate(spans):
        before = min(order, s)
        columns[row, order - before : order + n] = data[i][s - before : s + n]
    columns = np.ascontiguousarray(columns.T)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for k, (step, cost) in enumerate(model.automata):
        state = np.zeros(len(spans), np.int32)
        spent = np.zeros(len(spans))
        for t in range(order):
            state = step[state + columns[t]]
        for t, n in enumerate(active):
            at = state[:n] + columns[order + t, :n]
            spent[:n] += cost[at]
            state[:n] = step[at]
        bits[:, k] = np.bincount(owner, spent, len(texts))
    return bits


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ``bits`` (code length by language) of every row.

    ``score`` is the share of the winner if code lengths are read as probabilities. A text
    that is null or has no letter is ``und`` with score 0, and so is everything if no language
    was learned. Equal code lengths go to the language that sorts first. Repeated rows stay rows of
    their own, an empty table gives no row, and other columns are not read.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            bits = code_lengths(model, [(t or "").encode() for t in texts])
            names, scores = [], []
            for t, row in zip(texts, bits):
                if not t or not len(row) or not any(map(str.isalpha, t)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(row.argmin())
                names.append(model.languages[best])
                scores.append(float(1 / np.exp2(np.maximum(row[best] - row, -1000.0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([dict(zip(model.languages, r.tolist())) for r in bits], pa.map_(pa.string(), pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "bits"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits map<string,double>")
