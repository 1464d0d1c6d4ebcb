"""Toxicity from document labels: sentences are the instances, noisy-or combines them.

A sentence holding learned features (words and word beginnings) is toxic with probability
sigmoid(bias + sum of weights); one without is not. A document is toxic unless each of its sentences fails to be and the leak
fails too: ``1 - (1 - leak) * prod(1 - p)``. Labels are known for documents only; the gradient
of the document likelihood tells which sentences they are about.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ready, slices, written

#: Labelled documents the classifier is fitted on: those with the smallest hash of their id.
SAMPLE = 16_000
#: Words with the strongest association that become features.
VOCABULARY = 4096
#: Least log-likelihood ratio (G2) of a feature.
EVIDENCE = 20.0

#: Lengths of the word beginnings that are features beside whole words: one stem has many forms.
STEMS = (3, 4, 5, 6)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def features(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer ones, marked by a hyphen."""
    return words.union(*[{f"{w[:k]}-" for w in words if len(w) > k} for k in STEMS])


@dataclass(frozen=True)
class Model:
    """Weights of features, the bias of a sentence and the leak of a document."""

    weights: dict[str, float]
    bias: float
    leak: float

    def __post_init__(self):
        stems = {k: {w[:-1] for w in self.weights if w.endswith("-") and len(w) == k + 1} for k in STEMS}
        object.__setattr__(self, "stems", {k: s for k, s in stems.items() if s})

    def may_hold(self, text: str) -> bool:
        """False only if no feature of the model can be in the text."""
        words = set(WORD.findall(text.lower()))
        if not self.weights.keys().isdisjoint(words):
            return True
        return any(not stems.isdisjoint({w[:k] for w in words}) for k, stems in self.stems.items())

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences that hold learned words."""
        if not self.may_hold(text):
            return []
        found = []
        for m in SENTENCE.finditer(text):
            words = self.weights.keys() & features(set(WORD.findall(m[0].lower())))
            if words:
                z = self.bias + sum(self.weights[w] for w in sorted(words))
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))))
        return found

    def score(self, sentences: list[tuple[int, int, float]]) -> float:
        clean = 1 - self.leak
        for _, _, p in sentences:
            clean *= 1 - p
        return 1 - clean


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of each label that hold the feature, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts = (Counter(), Counter())
            for t, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                counts[y].update(features(set(WORD.findall((t or "").lower()))))
            words = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([counts[y][w] for w in words], pa.int64()) for y in (1, 0))],
                ["word", "toxic", "clean"],
            )

    found = rows.mapInArrow(run, "word string, toxic bigint, clean bigint")
    return found.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _evidence(toxic: int, clean: int) -> Column:
    """G2 of a word against the label, for words that are more frequent in toxic documents."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = F.lit(toxic / (toxic + clean))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    c, d, n = F.lit(float(toxic)) - a, F.lit(float(clean)) - b, a + b
    rest = F.lit(float(toxic + clean)) - n
    g2 = 2 * (part(a, n * share) + part(b, n * (1 - share)) + part(c, rest * share) + part(d, rest * (1 - share)))
    return F.when(a * clean > b * toxic, g2).otherwise(0.0)


def _bags(rows: DataFrame, words: list[str]) -> DataFrame:
    """Per document its label and the feature numbers of each sentence that has some."""
    number = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for t in part.column("text").to_pylist():
                bags = set()
                for m in SENTENCE.finditer(t or ""):
                    bags.add(tuple(sorted(number[w] for w in number.keys() & features(set(WORD.findall(m[0].lower()))))))
                out.append(sorted(bags - {()}))
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["toxic", "bags"]
            )

    return rows.mapInArrow(run, "toxic int, bags array<array<int>>")


def _fit(words: list[str], docs: list, base: float, rounds: int = 400, ridge: float = 0.02) -> Model:
    """Maximise the document likelihood by Adam; the sample bounds ``docs``."""
    y = np.array([r["toxic"] for r in docs], float)
    sentence_doc = np.array([i for i, r in enumerate(docs) for _ in r["bags"]], np.int64)
    entry_word = np.array([w for r in docs for bag in r["bags"] for w in bag], np.int64)
    bags = [bag for r in docs for bag in r["bags"]]
    entry_sentence = np.repeat(np.arange(len(bags)), [len(b) for b in bags]) if bags else np.zeros(0, np.int64)
    theta = np.zeros(len(words) + 2)
    theta[:-2], theta[-2], theta[-1] = 2.0, -2.0, math.log(max(base, 1e-4) / 2)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[-2] + np.bincount(entry_sentence, theta[entry_word], len(bags))
        clean = math.exp(theta[-1]) + np.bincount(sentence_doc, np.logaddexp(0, z), len(docs))
        slope = (1 - y) - y / np.expm1(np.maximum(clean, 1e-9))
        by_sentence = slope[sentence_doc] / (1 + np.exp(-z))
        grad = np.zeros_like(theta)
        grad[:-2] = np.bincount(entry_word, by_sentence[entry_sentence], len(words)) + ridge * theta[:-2]
        grad[-2], grad[-1] = by_sentence.sum(), slope.sum() * math.exp(theta[-1])
        grad /= max(1, len(docs))
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Model(
        dict(zip(words, theta[:-2].tolist())), float(theta[-2]), float(-np.expm1(-min(math.exp(theta[-1]), 0.6)))
    )


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` labelled documents with the smallest hash of doc_id.

    ``allowed`` is a condition on doc_id. ``labels`` (doc_id, toxic); a doc_id labelled twice
    counts as toxic if either label says so; null labels and ids teach nothing. The chosen ids,
    at most ``sample``, are broadcast. Repeated documents of an id teach once each. Without
    usable labels every score is zero.
    """
    spark = ready(docs.sparkSession)
    chosen = (
        labels.where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity")
    sums = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, total = sums["t"] or 0, sums["n"]
    if not 0 < toxic < total:
        return Model({}, 0.0, 0.0 if not toxic else 1.0)
    scored = _word_counts(rows).withColumn("g2", _evidence(toxic, total - toxic)).where(F.col("g2") >= EVIDENCE)
    words = sorted(r["word"] for r in scored.orderBy(F.desc("g2"), "word").limit(VOCABULARY).select("word").collect())
    return _fit(words, _bags(rows, words).collect(), toxic / total)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and ``offending``: (start, end, probability) of sentences at 0.5 or more.

    Places are code points of the whole text. Null and empty texts score the leak. Rows are
    neither merged nor dropped.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text"):
            found = [model.sentences(t or "") for t in part.column("text").to_pylist()]
            worst = [[{"start": s, "end": e, "probability": p} for s, e, p in f if p >= 0.5] for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([model.score(f) for f in found], pa.float64()), pa.array(worst, span)],
                ["doc_id", "score", "offending"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, score double, offending array<struct<start:bigint,end:bigint,probability:double>>"
    )


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; the text decides, in place."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text"):
            keep = [model.score(model.sentences(t or "")) < threshold for t in part.column("text").to_pylist()]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
