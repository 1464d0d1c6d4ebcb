"""Batch embedding through a plug-in provider."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.binding import let
from lectern.functions.text import tokens


class RateLimited(Exception):
    """Raised by a provider that asks to wait; waiting does not count as a failed try."""


class Provider(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def call_with_retries(
    call: Callable[[], list[list[float]]],
    tries: int = 5,
    rate_limit_wait: float = 30.0,
    sleep: Callable[[float], None] = time.sleep,
) -> list[list[float]]:
    """Wait without limit on a rate limit, 2^n seconds after the n-th other failure."""
    failures = 0
    while True:
        try:
            return call()
        except RateLimited:
            sleep(rate_limit_wait)
        except Exception:
            failures += 1
            if failures >= tries:
                raise
            sleep(2.0**failures)


EMBEDDED = "ref string, v array<float>, model string, dim int, batch_rows int, batch_seconds double"


def embed(
    inputs: DataFrame,
    provider: Provider,
    batch: int = fixed.EMBED_BATCH,
    retry: Callable = call_with_retries,
) -> DataFrame:
    """F8: vectors of ``(ref, text)`` rows, one provider call per ``batch`` texts.

    A task that is lost is run again by Spark, and rows already stored are left out of the
    next run by ``vector_search.unembedded``, so a job resumes by key.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                began = time.perf_counter()
                vectors = retry(lambda texts=part["text"].tolist(): provider.embed(texts))
                seconds = time.perf_counter() - began
                yield pd.DataFrame(
                    {
                        "ref": part["ref"].to_numpy(),
                        "v": vectors,
                        "model": provider.model,
                        "dim": [len(v) for v in vectors],
                        "batch_rows": len(part),
                        "batch_seconds": seconds,
                    }
                )

    return inputs.select("ref", "text").mapInPandas(run, EMBEDDED)


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """The offline provider: counts of search tokens in ``dim`` hashed places, in the JVM."""
    places = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counted = lambda p: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: F.size(F.filter(p, lambda x: x == d)).cast("float"),
    )
    return let(places, counted)


def embed_hashed(inputs: DataFrame, dim: int = 64) -> DataFrame:
    """F8 with the offline provider: ``(ref, v, model, dim)``."""
    return inputs.select(
        "ref",
        hashed_vector(F.col("text"), dim).alias("v"),
        F.lit(f"hashed-{dim}").alias("model"),
        F.lit(dim).alias("dim"),
    )


def throughput(log: DataFrame, total: Column) -> DataFrame:
    """``(done, seconds, rows_per_second, remaining_seconds)`` from embedded rows.

    Each row carries its batch's rows and seconds, so a row's share of the time is their
    quotient. ``total`` is the number of rows of the whole job.
    """
    done = log.agg(
        F.count("*").alias("done"),
        F.sum(F.col("batch_seconds") / F.col("batch_rows")).alias("seconds"),
    )
    rate = F.col("done") / F.col("seconds")
    return done.select(
        "done",
        "seconds",
        rate.alias("rows_per_second"),
        ((total - F.col("done")) / rate).alias("remaining_seconds"),
    )
