"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; its
result is written as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``; the last returns the encoded corpus.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from lectern.llm import byte_bpe, decontamination, secret_automaton, simhash_covering, toxicity  # noqa: E402
from lectern.llm.common import fold, table, written  # noqa: E402
from lectern.llm.queries import RANKS, digests  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; learned as in the query on toxicity."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates, the one with the smallest doc_id (null last)."""
    return simhash_covering.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item is found."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by the name of its kind; n_chars follows the text."""
    return secret_automaton.redact(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of all documents."""
    return digests(byte_bpe.encode(spark, docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: Trained models, automata and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
