"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str, spread_by: str | None = None) -> DataFrame:
    """One table of a folder.

    A table of fewer splits than there are cores (often a single row group) leaves cores idle.
    With ``spread_by`` its rows are dealt over all cores before costly text work. They are dealt by
    a hash of the key, not by the key, so that no later step can count on it: steps that group
    or join by the key are planned alike whether the table was dealt or not.
    """
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread_by is not None and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, F.xxhash64(spread_by))
    return df
