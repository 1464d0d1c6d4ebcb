"""Vector files and tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_float_vectors(
    spark: SparkSession,
    path: str,
    items: str = "verses",
    key: str = "ref",
    key_type: str = "string",
    lines: bool = False,
) -> DataFrame:
    """A3: ``{model, dim, <items>: [{<key>, v}]}`` as ``(pos, ref, v, model, dim)``.

    One document per file, or per line with ``lines``, so that a store of any size can be
    kept as many bounded documents. ``pos`` is the place in the document.
    """
    schema = f"struct<model: string, dim: int, {items}: array<struct<{key}: {key_type}, v: array<float>>>>"
    whole = spark.read.text(path, wholetext=not lines).select(
        F.from_json("value", schema).alias("f")
    )
    return whole.select(
        "f.model", "f.dim", F.posexplode(f"f.{items}").alias("pos", "e")
    ).select(
        F.col("pos").cast("bigint").alias("pos"), F.col(f"e.{key}").alias("ref"), "e.v", "model", "dim"
    )


def unpack(blobs: DataFrame) -> DataFrame:
    """``(pos, q)`` of packed vectors ``(first, content, dim)``.

    Row i of a blob is its bytes ``[i*dim, (i+1)*dim)`` as signed integers, at position
    ``first + i``. The bytes are viewed, not copied, as Arrow lists.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("first", "content", "dim"))
            for first, content, dim in zip(*columns):
                values = np.frombuffer(content.as_buffer(), dtype=np.int8)
                n = len(values) // dim.as_py()
                offsets = np.arange(n + 1, dtype=np.int32) * dim.as_py()
                vectors = pa.ListArray.from_arrays(offsets, pa.array(values[: offsets[-1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n) + first.as_py()), vectors], names=["pos", "q"]
                )

    return blobs.select("first", "content", "dim").mapInArrow(cut, "pos bigint, q array<tinyint>")


def pack(q: Column) -> Column:
    """An int8 vector as bytes."""
    return F.unhex(F.array_join(F.transform(q, lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(256))), 2, "0")), ""))


def read_packed_vectors(
    spark: SparkSession, data_path: str, meta_path: str, keys: str = "refs", key_type: str = "string"
) -> DataFrame:
    """A4: packed int8 vectors with their metadata as ``(pos, ref, q, scale, model, dim)``.

    Vector i of the data meets key and scale i of the metadata on position.
    """
    schema = f"struct<model: string, dim: int, count: int, {keys}: array<{key_type}>, scales: array<float>>"
    meta = spark.read.text(meta_path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    named = meta.select(
        "m.model", "m.dim", F.posexplode(F.arrays_zip(f"m.{keys}", "m.scales")).alias("pos", "e")
    ).select(
        F.col("pos").cast("bigint").alias("pos"),
        F.col(f"e.{keys}").alias("ref"),
        F.col("e.scales").cast("double").alias("scale"),
        "model",
        "dim",
    )
    blobs = (
        spark.read.format("binaryFile")
        .load(data_path)
        .select(F.lit(0).cast("bigint").alias("first"), "content")
        .withColumn("dim", meta.select("m.dim").scalar())
    )
    return unpack(blobs).join(named, "pos").select("pos", "ref", "q", "scale", "model", "dim")


def write_vector_store(store: DataFrame, path: str) -> None:
    """Vectors as parquet, with a one-row table of model, dimension and count."""
    store.write.mode("overwrite").parquet(f"{path}/vectors")
    written = store.sparkSession.read.parquet(f"{path}/vectors")
    written.groupBy("model", "dim").agg(F.count("*").alias("count")).write.mode(
        "overwrite"
    ).parquet(f"{path}/meta")


def read_vector_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")
