"""What the operators of this subpackage share: tables, written intermediates, batch slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import prepare, shared_folder

#: Bytes of text that a Python step takes from an Arrow batch at a time.
SLICE_BYTES = 2 << 20


def ready(spark: SparkSession) -> SparkSession:
    """A session as the operators here need it: package sent, checkpoints and batches set.

    Arrow batches are bounded by bytes, because texts of any length come 10,000 to a batch
    otherwise.
    """
    prepare(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder, with the package sent to the workers."""
    return ready(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once below the shared folder and read back.

    Later steps read the files, so a lost executor costs its own tasks only and nothing
    above the write is computed twice.
    """
    spark = ready(df.sparkSession)
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: str, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(df: DataFrame) -> Column:
    """Two 64-bit hashes of all columns as text: rows have the same key if they are equal in every column.

    A null is told from a value that stands in a neighbouring column by the null flags beside it.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    columns += [c.isNull() for c in columns]
    return F.concat_ws(":", F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about SLICE_BYTES; a longer text stands alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


#: Rows of a side that may be broadcast whole.
BROADCAST_ROWS = 100_000


def attach(rows: DataFrame, side: DataFrame, key: str, spread: str, salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row a ``key``; null keys meet.

    The side is written and counted. Up to BROADCAST_ROWS rows it is broadcast. A longer one is
    repeated ``salts`` times, and the rows of a key are dealt over the copies by a hash of
    ``spread``, so that no key, however frequent, lands in one task.
    """
    side = written(side, "side").withColumnRenamed(key, "_side")
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), rows[key].eqNullSafe(F.col("_side"))).drop("_side")
    copies = side.withColumn("_copy", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    met = dealt.join(copies, dealt[key].eqNullSafe(F.col("_side")) & (F.col("_salt") == F.col("_copy")))
    return met.drop("_side", "_salt", "_copy")
