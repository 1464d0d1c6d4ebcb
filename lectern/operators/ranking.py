"""Row numbers over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(
    df: DataFrame, key: str, order: str, name: str = "row_number", width: int = 65_536
) -> DataFrame:
    """Number the rows of each ``key`` from 1 by the integer column ``order``.

    A plain window would sort a whole group in one task. Here a group is cut into ranges of
    ``order``; a small table of range counts gives every range its offset, and only the rows
    of one range are sorted together. ``order`` must be unique within a key.
    """
    cut = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    counts = cut.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(key, "_range").orderBy(order)
    return (
        cut.withColumn("_i", F.row_number().over(inside))
        .join(offsets, [key, "_range"])
        .withColumn(name, (F.col("_i") + F.col("_offset")).cast("bigint"))
        .drop("_range", "_i", "_offset")
    )
