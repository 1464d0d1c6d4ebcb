"""Passage tables: keys, lookup, daily picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.dates import pool_index
from lectern.functions.text import ref_key


def with_refs(passages: DataFrame) -> DataFrame:
    """Add the key ``abbr ch:num``."""
    return passages.withColumn("ref", ref_key(F.col("abbr"), F.col("chapter"), F.col("num")))


def by_ref(passages: DataFrame) -> DataFrame:
    """One passage per key, the last by ``pos`` when a key occurs twice.

    ``max_by`` combines before the shuffle, so a key repeated very often stays one small row
    per task.
    """
    df = passages if "ref" in passages.columns else with_refs(passages)
    rest = [c for c in df.columns if c != "ref"]
    return (
        df.groupBy("ref")
        .agg(F.max_by(F.struct(*rest), "pos").alias("p"))
        .select("ref", "p.*")
    )


def lookup(rows: DataFrame, keyed: DataFrame, columns: list[str]) -> DataFrame:
    """H3: exact, case-sensitive key lookup; rows without a passage keep nulls."""
    return rows.join(keyed.select("ref", *columns), "ref", "left")


def daily_picks(dates: DataFrame, refs: list[str] | None = None, date: str = "date") -> DataFrame:
    """Add ``idx`` and ``ref``, the pool entry of each date.

    The pool is a short ordered list, so the pick is an expression and not a join: a join on
    its few indexes would send a big table of dates to a few tasks.
    """
    refs = fixed.DAILY_POOL if refs is None else refs
    pool = F.array(*[F.lit(r) for r in refs])
    return dates.withColumn("idx", pool_index(F.col(date), len(refs))).withColumn(
        "ref", F.element_at(pool, F.col("idx") + 1)
    )


def calendar(first: Column, last: Column, spans: DataFrame) -> DataFrame:
    """One row per day of each span."""
    return spans.select(F.explode(F.sequence(first.cast("date"), last.cast("date"))).alias("date"))


def daily_calendar(
    dates: DataFrame, passages: DataFrame, refs: list[str] | None = None
) -> DataFrame:
    """Date, key, passage text; ``found`` tells missing passages.

    Only passages of the pool leave the scan.
    """
    refs = fixed.DAILY_POOL if refs is None else refs
    keyed = passages if "ref" in passages.columns else with_refs(passages)
    stored = by_ref(keyed.filter(F.col("ref").isin(refs)))
    return lookup(daily_picks(dates, refs), stored, ["book", "chapter", "num", "text"]).select(
        "date",
        "ref",
        F.concat(
            "book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("num").cast("string")
        ).alias("reference"),
        "text",
        F.col("text").isNotNull().alias("found"),
    )
