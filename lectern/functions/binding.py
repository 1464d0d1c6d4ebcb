"""Bind an expression once inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Lambdas of higher-order functions are outside common-subexpression elimination, so an
    expression used in a lambda would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, keep: list[str], fields: Column) -> DataFrame:
    """``keep`` and the fields of a struct, computed once per row.

    Filters on plain columns are pushed below the projection that makes them, which computes
    the columns a second time. They are not pushed through a generator.
    """
    return df.select(*keep, F.explode(F.array(fields)).alias("_once")).select(*keep, "_once.*")


def items(df: DataFrame, keep: list[str], array: str, name: str) -> DataFrame:
    """One row per element of an array column.

    A plain ``explode`` of a column lets the optimizer add a filter on the array's size and
    push it to the scan, which computes the array twice; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
