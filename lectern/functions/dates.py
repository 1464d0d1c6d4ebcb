"""Date functions as Column expressions; the date is always a column, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.text import web_trim


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def pool_index(date: Column, size: int) -> Column:
    """Day of year (1 January = 1) modulo the pool size."""
    return F.dayofyear(date) % F.lit(size)


def day_part(ts: Column) -> Column:
    """C3."""
    h = F.hour(ts)
    return (
        F.when((h >= 5) & (h < 12), "morning")
        .when((h >= 12) & (h < 19), "afternoon")
        .otherwise("night")
    )


def weekday_name(date: Column) -> Column:
    return F.element_at(_words(fixed.WEEKDAYS_ES), F.dayofweek(date))


def hours_of_day(lines: Column, date: Column) -> Column:
    """C4: opening hours of the weekday of ``date``; null when absent or closed."""
    line = F.get(
        F.filter(lines, lambda l: F.startswith(F.lower(l), weekday_name(date))), F.lit(0)
    )
    colon = F.instr(line, ":")
    rest = F.when(
        colon > 0, web_trim(F.substring(line, colon + 1, F.length(line)))
    ).otherwise(line)
    return F.when(~rest.rlike("(?i)cerrado|closed"), F.concat(F.lit("Hoy "), rest))


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def _line_parts(line: Column, date: Column) -> dict[str, Column]:
    colon = F.instr(line, ":")
    day = F.when(colon > 0, F.substring(line, F.lit(1), colon - 1)).otherwise(line)
    hours = F.when(
        colon > 0, web_trim(F.substring(line, colon + 1, F.length(line)))
    ).otherwise(F.lit(""))
    return {
        "day": capital(day),
        "hours": F.when(hours == "", F.lit("—")).otherwise(hours),
        "is_today": F.lower(day) == weekday_name(date),
    }


def split_hours(lines: Column, date: Column) -> Column:
    """Array of struct(day, hours, is_today), one per line."""
    return F.transform(
        lines, lambda line: F.struct(*[part.alias(name) for name, part in _line_parts(line, date).items()])
    )


def hours_rows(rows: DataFrame, keep: list[str], lines: str = "lines", date: str = "date") -> DataFrame:
    """C5 as rows: ``keep``, ``line`` (from 0), ``day``, ``hours``, ``is_today`` of every line.

    Lines are exploded first, so that the rest is compiled instead of evaluated in a lambda.
    """
    # the outer form keeps the optimizer from computing the lines a second time for their size
    each = rows.select(*keep, F.col(date).alias("_date"), F.posexplode_outer(lines).alias("line", "_line"))
    parts = _line_parts(F.col("_line"), F.col("_date"))
    return each.where(F.col("line").isNotNull()).select(*keep, "line", *[part.alias(name) for name, part in parts.items()])


def long_date(date: Column, weekday: bool = False) -> Column:
    """``1 de enero de 2024``, with the weekday in front on request."""
    text = F.concat(
        F.dayofmonth(date).cast("string"),
        F.lit(" de "),
        F.element_at(_words(fixed.MONTHS_ES), F.month(date)),
        F.lit(" de "),
        F.year(date).cast("string"),
    )
    if weekday:
        text = F.concat(weekday_name(date), F.lit(", "), text)
    return text
