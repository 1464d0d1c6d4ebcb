"""Literal check of quoted passages (H1-H6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.binding import let
from lectern.functions.text import WEB_SPACE, compare_fold, ref_key, web_trim
from lectern.operators.passages import by_ref, with_refs

_SPACE = WEB_SPACE[1:-1]
# lazy book name, chapter, separators, number; anchored, so ranges do not parse
REFERENCE = (
    rf"\A{WEB_SPACE}*([^\n\r\u2028\u2029]+?){WEB_SPACE}+(\d+)[{_SPACE},:.\-]+(\d+){WEB_SPACE}*\z"
)


def parse_reference(reference: Column) -> Column:
    """H1: struct(book, chapter, num), null when the reference does not parse."""

    def parts(r: Column) -> Column:
        return F.when(
            r.rlike(REFERENCE),
            F.struct(
                F.regexp_extract(r, REFERENCE, 1).alias("book"),
                F.regexp_extract(r, REFERENCE, 2).try_cast("bigint").alias("chapter"),
                F.regexp_extract(r, REFERENCE, 3).try_cast("bigint").alias("num"),
            ),
        )

    return let(reference, parts)


def book_names(passages: DataFrame) -> DataFrame:
    """``(name_key, abbr)``: lower-cased full name to abbreviation, the last by ``pos`` wins."""
    return (
        passages.groupBy(F.lower("book").alias("name_key"))
        .agg(F.max_by("abbr", "pos").alias("name_abbr"))
    )


def abbreviations(passages: DataFrame) -> DataFrame:
    return passages.select(F.lower("abbr").alias("abbr_key")).distinct()


def _nowhere(rows: DataFrame) -> Column:
    """A key that no passage has, different for different rows. References that do not parse
    would otherwise all share the null key, and a table full of them would land in one task
    of a left join."""
    return F.concat(F.lit("\x00"), F.xxhash64(*rows.columns).cast("string"))


def resolve_books(refs: DataFrame, passages: DataFrame) -> DataFrame:
    """H2: add ``abbr``: by full name first, else the typed spelling if any abbreviation equals
    it case-insensitively, else null. ``refs`` has a ``parsed`` struct."""
    book = web_trim(F.lower(F.col("parsed.book")))
    return (
        refs.withColumn("book_key", F.coalesce(book, _nowhere(refs)))
        .join(book_names(passages), F.col("book_key") == F.col("name_key"), "left")
        .join(abbreviations(passages), F.col("book_key") == F.col("abbr_key"), "left")
        .withColumn(
            "abbr",
            F.coalesce(
                F.nullif("name_abbr", F.lit("")),
                F.when(F.col("abbr_key").isNotNull(), web_trim(F.col("parsed.book"))),
            ),
        )
        .drop("book_key", "name_key", "name_abbr", "abbr_key")
    )


def texts_agree(quoted: Column, stored: Column) -> Column:
    """H4: one folded text contains the other, so an empty quote passes."""
    folded = F.struct(compare_fold(quoted).alias("a"), compare_fold(stored).alias("b"))
    return let(folded, lambda f: F.contains(f["b"], f["a"]) | F.contains(f["a"], f["b"]))


def validate(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """H5: add ``ok, found_reference, found_text, reason`` to rows with ``reference, text``.

    ``found_text`` is the stored text. Reasons, in order: unparseable, not found, mismatch.
    """
    parsed = quotes.withColumn("parsed", parse_reference(F.col("reference")))
    resolved = resolve_books(parsed, passages).withColumn(
        "ref",
        F.coalesce(
            ref_key(F.col("abbr"), F.col("parsed.chapter"), F.col("parsed.num")), _nowhere(quotes)
        ),
    )
    # only quoted passages take part in the shuffle that keeps the last of each key
    quoted = with_refs(passages).join(
        resolved.filter("abbr is not null").select("ref").distinct(), "ref", "left_semi"
    )
    stored = by_ref(quoted).select(
        "ref",
        F.concat(
            "book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("num").cast("string")
        ).alias("_reference"),
        F.col("text").alias("_text"),
    )
    agree = F.coalesce(texts_agree(F.col("text"), F.col("_text")), F.lit(False))
    return (
        resolved.join(stored, "ref", "left")
        .withColumn(
            "reason",
            F.when(F.col("abbr").isNull(), fixed.REASON_UNPARSEABLE)
            .when(F.col("_text").isNull(), fixed.REASON_NOT_FOUND)
            .when(~agree, fixed.REASON_MISMATCH),
        )
        .select(
            *quotes.columns,
            F.col("reason").isNull().alias("ok"),
            F.when(F.col("reason").isNull(), F.col("_reference")).alias("found_reference"),
            F.when(F.col("reason").isNull(), F.col("_text")).alias("found_text"),
            "reason",
        )
    )


def apply_to_answers(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """H6: ``(answer_id, reference, text, response, warning)`` and any further columns.

    A passage that fails is dropped with a warning, the response stays; an answer without a
    passage passes.
    """
    others = [c for c in answers.columns if c not in ("answer_id", "reference", "text", "response")]
    quoted = F.col("reference").isNotNull()
    warning = F.concat(F.lit(fixed.WARNING_PREFIX), F.col("reason"))
    return validate(answers, passages).select(
        "answer_id",
        F.col("found_reference").alias("reference"),
        F.col("found_text").alias("text"),
        "response",
        *others,
        F.when(quoted & ~F.col("ok"), warning).alias("warning"),
    )
