"""Expressions over the JSON text of an answer, complete or still growing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.text import WEB_SPACE, web_trim

# The body of a JSON string. The loops are possessive: a backtracking group would recurse
# once per character in the JVM's regex engine and overflow its stack on long answers.
STRING_BODY = r"[^\"\\]*+(?:\\[^\n\r\u2028\u2029][^\"\\]*+)*+"


def _field(name: str, closing: str) -> str:
    return rf'"{name}"{WEB_SPACE}*+:{WEB_SPACE}*+"({STRING_BODY}){closing}'


CLOSED = {name: _field(name, '"') for name in ("reference", "text", "response")}
OPEN_RESPONSE = _field("response", r"\z")
RESPONSE_HEAD = rf'"response"{WEB_SPACE}*+:{WEB_SPACE}*+"'


# The escapes that are decoded, in this order.
ESCAPES = (("\\n", "\n"), ("\\t", "\t"), ("\\r", ""), ('\\"', '"'), ("\\\\", "\\"))


def unescape(c: Column) -> Column:
    """Decode the simple escapes, one kind after the other."""
    for escaped, plain in ESCAPES:
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def json_body(raw: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, code fences removed."""
    c = F.regexp_replace(raw, rf"(?i)\A```(?:json)?{WEB_SPACE}*+", "")
    c = F.regexp_replace(c, rf"{WEB_SPACE}*```{WEB_SPACE}*\z", "")
    return F.nullif(F.regexp_extract(web_trim(c), r"(?s)\{.*\}", 0), F.lit(""))


def partial_fields(raw: Column) -> Column:
    """struct(reference, text, response) found so far in an incomplete JSON text.

    ``reference`` and ``text`` are null until both are closed; ``response`` is '' until it
    has begun. Binding the text keeps the optimizer from repeating the whole of it in every
    later use of a field.
    """
    return let(raw, _partial_fields)


def _partial_fields(raw: Column) -> Column:
    both = raw.rlike(CLOSED["reference"]) & raw.rlike(CLOSED["text"])
    reference = F.when(both, unescape(F.regexp_extract(raw, CLOSED["reference"], 1)))
    text = F.when(both, unescape(F.regexp_extract(raw, CLOSED["text"], 1)))
    response = F.when(
        raw.rlike(CLOSED["response"]), F.regexp_extract(raw, CLOSED["response"], 1)
    ).otherwise(F.regexp_extract(raw, OPEN_RESPONSE, 1))
    return F.struct(
        reference.alias("reference"),
        text.alias("text"),
        unescape(response).alias("response"),
    )


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def final_fields(raw: Column) -> Column:
    """I4: struct(reference, text, response) of a finished answer, null when it cannot be read.

    ``response`` must be a JSON string; a passage whose parts are no strings becomes null.
    """
    # inside brackets, so that text after the object is an error and not ignored
    whole = F.try_parse_json(F.concat(F.lit("["), json_body(raw), F.lit("]")))
    return let(whole, _final_fields)


def _final_fields(whole: Column) -> Column:
    alone = F.try_variant_get(whole, "$[1]", "variant").isNull()
    v = F.when(alone, F.try_variant_get(whole, "$[0]", "variant"))
    response = F.try_variant_get(v, "$.response", "variant")
    reference = F.try_variant_get(v, "$.verse.reference", "variant")
    text = F.try_variant_get(v, "$.verse.text", "variant")
    good = (_kind(reference) == "STRING") & (_kind(text) == "STRING")
    return F.when(
        v.isNotNull() & (_kind(response) == "STRING"),
        F.struct(
            F.when(good, F.try_variant_get(v, "$.verse.reference", "string")).alias("reference"),
            F.when(good, F.try_variant_get(v, "$.verse.text", "string")).alias("text"),
            F.try_variant_get(v, "$.response", "string").alias("response"),
        ),
    )
