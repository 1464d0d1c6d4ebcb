"""Event frames as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import web_trim


def frame_text(event: Column, data: Column) -> Column:
    """``event: N``, ``data: JSON`` and an empty line. ``data`` is JSON text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def _last_field(lines: Column, name: str) -> Column:
    marked = F.filter(lines, lambda l: F.startswith(l, F.lit(name)))
    line = F.get(marked, F.size(marked) - 1)
    return web_trim(F.substring(line, F.lit(len(name) + 1), F.length(line)))


def is_json(text: Column) -> Column:
    """The text is exactly one JSON value."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return boxed.isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()


def frame_fields(frame: Column) -> Column:
    """struct(event, data) of one frame; the last ``event:`` and ``data:`` lines win."""
    lines = F.split(frame, "\n", -1)
    return F.struct(
        F.coalesce(_last_field(lines, "event:"), F.lit("message")).alias("event"),
        _last_field(lines, "data:").alias("data"),
    )


def parse_frames(texts: DataFrame) -> DataFrame:
    """A10: ``(stream_id, seq, event, data)`` of the complete frames in ``text``.

    What follows the last empty line is an incomplete frame and is withheld. Frames without
    data or with bad JSON are dropped; ``seq`` counts all frames.
    """
    parts = F.split("text", "\n\n", -1)
    complete = F.slice(parts, F.lit(1), F.size(parts) - 1)
    numbered = texts.select("stream_id", F.posexplode(complete).alias("seq", "frame"))
    return framed(numbered.withColumn("seq", F.col("seq").cast("bigint")))


def framed(frames: DataFrame) -> DataFrame:
    """``(stream_id, seq, event, data)`` of whole frame texts; the stream and the batch form share this."""
    return (
        frames.filter(web_trim(F.col("frame")) != "")
        .select("stream_id", "seq", frame_fields(F.col("frame")).alias("f"))
        .select("stream_id", "seq", "f.event", "f.data")
        .filter((F.col("data") != "") & is_json(F.col("data")))
    )
