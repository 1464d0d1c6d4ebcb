"""Raw place JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.places import RAW_PLACE


def parse_places(responses: DataFrame, body: str = "body") -> DataFrame:
    """Search responses ``{places: [...]}`` to one row per place; other columns stay."""
    others = [c for c in responses.columns if c != body]
    parsed = F.from_json(body, f"struct<places: array<{RAW_PLACE}>>")
    return responses.select(*others, parsed.alias("r")).select(
        *others, F.explode("r.places").alias("place")
    )
