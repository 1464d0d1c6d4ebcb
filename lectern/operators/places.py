"""Places around centres (K1-K6)."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.geo import haversine
from lectern.functions.text import clamp, maps_link, web_trim
from lectern.operators import boxes

#: The greatest finite number.
MOST = sys.float_info.max

RAW_PLACE = (
    "struct<id: string, displayName: struct<text: string>, formattedAddress: string,"
    " location: struct<latitude: double, longitude: double>, nationalPhoneNumber: string,"
    " internationalPhoneNumber: string, websiteUri: string, rating: double,"
    " userRatingCount: bigint, regularOpeningHours: struct<weekdayDescriptions: array<string>>,"
    " googleMapsUri: string, photos: array<struct<name: string>>,"
    " editorialSummary: struct<text: string>>"
)


def _photo_names(photos: Column) -> Column:
    named = F.filter(photos, lambda p: p["name"] != "")
    return F.coalesce(
        F.transform(named, lambda p: p["name"]), F.array().cast("array<string>")
    )


def flatten(raw: DataFrame, place: str = "place") -> DataFrame:
    """K1: one flat row per raw place; the other columns of ``raw`` stay."""
    p = F.col(place)
    others = [c for c in raw.columns if c != place]
    lat, lng = p["location"]["latitude"], p["location"]["longitude"]
    return raw.select(
        *others,
        p["id"].alias("place_id"),
        p["displayName"]["text"].alias("name"),
        F.coalesce(p["formattedAddress"], F.lit("")).alias("address"),
        lat.alias("lat"),
        lng.alias("lng"),
        F.coalesce(p["nationalPhoneNumber"], p["internationalPhoneNumber"]).alias("phone"),
        p["websiteUri"].alias("website"),
        p["rating"].alias("rating"),
        p["userRatingCount"].alias("rating_count"),
        p["regularOpeningHours"]["weekdayDescriptions"].alias("opening_hours"),
        maps_link(p["googleMapsUri"], lat, lng, p["id"]).alias("maps_url"),
        F.get(_photo_names(p["photos"]), F.lit(0)).alias("photo_name"),
        _photo_names(p["photos"]).alias("photo_names"),
        p["editorialSummary"]["text"].alias("description"),
    )


def keep(places: DataFrame, exclusion: str = fixed.PLACE_EXCLUSION) -> DataFrame:
    """K2: places with a position and a name that match no exclusion."""
    words = F.concat(F.col("name"), F.lit(" "), F.coalesce("address", F.lit("")))
    return places.filter(
        F.col("lat").isNotNull()
        & F.col("lng").isNotNull()
        & (F.col("name") != "")
        & ~words.rlike(f"(?iu){exclusion}")
    )


def nearest(
    centres: DataFrame, places: DataFrame, k: int = fixed.MAX_PLACES, block_bytes: int = boxes.BLOCK_BYTES
) -> DataFrame:
    """K4: ``(centre_id, pos, distance, rank)``: the k nearest places of each centre.

    Places lie in blocks of neighbours; a centre meets the blocks that may hold one of its k nearest,
    none beyond. A search radius biases a service's ranking but
    excludes nothing, so none is applied. Ties (to a micrometre) go to the lower ``pos``. Places or
    centres without a position take no part.
    """
    point = [F.col(x).cast("double").alias(x) for x in ("lat", "lng")]
    # a number beyond any other, or none, is no position
    placed = F.col("lat").between(-MOST, MOST) & F.col("lng").between(-MOST, MOST)
    hits = boxes.nearest(
        centres.select(F.col("centre_id").alias("query_id"), *point).where(placed),
        places.select("pos", *point).where(placed),
        k,
        block_bytes,
    )
    return hits.select(
        F.col("query_id").alias("centre_id"), "pos", F.round(-F.col("score"), 6).alias("distance"), "rank"
    )


def detail(places: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """K5: detail rows with up to 10 photos; distance from the request's origin, else 0.

    ``origins`` is ``(place_id, origin struct<lat, lng>)``, the origin possibly null.
    """
    named = places.filter(F.col("lat").isNotNull() & (F.col("name") != ""))
    if origins is None:
        asked = named.withColumn("origin", F.lit(None).cast("struct<lat:double,lng:double>"))
    else:
        asked = origins.join(named, "place_id")
    return asked.select(
        "place_id",
        "name",
        F.slice("photo_names", 1, fixed.MAX_PHOTOS).alias("photo_names"),
        "description",
        haversine(
            F.coalesce("origin.lat", "lat"), F.coalesce("origin.lng", "lng"), F.col("lat"), F.col("lng")
        ).alias("distance"),
    )


def choose_centres(requests: DataFrame, geocodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6: requests with a position (explicit first, else by address), and the rejected ones.

    ``requests`` (centre_id, lat, lng, address, radius); ``geocodes`` (address, lat, lng,
    formatted_address), one row per address.
    """
    explicit = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    looked_up = requests.withColumn(
        "_address", F.when(~explicit, F.nullif(web_trim(F.col("address")), F.lit("")))
    ).join(
        geocodes.select(
            F.col("address").alias("_address"),
            F.col("lat").alias("_lat"),
            F.col("lng").alias("_lng"),
            "formatted_address",
        ),
        "_address",
        "left",
    )
    placed = looked_up.select(
        "centre_id",
        F.when(explicit, F.col("lat")).otherwise(F.col("_lat")).alias("lat"),
        F.when(explicit, F.col("lng")).otherwise(F.col("_lng")).alias("lng"),
        "formatted_address",
        clamp(F.col("radius"), 500, 50000, 5000).alias("radius"),
        F.when(
            ~explicit & F.col("_address").isNull(), "no position and no address"
        ).when(~explicit & F.col("_lat").isNull(), "address not found").alias("reason"),
    )
    good = placed.filter("reason is null").drop("reason")
    return good, placed.filter("reason is not null").select("centre_id", "reason")
