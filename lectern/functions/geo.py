"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """K3: metres between two points given in degrees."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    x = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_lng), F.lit(2))
    return 2 * F.atan2(F.sqrt(x), F.sqrt(1 - x)) * fixed.EARTH_RADIUS_M
