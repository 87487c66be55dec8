"""Distances and place names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.asin(F.sqrt(a)) * (2 * EARTH_KM)


def tokens(text: Column) -> Column:
    """The distinct runs of a-z and digits of a lower-cased text, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def tokens_contained(a: Column, b: Column) -> Column:
    """One token set holds the other; empty sets hold nothing."""
    filled = (F.size(a) > 0) & (F.size(b) > 0)
    return filled & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
