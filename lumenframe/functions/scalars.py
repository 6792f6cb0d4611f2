"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def near_zero(x: Column) -> Column:
    return F.abs(x) <= 1e-8


def number(x: Column) -> Column:
    """Lenient parse: null for what isn't a plain number."""
    text = x.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def finite(x: Column) -> Column:
    """As double, null for infinities and NaN."""
    d = x.cast("double")
    return F.when(F.abs(d) < float("inf"), d)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places; null where b is about zero."""
    return F.round(F.when(~near_zero(b), a / b), 6)


def scaled(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaled to 0..1; 0 where the range is empty."""
    spread = high - low
    return F.when(F.abs(spread) <= 1e-8 + 1e-5 * F.abs(low), F.lit(0.0)).otherwise((x - low) / spread)


def severity(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.35, "medium").otherwise("low")


def haversine(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    a = half(lat, lat0) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * half(lon, lon0)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(1e-12))))


def spelling(x: Column) -> Column:
    """Trimmed, lower-cased, white space runs as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(x.cast("string")), r"^\s+|\s+$", ""), r"\s+", " ")
