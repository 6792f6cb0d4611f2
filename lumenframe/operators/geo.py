"""Places far from the centre of all places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import haversine, number
from ..session import owned, written
from .profile import col
from .quantiles import quantiles

#: Places that make a centre; share of the distances that is always inside; the least limit in km.
LEAST_PLACES, INSIDE, LEAST_KM, SPREADS = 12, 0.995, 0.5, 6


def _number(df: DataFrame, name: str) -> Column:
    """As number(), which of numbers only has to leave out those that aren't finite."""
    x = col(name).cast("double")
    return F.when(F.abs(x) < float("inf"), x) if df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "double") else number(col(name))


def _placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with valid coordinates, as ``__a`` and ``__o``."""
    ok = df.withColumns({"__a": _number(df, lat), "__o": _number(df, lon)})
    return ok.filter(F.col("__a").between(-90, 90) & F.col("__o").between(-180, 180))


def _centre(places: DataFrame) -> tuple[float, float] | None:
    centre, extra = quantiles(places, {"a": F.col("__a"), "o": F.col("__o")}, (0.5,), {"n": F.count(F.lit(1))})
    return None if extra["n"] < LEAST_PLACES else (centre["a"][0], centre["o"][0])


def _away(ok: DataFrame, centre: tuple[float, float] | None) -> DataFrame:
    """``ok`` with ``center_lat``, ``center_lon`` and ``km``."""
    if centre is None:
        ok, centre = ok.limit(0), (0.0, 0.0)
    at = {"center_lat": F.lit(centre[0]), "center_lon": F.lit(centre[1])}
    return ok.withColumns(at).withColumn("km", haversine(F.col("__a"), F.col("__o"), at["center_lat"], at["center_lon"])).drop("__a", "__o")


def distances(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with valid coordinates and ``km``, their distance from the median place (``center_lat``, ``center_lon``); none
    where fewer than 12 are valid. ``df`` is the raw table: filled coordinates would count as places."""
    ok = _placed(df, lat, lon)
    with owned(df.sparkSession):  # read and parsed once for all scans
        centre = _centre(written(ok.select("__a", "__o")))
    return _away(ok, centre)


def outliers(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """The rows beyond max(median + 6 MAD, 99.5 % quantile, 0.5 km), with ``threshold_km`` and ``ratio``, their distance in limits."""
    ok = _placed(df, lat, lon)
    with owned(df.sparkSession):
        places = written(ok.select("__a", "__o"))
        centre = _centre(places)
        km = written(_away(places, centre).select("km"))
        middle, high = quantiles(km, {"km": F.col("km")}, (0.5, INSIDE))[0]["km"]
        if middle is None:
            limit = LEAST_KM
        else:
            spread = quantiles(km, {"r": F.abs(F.col("km") - F.lit(middle))}, (0.5,))[0]["r"][0]
            limit = max(middle + SPREADS * spread, high, LEAST_KM)
    d = _away(ok, centre)
    return d.withColumns({"threshold_km": F.lit(limit), "ratio": F.col("km") / F.lit(limit)}).filter("km > threshold_km")
