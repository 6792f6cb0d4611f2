"""What is wrong with a table's values, by issue and column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import spelling
from . import points, profile
from .profile import col
from .times import counted

#: Issues in the order of a report.
ISSUES = ("missing_values", "duplicates", "impossible_values", "inconsistent_categories", "extreme_skew", "invalid_dates", "invalid_geospatial")


def inconsistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column`` and ``n``, the rows whose value has another spelling, of all ``columns`` in one aggregate: values are counted before
    they meet by spelling, so a frequent one is a row for each task."""
    cells = F.array_compact(F.array(*[F.when(col(c).isNotNull(), F.struct(F.lit(c).alias("column"), spelling(col(c)).alias("s"), col(c).cast("string").alias("raw"))) for c in columns]))
    by = df.select(F.explode(cells).alias("v")).groupBy("v.column", "v.s", "v.raw").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("column", "s").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).filter("k > 1").groupBy("column").agg(F.sum("n").alias("n"))


def by_column(df: DataFrame, numeric: list[str], categories: list[str], dates: list[str], coordinates: tuple[str, str] | None, counts: DataFrame | None = None) -> DataFrame:
    """``issue``, ``column``, ``n`` (above 0). Skewed columns count 1; coordinate faults stand with the latitude, the longitude is named with 0."""
    spark = df.sparkSession
    rows = lambda issue, d, n: d.select(F.lit(issue).alias("issue"), F.col("column"), n.cast("bigint").alias("n"))
    parts = [rows("missing_values", (counts or profile.counts(df)), F.col("missing")), rows("duplicates", profile.duplicate_rows(df).withColumn("column", F.lit("")), F.col("duplicate_rows"))]
    if numeric:
        parts += [rows("impossible_values", points.impossible(df, numeric), F.col("impossible")), rows("extreme_skew", profile.skew(df, numeric), (F.abs("skewness") > 1).cast("bigint"))]
    if categories:
        parts.append(rows("inconsistent_categories", inconsistent(df, categories), F.col("n")))
    if dates:
        parts.append(spark.createDataFrame([("invalid_dates", c, present - valid) for c, (present, valid) in counted(df, dates).items()], "issue string, column string, n bigint"))
    if coordinates:
        g = profile.geo_summary(df, *coordinates).select((F.col("invalid_pairs") + F.col("missing_pairs") + F.col("invalid_latitude") + F.col("invalid_longitude")).alias("n"), F.explode(F.array(*map(F.lit, coordinates))).alias("column"))
        parts.append(g.filter("n > 0").select(F.lit("invalid_geospatial").alias("issue"), "column", F.when(F.col("column") == coordinates[0], F.col("n")).otherwise(0).cast("bigint").alias("n")))
    found = reduce(DataFrame.unionByName, parts)
    return found.filter((F.col("n") > 0) | (F.col("issue") == "invalid_geospatial"))


def summary(parts: DataFrame) -> DataFrame:
    """``issue``, ``n``, ``columns`` (names in order) of all seven issues, zeros included. ``parts`` is by_column(): a row for each column."""
    found = parts.groupBy("issue").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set(F.nullif("column", F.lit("")))).alias("columns"))
    every = parts.sparkSession.createDataFrame([(x,) for x in ISSUES], "issue string")
    return every.join(F.broadcast(found), "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))  # seven rows
