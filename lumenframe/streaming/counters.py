"""Profile counters and point flags over a stream, with limits frozen from a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles


def windowed_counts(stream: DataFrame, time: str, columns: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, missing cells and sums of ``columns`` in each window of event time; works on a
    stream (rows later than ``late`` are dropped) and on a table alike."""
    parts = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}_missing"), F.round(F.sum(c), 6).alias(f"{c}_sum")]
    marked = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return marked.groupBy(F.window(time, window).alias("w")).agg(*parts).select(F.col("w.start").alias("start"), *[F.col(x) for p in [["n"], *[[f"{c}_missing", f"{c}_sum"] for c in columns]] for x in p])


def frozen_limits(table: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    """Fences of each column, from a table."""
    got, _ = quantiles(table, {c: F.col(c) for c in columns}, (0.25, 0.75))
    return {c: (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)) for c, (q1, q3) in got.items()}


def outside(stream: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """The rows with a value outside its limits, and ``columns_outside``."""
    marks = F.array_compact(F.array(*[F.when(~F.col(c).between(lo, hi), F.lit(c)) for c, (lo, hi) in limits.items()]))
    return stream.withColumn("columns_outside", marks).filter(F.size("columns_outside") > 0)
