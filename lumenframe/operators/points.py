"""Single-value outliers: interquartile fences and z-scores on median-filled numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import finite
from .profile import col
from .quantiles import medians, quantiles


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` as doubles, infinities and nulls replaced by the column's median."""
    found = medians(df, {c: finite(col(c)) for c in columns})
    return df.select(*[F.coalesce(finite(col(c)), F.lit(found[c]).cast("double")).alias(c) if c in found else col(c) for c in df.columns])


def flagged(df: DataFrame, columns: list[str], config: Config = DEFAULT) -> DataFrame:
    """``df`` with, for column i, ``iqr_i`` and ``z_i`` (flags) and ``zs_i`` (size of the z-score),
    and ``iqr_ratio``, ``z_peak``, ``iqr_any``, ``z_any``, ``point``, ``beyond`` (the first three flagged columns with their
    values and limits); ``columns`` are filled."""
    data = filled(df, columns)
    moments = {f"{k}{c}": f(col(c)) for c in columns for k, f in (("a", F.avg), ("s", F.stddev_pop))}
    quarters, moments = quantiles(data, {c: col(c) for c in columns}, (0.25, 0.75), moments)
    mean, sd = ({c: moments[f"{k}{c}"] for c in columns} for k in "as")
    number = lambda x: F.lit(x).cast("double")
    made = {}
    for i, c in enumerate(columns):
        q1, q3 = quarters[c]
        spread = (q3 or 0.0) - (q1 or 0.0)
        made[f"iqr_{i}"] = (col(c) < q1 - config.iqr_factor * spread) | (col(c) > q3 + config.iqr_factor * spread) if spread > 1e-8 else F.lit(False)
        made[f"zs_{i}"] = F.abs(col(c) - number(mean[c])) / number(sd[c]) if (sd[c] or 0.0) > 1e-8 else F.lit(0.0)
    data = data.withColumns(made)
    data = data.withColumns({f"z_{i}": F.col(f"zs_{i}") > config.z_limit for i in range(len(columns))})
    n = len(columns)
    peak = F.greatest(*[F.col(f"zs_{i}") for i in range(n)]) if n > 1 else F.col("zs_0")
    data = data.withColumns({
        "iqr_ratio": sum((F.col(f"iqr_{i}").cast("int") for i in range(n)), F.lit(0)) / n,
        "z_peak": F.least(peak / config.z_limit, F.lit(1.0)),
        "iqr_any": F.array_contains(F.array(*[F.col(f"iqr_{i}") for i in range(n)]), True),
        "z_any": F.array_contains(F.array(*[F.col(f"z_{i}") for i in range(n)]), True),
    })
    entries = []
    for i, c in enumerate(columns):
        q1, q3 = quarters[c]
        spread = (q3 or 0.0) - (q1 or 0.0)
        named = {"column": F.lit(c), "value": col(c), "low": number(q1 - config.iqr_factor * spread if q1 is not None else None), "high": number(q3 + config.iqr_factor * spread if q3 is not None else None), "mean": number(mean[c]), "sd": number(sd[c]), "z": F.col(f"zs_{i}"), "iqr": F.col(f"iqr_{i}")}
        entries.append(F.when(F.col(f"iqr_{i}") | F.col(f"z_{i}"), F.struct(*[x.alias(k) for k, x in named.items()])))
    data = data.withColumn("beyond", F.slice(F.array_compact(F.array(*entries)), 1, 3))
    return data.withColumn("point", F.col("iqr_any") | F.col("z_any"))


#: Parts of a column's name that say it can't be negative, or is a percentage.
NOT_NEGATIVE, PERCENT = ("age", "qty", "quantity", "count", "duration", "days", "hours", "month"), ("percent", "pct")


def impossible(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``impossible``: values that the column's name rules out."""
    parts = []
    for c in columns:
        low, x = c.lower(), col(c).cast("double")
        found = F.lit(0)
        if any(t in low for t in NOT_NEGATIVE):
            found = found + F.count_if(x < 0)
        if any(t in low for t in PERCENT):
            found = found + F.count_if((x < 0) | (x > 100))
        parts.append(found)
    wide = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p{i}").cast("bigint").alias("impossible")) for i, c in enumerate(columns)])).alias("r")).select("r.*")
