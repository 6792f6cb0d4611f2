"""Deviation within groups: a value far from its group's mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import spelling
from ..session import written
from .profile import col


def group_stats(df: DataFrame, context: str, value: str, config: Config = DEFAULT) -> DataFrame:
    """``context``, ``n``, ``mean``, ``sd`` of groups of enough rows, if there are two or more.
    Partial aggregates go before the shuffle, so a hot group costs no more than another."""
    g = df.groupBy(F.coalesce(col(context).cast("string"), F.lit("nan")).alias("context")).agg(F.count(F.lit(1)).alias("n"), F.avg(col(value)).alias("mean"), F.stddev_samp(col(value)).alias("sd"))
    g = g.filter(F.col("n") >= config.group_rows)
    return g.crossJoin(F.broadcast(g.agg(F.count(F.lit(1)).alias("groups")))).filter("groups >= 2").drop("groups")


#: Groups whose means are broadcast, over all context columns; more are joined by shuffling.
BROADCAST_GROUPS = 10_000


def moments(df: DataFrame, contexts: list[str], values: list[str], config: Config = DEFAULT) -> DataFrame:
    """``c`` (place of the context column), ``context`` (its value), ``n``, and ``mean_j``, ``sd_j`` of each of ``values``: the groups of
    all context columns in one scan and one aggregate, those of enough rows, of columns with two or more such groups."""
    keys = F.array(*[F.struct(F.lit(i).alias("c"), _group(c).alias("context")) for i, c in enumerate(contexts)])
    rows = df.select(*[col(v).cast("double").alias(f"v{j}") for j, v in enumerate(values)], F.explode(keys).alias("k"))
    sums = [s for j in range(len(values)) for s in (F.avg(f"v{j}").alias(f"mean_{j}"), F.stddev_samp(f"v{j}").alias(f"sd_{j}"))]
    groups = rows.groupBy("k.c", "k.context").agg(F.count(F.lit(1)).alias("n"), *sums).filter(F.col("n") >= config.group_rows)
    return groups


def _group(context: str):
    return F.coalesce(col(context).cast("string"), F.lit("nan"))


def contextual(df: DataFrame, key: str, contexts: list[str], values: list[str], config: Config = DEFAULT) -> DataFrame:
    """``key``, ``context_column``, ``value_column``, ``z`` of the values beyond the limit: one scan for the groups' moments,
    one for the flags of all pairs of columns."""
    contexts, values = contexts[: config.context_columns], values[: config.context_numeric]
    if not contexts or not values:
        return df.select(col(key), F.lit("").alias("context_column"), F.lit("").alias("value_column"), F.lit(0.0).alias("z")).limit(0)
    stats = written(moments(df, contexts, values, config))
    sizes = {r["c"]: r["k"] for r in stats.groupBy("c").agg(F.count(F.lit(1)).alias("k")).collect()}  # a row for each context column
    rows = df.select(col(key), *[_group(c).alias(f"__g{i}") for i, c in enumerate(contexts)], *[col(v).cast("double").alias(f"__v{j}") for j, v in enumerate(values)])
    pairs = []
    for i, c in enumerate(contexts):
        if sizes.get(i, 0) < 2:
            continue
        of = stats.filter(F.col("c") == i).select(F.col("context").alias(f"__g{i}"), F.struct(*[F.col(f"{m}_{j}") for j in range(len(values)) for m in ("mean", "sd")]).alias(f"__s{i}"))
        rows = rows.join(F.broadcast(of) if sum(sizes.values()) <= BROADCAST_GROUPS else of, f"__g{i}", "left")
        for j, v in enumerate(values):
            sd = F.col(f"__s{i}.sd_{j}")
            z = F.abs(F.col(f"__v{j}") - F.col(f"__s{i}.mean_{j}")) / sd
            pairs.append(F.when((sd > 1e-8) & (z > config.context_z), F.struct(F.lit(c).alias("context_column"), F.lit(v).alias("value_column"), F.round(z, 6).alias("z"))))
    if not pairs:
        return contextual(df, key, [], values, config)
    return rows.select(col(key), F.explode(F.array_compact(F.array(*pairs))).alias("f")).select(col(key), "f.*")


def inconsistent(df: DataFrame, column: str) -> DataFrame:
    """``inconsistent_rows``: rows whose value has another spelling."""
    by = df.filter(col(column).isNotNull()).groupBy(spelling(col(column)).alias("s"), col(column).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("inconsistent_rows"))
