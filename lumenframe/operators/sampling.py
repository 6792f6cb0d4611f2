"""Bounded samples that don't depend on partitioning, and what they say of the whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from .profile import _plain, col


def hash_sample(df: DataFrame, key: str, n: int, seed: int = DEFAULT.seed) -> DataFrame:
    """``n`` rows, uniform and the same however the table is partitioned."""
    mixed, count = F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}")).cast("binary")), df.count()
    if count > 8 * n:
        # Only hashes that low can be among the n smallest: about 4 n of them, so that no task sorts
        # n rows of each partition. Fewer than n by chance is all but impossible; then all rows are sorted.
        low = df.filter(mixed < f"{int(4 * n / count * 2**64):016x}")
        df = low if low.count() >= n else df
    return df.orderBy(mixed, col(key)).limit(n)


#: Standard errors of an interval: 99 of 100 hold the true number.
ERRORS = 2.576


def scaled(hits: int, sampled: int, rows: int) -> tuple[int, int, int]:
    """The number of ``rows`` that ``hits`` of ``sampled`` uniform ones stand for, with the ends of its interval (Wilson's, for a finite
    table). A whole sample is exact."""
    if sampled >= rows:
        return hits, hits, hits
    share, left = hits / sampled, 1 - sampled / rows
    z2 = ERRORS**2 * left / sampled
    middle, half = (share + z2 / 2) / (1 + z2), math.sqrt(z2 * share * (1 - share) + z2 * z2 / 4) / (1 + z2)
    low, high = max(hits, math.floor(rows * (middle - half))), min(rows - sampled + hits, math.ceil(rows * (middle + half)))
    return round(share * rows), low, max(low, high)


def scaled_duplicates(df: DataFrame, rows: int, sampled: int) -> tuple[int, int, int]:
    """Rows beyond the first of each kind, from all copies of a sample of kinds: rows are chosen by the hash of what they hold, so
    a kind is in the sample whole or not at all, and only kinds are scaled. A sample of rows would part the copies."""
    share = min(1.0, sampled / max(1, rows))
    names = _plain(df)
    kept = df.select(F.xxhash64(F.lit(11), *map(col, names)).alias("a"), F.xxhash64(F.lit(12), *map(col, names)).alias("b"))
    kept = kept.filter(F.lit(share >= 1.0) | (F.pmod("a", F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))))
    got = kept.groupBy("a", "b").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0)).alias("q")).first()
    if share >= 1.0:
        return got["n"], got["n"], got["n"]
    half = ERRORS * math.sqrt(got["q"] * (1 - share)) / share
    return min(rows, round(got["n"] / share)), max(got["n"], math.floor(got["n"] / share - half)), min(rows, math.ceil(got["n"] / share + half + ERRORS**2 / share * (got["n"] == 0)))
