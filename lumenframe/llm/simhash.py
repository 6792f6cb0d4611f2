"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over the XXH64 hashes of three-word shingles. Two
fingerprints link at ``RADIUS`` or fewer differing bits. Every bit position carries a
non-zero vector of r + 1 bits, and each non-zero vector v gives one table whose mask keeps
the positions with an odd product with v. Up to r differing positions span at most r
dimensions, so some v is orthogonal to all of them: in that table the pair collides. No
linked pair is missed, whatever the data.

Defined results: a null or empty text, or one of white space only, has fingerprint 0 and
links like any other. Null ``doc_id`` values keep their rows; a component of null ids only
has a null id. Repeated rows stay repeated. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, fresh, in_small_batches

RADIUS = 3
SHINGLE_WORDS = 3
#: Buckets up to this size compare their members directly; larger ones go by midpoints.
DIRECT_BUCKET = 1000


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of UTF-8 text as a signed 64-bit integer."""
    tokens = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 65536):  # bounds the unpacked bits of a very long text
        part = zip(starts[lo : lo + 65536], stops[lo : lo + 65536], strict=True)
        h = np.array([digest(joined[i:j], 42) for i, j in part], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            fps = [fingerprint(t.as_py()) for t in texts]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    in_small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables, as signed 64-bit integers."""
    vectors = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, vectors + 1):
        m = sum(1 << i for i in range(64) if bin((i % vectors + 1) & v).count("1") % 2)
        out.append(m - 2**64 if m >= 2**63 else m)
    return out


def _within(a: str, b: str, radius: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def _ball(radius: int) -> list[int]:
    """All patterns of up to ``radius`` set bits, signed."""
    out = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [x - 2**64 if x >= 2**63 else x for x in out]


def links(fps: DataFrame, radius: int = RADIUS, direct: int = DIRECT_BUCKET) -> DataFrame:
    """Edges ``a``, ``b`` whose components are those of all pairs of distinct ``fp`` within
    ``radius``. In buckets of up to ``direct`` members each such pair is an edge; the
    members of larger ones meet at midpoints instead, in a star around each midpoint."""
    table = masks(radius)
    slots = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(table)])
    rows = fps.select("fp", F.explode(slots).alias("s")).select("s.t", "s.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = durable(rows.join(sizes, ["t", "key"]), "buckets")
    small = shared.filter(F.col("n") <= direct)
    a = small.select("t", "key", F.col("fp").alias("a"))
    b = small.select("t", "key", F.col("fp").alias("b"))
    differing = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.lit(False)
    for i, m in enumerate(table):  # a pair is taken in the first of the tables where it collides
        earlier = earlier | ((F.lit(i) < F.col("t")) & (differing.bitwiseAND(F.lit(m)) == 0))
    pairs = a.join(b, ["t", "key"]).filter((F.col("a") < F.col("b")) & _within("a", "b", radius) & ~earlier)
    pairs = pairs.select("a", "b")
    hot = shared.filter(F.col("n") > direct).select("fp").distinct()
    # x and y within r have a z with d(x, z) <= r // 2 and d(y, z) <= r - r // 2; around each
    # z the near ones (r // 2) link to the smallest near one, and so do the far ones.
    near, far = radius // 2, radius - radius // 2
    steps = F.array(*[F.lit(x) for x in _ball(far)])
    reach = hot.select("fp", F.explode(steps).alias("d")).select(
        F.col("fp").bitwiseXOR(F.col("d")).alias("z"), "fp", (F.bit_count("d") <= near).alias("near"))
    centre = reach.filter("near").groupBy("z").agg(F.min("fp").alias("a"))
    stars = reach.join(centre, "z").filter("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key``, ``fp`` (long) and ``component_id`` (the smallest key reachable over links) for
    each row of ``docs``, whatever other columns it has."""
    fps = durable(with_fingerprint(docs, key, text), "fps")
    groups = durable(fps.groupBy("fp").agg(F.min(key).alias("first")), "groups")
    found = components(links(groups.select("fp"), radius))
    rooted = groups.join(found, groups.fp == found.node, "left").select(groups.fp, "first", F.coalesce("root", groups.fp).alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(key, "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each component, in order of key (null keys last) and hash of the text.
    Rows are told apart by key and text, so that a key with several texts keeps each that is
    first in its component; of rows equal in both, one stays."""
    version, row, kept_version = (fresh(docs, n) for n in ("version", "rid", "kept_version"))
    marked = docs.withColumn(version, F.xxhash64(F.col(text).cast("string")))
    found = near_duplicates(marked, version, text).select(version, "component_id").distinct()
    lowest = marked.groupBy(version).agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))).alias("low"))
    kept = lowest.join(found, version).groupBy("component_id").agg(F.min(F.struct("low.none", "low.key", F.col(version).alias("version"))).alias("c"))
    kept = kept.select(F.col("c.key").alias(row), F.col("c.version").alias(kept_version))
    return marked.join(kept, marked[key].eqNullSafe(kept[row]) & (marked[version] == kept[kept_version]), "left_semi").dropDuplicates([key, version]).drop(version)
