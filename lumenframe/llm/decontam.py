"""Benchmark decontamination: size-partitioned MinHash containment search.

A benchmark item is contaminated by a document that holds at least ``THRESHOLD`` of the
item's distinct five-word shingles. Items are partitioned by their number of shingles in
powers of two. An item's sketch is its m smallest shingle hashes (its bottom MinHash values),
with m one more than the shingles that an item of the partition's largest size may miss. A
document that reaches the threshold misses fewer than m of them, so it holds at least one
value of the sketch, however long it is: documents are searched with all their shingles,
and no pair that reaches the threshold is lost. Each candidate pair is then verified by the
exact containment of the item's shingles, as text.

Words are maximal runs of letters and digits, lower-cased. Defined results: null and empty
texts, and items and documents of fewer than five words, have no shingles and match nothing.
Repeated rows count once; a key with several texts is judged by each of them. Copies of an
item under other keys are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh

THRESHOLD = 0.8
WORDS = 5
#: A sketch table up to this many bytes is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 32 << 20
#: So many keys of contaminated documents are broadcast; more are joined by shuffling.
BROADCAST_KEYS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words, as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_texts(tokens: Column, n: int = WORDS) -> Column:
    """Distinct n-word shingles, as texts."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def _hash_at(hashes: str, at: Column, n: int) -> Column:
    """Hash of the n words from 0-based place ``at`` on, from the words' hashes."""
    return F.xxhash64(*[F.get(F.col(hashes), at + k) for k in range(n)])


def _with_hashes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))


def sketches(items: DataFrame, key: str, text: str, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """For each value of an item's sketch: ``item`` (the key), ``item_version`` (hash of the
    words, as one key can have several texts), ``item_words`` (array), ``item_size`` and ``value``."""
    rows = _with_hashes(items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") >= n))
    hashes = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: _hash_at("wh", i, n))
    rows = rows.select("item", F.xxhash64("w").alias("item_version"), F.col("w").alias("item_words"), F.array_sort(F.array_distinct(hashes)).alias("values"))
    size = F.size("values")
    largest = F.pow(F.lit(2.0), F.ceil(F.log2(size)))  # of the item's partition
    width = (F.floor(largest * F.lit(1 - threshold) + F.lit(1e-9)) + 1).cast("int")
    return rows.dropDuplicates(["item", "item_version"]).withColumn("item_size", size).select(
        "item", "item_version", "item_words", "item_size", F.explode(F.slice("values", F.lit(1), width)).alias("value"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 threshold: float = THRESHOLD, n: int = WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``key``, ``item_key``, ``shared`` and ``item_size`` (numbers of distinct shingles) for each
    pair that reaches the threshold; rows with a null key are left out."""
    sketch = sketches(items.filter(F.col(item_key).isNotNull()), item_key, item_text, threshold, n)
    held = sketch.agg(F.coalesce(F.sum(F.size("item_words") * 32 + 64), F.lit(0)).alias("b")).first()["b"]
    texts = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), words(F.col(text)).alias("w")).withColumn("doc_version", F.xxhash64("w"))
    probe = _with_hashes(texts).select(
        "doc", "doc_version", "w", "wh", F.posexplode(F.slice(F.col("wh"), F.lit(1), F.greatest(F.size("wh") - (n - 1), F.lit(0)))).alias("at", "first_hash"))
    pair = ["doc", "doc_version", "item", "item_version"]
    if held <= broadcast_bytes:  # only hits leave the scan, with their words
        probe = probe.select("doc", "doc_version", "w", _hash_at("wh", F.col("at"), n).alias("value"))
        pairs = probe.join(F.broadcast(sketch), "value").groupBy(*pair).agg(F.first("w").alias("w"), F.first("item_words").alias("item_words"))
    else:
        probe = probe.select("doc", "doc_version", _hash_at("wh", F.col("at"), n).alias("value"))
        hits = probe.join(sketch.select("item", "item_version", "value"), "value").select(*pair).distinct()
        item_words = sketch.select("item", "item_version", "item_words").dropDuplicates(["item", "item_version"])
        pairs = hits.join(texts.dropDuplicates(["doc", "doc_version"]), ["doc", "doc_version"]).join(item_words, ["item", "item_version"])
    held_by_both = F.size(F.array_intersect(shingle_texts(F.col("item_words"), n), shingle_texts(F.col("w"), n)))
    counted = pairs.select("doc", "item", held_by_both.cast("bigint").alias("shared"), F.size(shingle_texts(F.col("item_words"), n)).cast("bigint").alias("item_size"))
    found = counted.filter(F.col("shared") >= F.lit(threshold) * F.col("item_size") - 1e-9).distinct()
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), "shared", "item_size")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contaminate no item. Each row is judged by its own text,
    whatever its ``key``, also if that is null."""
    bad = fresh(docs, "bad")
    version = F.xxhash64(F.col(text).cast("string"))
    texts = docs.select(version.alias("version"), F.col(text).alias("text"))
    found = durable(contaminated(texts, items, "version", "text", **options).select(F.col("version").alias(bad)).distinct(), "contaminated")
    if found.count() <= BROADCAST_KEYS:  # else the texts are shuffled to meet the keys
        found = F.broadcast(found)
    return docs.join(found, version == found[bad], "left_anti")
