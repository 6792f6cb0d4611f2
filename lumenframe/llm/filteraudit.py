"""Filter interaction audit: what each filter removes, in every order of the filters.

Each document becomes a mask, a bit for each filter that it fails. Documents are counted by part
and mask, and the subset-zeta transform turns a part's 2^k counts into the survivors of every set
of filters with k additions to each count. A step of an order then is the difference of the survivors of
two neighbouring sets, for all documents as for the labelled ones. Nothing is evaluated twice,
however many orders there are.

Defined results: a null text is the empty text, a null part the empty part. A text is a repeat if a smaller key
has the same text (by its SHA-256); rows of a null key are no repeats and make none. Repeated rows count as often as they
stand there. Several labels of a key count as one that has what any of them has. An empty table has no parts, so no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: The filters by the order of their bits; the last is the one that looks at other documents.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"


def failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails each of the filters that need no other document: few words, few distinct words, many capitals, symbols."""
    return [
        F.size(words) < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PCT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS_PCT * F.length(text), text.rlike(SYMBOLS)]


def mask_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part``, ``mask`` (bit i: fails filter i), ``n``, ``good`` (labelled quality 1) and ``toxic`` (labelled toxic 1).

    Texts leave their task only as masks and hashes. Equal rows are counted before they meet, and a text's smallest key is matched
    by hash and key, so that neither many copies nor a hot part gather in one task."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("t"))
    worded = base.withColumn("w", F.filter(F.split("t", SPACES), lambda w: w != ""))
    own = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(F.col("t"), F.col("w")))), F.lit(0))
    # hashed where texts are read; only 32 bytes for each text are shuffled
    rows = worded.select("k", "part", own.alias("own"), F.unhex(F.sha2(F.encode("t", "UTF-8"), 256)).alias("h"))
    rows = rows.groupBy("k", "h", "part", "own").agg(F.count(F.lit(1)).alias("c"))
    firsts = rows.groupBy("h").agg(F.min("k").alias("k")).withColumn("first", F.lit(True))
    repeat = F.col("k").isNotNull() & F.col("first").isNull()
    rows = rows.join(firsts, ["h", "k"], "left").select("k", "h", "part", (F.col("own") + F.when(repeat, 1 << len(FILTERS) - 1).otherwise(0)).alias("mask"), "c")
    marked = labels.groupBy(F.col(f"`{key}`").cast("string").alias("on")).agg(F.bool_or(F.col("quality") == 1).alias("g"), F.bool_or(F.col("toxic") == 1).alias("x")).filter("on is not null and (g or x)")
    # null keys have no label; their hash spreads them
    rows = rows.withColumn("on", F.coalesce(F.col("k").cast("string"), F.concat(F.lit("\0"), F.hex("h")))).join(marked, "on", "left")
    return rows.groupBy("part", "mask").agg(F.sum("c").alias("n"), *[F.coalesce(F.sum(F.when(F.col(f), F.col("c"))), F.lit(0)).alias(name) for f, name in (("g", "good"), ("x", "toxic"))])


def survivors(counts: DataFrame, k: int, names: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """A row for each ``part``, with an array for each of ``names``: at place S the documents that pass all filters of the set S.
    A part has at most 2^k masks."""
    full = (1 << k) - 1

    def dense(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.element_at(F.col(c), m), F.lit(0)).cast("bigint")).alias(c)

    def summed(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(c), i.bitwiseXOR(F.lit(bit)))).otherwise(0)).alias(c)

    out = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in names]).select("part", *map(dense, names))
    for i in range(k):
        out = out.select("part", *[summed(c, 1 << i) for c in names])
    # the sums over all subsets of T are those who fail within T only: they pass the filters outside of T
    return out.select("part", *[F.reverse(c).alias(c) for c in names])


def _steps(letters: str) -> Column:
    """Every step of every order: the order, the step's number, the set of filters before it, its filter's bit and place."""
    made = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            made.append(f"named_struct('filter_order', '{''.join(letters[j] for j in order)}', 'step', {step}, 'before', {before}, 'bit', {1 << i}, 'i', {i})")
            before |= 1 << i
    return F.expr(f"array({', '.join(made)})")


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and what the step's filter does there, from mask counts: ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley`` (removed, summed over all orders)."""
    k, full = len(letters), (1 << len(letters)) - 1
    at = lambda c, s: F.get(F.col(c), s if isinstance(s, Column) else F.lit(s))
    rows = survivors(counts, k)
    # so many orders have exactly the set s before a given filter
    weights = [(s, factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in range(full)]
    sums = [sum((F.lit(w) * (at("n", s) - at("n", s | 1 << i)) for s, w in weights if not s >> i & 1), F.lit(0)) for i in range(k)]
    rows = rows.withColumn("sums", F.array(*sums)).withColumn("s", F.explode(_steps(letters))).select("*", "s.*")
    before, after, bit = F.col("before"), F.col("before").bitwiseOR(F.col("bit")), F.col("bit")
    removed = at("n", before) - at("n", after)
    return rows.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), removed.alias("removed"), (at("n", 0) - at("n", bit) - removed).alias("redundant"),
        (at("n", F.lit(full).bitwiseXOR(bit)) - at("n", full)).alias("unique_fails"), *[(at(c, before) - at(c, after)).alias(f"{c}_lost") for c in ("good", "toxic")],
        F.get("sums", F.col("i")).cast("bigint").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    return interactions(mask_counts(docs, labels, key, text, part))
