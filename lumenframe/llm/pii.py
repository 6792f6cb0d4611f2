"""Personal data: patterns, and information-theoretic sanitisation of what reveals them.

The protected entities are the values that the patterns find (mail and network addresses,
card and phone numbers). How strongly a term reveals an entity is estimated from the
whole corpus: a term's occurrence within ``NEAR`` words of a mention, on the mention's line, is a
co-occurrence. With n(t) occurrences of the term, n(t,c) of them near entity c, n(c) word
places near c and N words in all, the disclosure is PMI(t;c) / IC(c), that is
``log2(n(t,c) N / (n(t) n(c))) / log2(N / n(c))``: 1 if the term occurs near c alone, 0 if it
is independent of c. Terms of at least ``GENERALISE`` are generalised (a class of words stands for
them: name, acronym, code or term), of at least ``REMOVE`` removed, wherever they occur. The estimate counts only if term and
entity meet in different documents: a meeting's context is the word of least hash in the rest of
its document (where nothing is left, the term's neighbours), and the contexts' effective number, ``n^2 / sum(n_i^2)``,
must reach ``CONTEXTS``. Copies of a document have one context, and near copies, which have most of their words
in common, mostly the same; a signature under different documents has many.

DataFrame functions only. Defined results: null and empty texts have no spans. Spans are in
code points, the end exclusive. A term's span that meets a pattern's span is left out.
Patterns use possessive repeats, which match the same and need no deep stack on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalised", "removed")
LOCAL = "A-Za-z0-9._%+-"
#: The patterns of the four kinds. A run that fails at its first character fails
#: at the others, so a match begins where the last one ended or where a run begins.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched for the kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{N}]+"

NEAR = 8
CONTEXTS = 3.0
#: So many of a document's word hashes, the least, are kept; a mention and what is near it cover fewer.
LEAST = 64
GENERALISE, REMOVE = 0.8, 0.95
#: A table of terms up to this many rows is broadcast, a larger one joined by shuffling.
BROADCAST_ROWS = 200_000
_STEP = 128


def cumulated(sizes: Column) -> Column:
    """Running sums of an array, in blocks, so that long arrays aren't copied at each step."""
    zero = F.array().cast("array<int>")

    def sums(a: Column) -> Column:
        return F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x).cast("int"))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _STEP).cast("int")), lambda b: F.slice(sizes, b * _STEP + 1, _STEP))
    inner = F.transform(blocks, sums)
    ends = sums(F.transform(inner, lambda a: F.try_element_at(a, F.lit(-1))))
    before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(inner, before, lambda a, o: F.transform(a, lambda x: x + o)))).otherwise(zero)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255, 3).otherwise(2))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def normalised(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind == "email" else value if kind == "ip" else _digits(value))


def spans_of(text: Column, kind: str) -> Column:
    """Array of ``(kind, start, end, value)`` of the valid matches, in order."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    ends = cumulated(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
    spans = F.zip_with(found, ends, lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, F.filter(spans, lambda s: valid(kind, s["value"]))).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by kind as listed, then start; empty for null texts."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(*[spans_of(text, k) for k in KINDS])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _mentions(text: Column, kind: str) -> Column:
    """Array of ``(entity, left, right)``: the words before and after each valid match, on its line."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)

    def mention(m: Column, i: Column) -> Column:
        left = _words(F.substring_index(F.get(gaps, i), "\n", -1))
        right = _words(F.substring_index(F.get(gaps, i + 1), "\n", 1))
        left = F.slice(left, F.greatest(F.size(left) - (NEAR - 1), F.lit(1)), F.lit(NEAR))
        return F.struct(normalised(kind, m).alias("entity"), left.alias("left"), F.slice(right, F.lit(1), F.lit(NEAR)).alias("right"), _words(m).alias("own"), valid(kind, m).alias("valid"))

    none = F.array().cast("array<struct<entity:string,left:array<string>,right:array<string>,own:array<string>,valid:boolean>>")
    hint = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, F.filter(F.transform(found, mention), lambda s: s["valid"])).otherwise(none)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def disclosing_terms(docs: DataFrame, text: str = "text", contexts: float = CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``term``, ``disclosure`` (the highest over all entities) and ``action`` of the terms that
    reveal a protected entity, from all of ``docs``."""
    spark = docs.sparkSession
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"))
    near = texts.filter(F.col("t").rlike("[0-9@]")).select("t", F.concat(*[_mentions(F.col("t"), k) for k in KINDS]).alias("m")).filter(F.size("m") > 0)
    least = F.slice(F.array_sort(F.array_distinct(F.transform(_words(F.col("t")), lambda w: F.xxhash64(w)))), 1, LEAST)
    near = near.select("m", least.alias("least")).select(F.explode("m").alias("m"), "least")
    around = F.transform(F.concat("m.left", "m.right", "m.own"), lambda w: F.xxhash64(w))
    near = near.select("m", F.get(F.array_except("least", around), 0).alias("rest"))

    def placed(words: str) -> Column:
        w = F.col(words)
        return F.transform(w, lambda x, i: F.struct(x.alias("term"), F.coalesce("rest", F.xxhash64(F.get(w, i - 1), F.get(w, i + 1))).alias("context")))

    pairs = near.select("m.entity", F.explode(F.concat(placed("m.left"), placed("m.right"))).alias("p")).select("entity", "p.term", "p.context")
    met = pairs.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    met = durable(met.groupBy("entity", "term").agg(n.alias("n_tc"), (n.cast("double") * n / F.sum(F.col("n").cast("double") * F.col("n"))).alias("contexts")), "met")
    word = F.col("term").rlike(r"\p{L}") & (F.length("term") >= 3)
    likely = met.filter(word & (F.col("contexts") >= contexts - 1e-9))
    terms = durable(likely.select("term").distinct(), "terms")
    if terms.isEmpty():
        return spark.createDataFrame([], "term string, disclosure double, action string")
    places = met.groupBy("entity").agg(F.sum("n_tc").alias("n_c"))
    total = texts.agg(F.sum(F.size(_words(F.col("t"))))).first()[0]
    counts = texts.select(F.explode(_words(F.col("t"))).alias("term")).join(_small(terms, broadcast_rows), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    measured = likely.join(counts, "term").join(places, "entity")
    share = F.least(F.col("n_tc") / F.col("n_t"), F.lit(1.0))
    known = F.greatest(F.log2(F.lit(float(total)) / F.col("n_c")), F.lit(1e-9))
    measured = measured.groupBy("term").agg(F.max(1 + F.log2(share) / known).alias("disclosure"))
    return durable(measured.filter(F.col("disclosure") >= generalise).withColumn("action", F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised")), "disclosing")


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: str = "spans", broadcast_rows: int = BROADCAST_ROWS, **thresholds) -> DataFrame:
    """All rows and columns of ``docs`` and ``spans``: array of ``(kind, start, end, value)`` by
    kind (the patterns', then ``generalised`` and ``removed`` terms), then start."""
    terms = disclosing_terms(docs, text, broadcast_rows=broadcast_rows, **thresholds)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != spans.lower()]
    if terms.isEmpty():
        return docs.select(*rest, base_spans(t).alias(spans))
    hit_key, version, found = (fresh(docs, x) for x in ("hit_key", "hit_version", "hit_terms"))
    words = docs.select(F.col(f"`{key}`").alias(hit_key), F.xxhash64(t).alias(version), F.explode(F.array_distinct(_words(t))).alias("term"))
    hits = words.join(_small(terms, broadcast_rows), "term").groupBy(hit_key, version).agg(F.collect_set(F.struct("term", "action")).alias(found))
    hits = _small(durable(hits, "hits"), broadcast_rows)  # else the texts are shuffled to meet them
    joined = docs.join(hits, docs[key].eqNullSafe(hits[hit_key]) & (F.xxhash64(t) == hits[version]), "left")
    base = fresh(docs, "base_found")
    joined = joined.withColumn(base, base_spans(t))

    def of(action: str) -> Column:
        names = F.transform(F.filter(F.col(found), lambda h: h["action"] == action), lambda h: h["term"])
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        hit = F.regexp_extract_all(t, pattern, F.lit(0))
        gaps = F.slice(F.split(t, pattern, -1), F.lit(1), F.size(hit))
        ends = cumulated(F.zip_with(gaps, hit, lambda g, m: F.length(g) + F.length(m)))
        made = F.zip_with(hit, ends, lambda m, e: F.struct(F.lit(action).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        apart = F.filter(made, lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
        return F.when(F.size(names) > 0, apart).otherwise(none)

    return joined.select(*rest, F.concat(F.col(base), *[of(a) for a in ACTIONS]).alias(spans))


def general(term: Column) -> Column:
    """The class of words that stands for a term."""
    return F.when(term.rlike(r"\p{N}"), "[code]").when(term.rlike(r"^\p{Lu}{2,}$"), "[acronym]").when(term.rlike(r"^\p{Lu}"), "[name]").otherwise("[term]")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with the spans' values replaced: ``[kind]`` for personal data, the class of
    generalised terms (``[code]`` with digits, ``[acronym]``, ``[name]`` with a capital, else ``[term]``), nothing for removed ones. Of spans that overlap, the first goes."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", general(s["value"])).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        moved = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(between, put)).alias("parts"))
        return F.when(s["start"] >= acc["at"], moved).otherwise(acc)

    done = F.aggregate(order, start, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
