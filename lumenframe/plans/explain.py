"""What is said of events, rows and groups: figures, sentences, samples.

Sentences are made for rows that a report lists only (bounded by its limits), figures in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scalars import finite, near_zero, ratio
from ..operators.profile import col

#: Groups in the order of a report.
GROUPS = ("point_global", "contextual", "collective", "time_series", "multivariate", "geospatial", "data_quality")
TOP, SAMPLES, REASONS = 6, 8, 3


def metric(x: Column) -> Column:
    """A number for people: fewer places the larger it is; ``n/a`` if null or not finite."""
    d, size = finite(x), F.abs(finite(x))
    places = F.when(size >= 1000, F.format_number(d, 1)).when(size >= 100, F.format_string("%.2f", d)).when(size >= 1, F.format_string("%.3f", d)).when(size >= 0, F.format_string("%.4f", d))
    return F.coalesce(places, F.lit("n/a"))


def percent(x: Column) -> Column:
    return F.when(finite(x).isNull(), "n/a").otherwise(F.format_string("%.2f%%", finite(x)))


def six(x: Column) -> Column:
    return F.round(finite(x), 6)


def share(now: Column, then: Column) -> Column:
    """The change from ``then`` to ``now`` in percent of the size of ``then``; null where that is about zero."""
    size = F.abs(six(then))
    return F.round(F.when(~near_zero(size), 100 * (six(now) - six(then)) / size), 6)


def enriched(listed: DataFrame, base: DataFrame, order: str, numeric: list[str]) -> DataFrame:
    """``listed`` (events, their number bounded by the report's limits) with ``timestamp``, ``prev_timestamp``, ``prev_value``,
    ``delta_from_prev``, ``pct_from_prev``, ``pct_from_baseline``, ``threshold_ratio`` and ``message``. ``base`` has all rows by ``pos``;
    it is scanned for the events' places and those before, not shuffled."""
    at = listed.select("column", "kind", "pos")
    here = base.select("pos", col(order).alias("timestamp")).join(F.broadcast(at), "pos")  # as many as a report lists
    value = F.coalesce(*[F.when(F.col("column") == c, col(c).cast("double")) for c in numeric])
    before = base.withColumn("pos", F.col("pos") + 1).join(F.broadcast(at), "pos").select("column", "kind", "pos", value.alias("prev_value"), col(order).alias("prev_timestamp"))
    e = listed.join(here, ["column", "kind", "pos"]).join(before, ["column", "kind", "pos"], "left")
    e = e.withColumns({
        "threshold_ratio": ratio(F.abs(six(F.col("deviation"))), six(F.col("threshold"))), "pct_from_baseline": share(F.col("value"), F.col("baseline")),
        "delta_from_prev": six(F.col("value") - F.col("prev_value")), "pct_from_prev": share(F.col("value"), F.col("prev_value"))})
    over = F.concat(F.lit("; deviation "), metric(F.col("deviation")), F.lit(" against a limit of "), metric(F.col("threshold")), F.lit(" ("), metric(F.col("threshold_ratio")), F.lit(" times)"))
    from_usual = F.concat(metric(F.col("value")), F.lit(", usual "), metric(F.col("baseline")), F.lit(" ("), percent(F.col("pct_from_baseline")), F.lit(")"))
    said = F.when(F.col("kind") == "spike", F.concat(F.lit(" rose to "), from_usual)).when(F.col("kind") == "dip", F.concat(F.lit(" fell to "), from_usual))
    said = said.when(F.col("kind") == "trend", F.concat(F.lit(" changed by "), metric(F.col("delta_from_prev")), F.lit(", usual step "), metric(F.col("baseline"))))
    said = said.otherwise(F.concat(F.lit(" is "), metric(F.col("value")), F.lit(", a season before "), metric(F.col("baseline")), F.lit(" ("), percent(F.col("pct_from_baseline")), F.lit(")")))
    # a trend's baseline is a step, which a value has no share of
    shares = F.when(F.col("kind") != "trend", F.col("pct_from_baseline"))
    return e.withColumn("message", F.concat(F.col("column"), said, over)).withColumn("pct_from_baseline", shares)


def methods() -> Column:
    """The detectors that speak against a row of models.ensemble()."""
    named = {"iqr_any": "IQR", "z_any": "z-score", "iso_flag": "Isolation Forest", "lof_flag": "Local Outlier Factor"}
    return F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in named.items()]))


def reasons(config: Config = DEFAULT) -> Column:
    """Up to three reasons: of columns (``beyond``), then of the models, the run and the place."""
    def of_column(b: Column) -> Column:
        fence = F.concat(b["column"], F.lit(" = "), metric(b["value"]), F.lit(" outside ["), metric(b["low"]), F.lit(", "), metric(b["high"]), F.lit("]"))
        z = F.concat(F.lit("z-score "), metric(b["z"]), F.lit(f" over {config.z_limit}"))
        alone = F.concat(b["column"], F.lit(" "), z, F.lit(", mean "), metric(b["mean"]), F.lit(", deviation "), metric(b["sd"]))
        return F.when(b["iqr"] & (b["z"] > config.z_limit), F.concat(fence, F.lit(" and "), z)).when(b["iqr"], fence).otherwise(alone)

    alone = F.concat(F.lit("unusual combination of values (isolation "), metric(F.col("iso_norm")), F.lit(", local outlier factor "), metric(F.col("lof_norm")), F.lit(")"))
    others = F.array(F.when(F.array_contains("types", "multivariate"), alone), detail("collective"), detail("geospatial"))
    return F.slice(F.concat(F.transform("beyond", of_column), F.array_compact(others)), 1, REASONS)


def detail(kind: str) -> Column:
    """The first sentence that a detector's mark holds, by alphabet."""
    return F.get(F.array_sort(F.array_compact(F.transform(F.filter("why", lambda m: m["type"] == kind), lambda m: m["detail"]))), 0)


def explanation(time: Column | None = None, time_name: str = "") -> Column:
    """One text of a judged row with ``reasons``; clauses without content are left out."""
    def clause(head: str, text: Column) -> Column:
        return F.when(text.isNotNull() & (text != ""), F.concat(F.lit(f"{head}: "), text, F.lit(".")))

    parts = [
        F.concat(F.lit("Found as "), F.array_join("types", ", "), F.lit(" with score "), metric(F.col("score")), F.lit(" ("), F.col("severity"), F.lit(").")),
        clause("Reasons", F.array_join("reasons", "; ")), clause("Signals", F.array_join("methods", ", ")), clause("Columns", F.array_join(F.slice("affected", 1, 5), ", ")),
        clause("Context", detail("contextual")), clause("Place", detail("geospatial"))]
    if time is not None:
        parts.append(clause(f"Time ({time_name})", time.cast("string")))
    return F.concat_ws(" ", *parts)


def mix_of_groups(found: DataFrame) -> DataFrame:
    """``category``, ``severity``, ``n`` and ``top`` (score)."""
    return found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


def top_of_groups(found: DataFrame, items: str, n: int = TOP) -> DataFrame:
    """``category``, ``item``, ``n``: the most frequent elements of the array ``items`` in each category, ties by name."""
    counts = found.select("category", F.explode(items).alias("item")).groupBy("category", "item").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), "item")  # the table's columns or the types at most
    return counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def samples_of_groups(found: DataFrame, key: str, score: str = "score", n: int = SAMPLES) -> DataFrame:
    """The ``n`` rows of highest score of each category, ties by key; each task keeps only so many before the shuffle."""
    w = Window.partitionBy("category").orderBy(F.desc(score), key)
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def groups(found: DataFrame, key: str, quality: dict[str, int], described) -> list[dict]:
    """The groups of a report, empty ones left out: counts over all of ``found``, with samples that ``described`` explains."""
    mix = mix_of_groups(found).collect()
    tops = {items: top_of_groups(found, items).orderBy(F.desc("n"), "item").collect() for items in ("affected", "types")}
    samples = described(samples_of_groups(found, key)).orderBy(F.desc("score"), key).collect()
    out = []
    for name in GROUPS:
        of = [r for r in mix if r["category"] == name]
        listed = {items: [{"name": r["item"], "count": r["n"]} for r in rows if r["category"] == name] for items, rows in tops.items()}
        if name == "data_quality":
            listed["types"] = [{"name": k, "count": n} for k, n in sorted(quality.items(), key=lambda x: (-x[1], x[0])) if n][:TOP]
        count = sum(quality.values()) if name == "data_quality" else sum(r["n"] for r in of)
        if count:
            out.append({
                "category": name, "count": count, "top_score": max((r["top"] for r in of), default=None), "severity_breakdown": {s: 0 for s in ("critical", "high", "medium", "low")} | {r["severity"]: r["n"] for r in of},
                "top_affected_columns": listed["affected"], "signals": listed["types"],
                "samples": [{"key": r[key], "score": r["score"], "severity": r["severity"], "types": r["types"], "affected_columns": r["affected"], "explanation": r["explanation"]} for r in samples if r["category"] == name]})
    return out
