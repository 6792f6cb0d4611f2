"""The whole analysis of a table: every detector, the score, the suspicious rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import context, geo, models, points, series
from ..session import written
from . import explain

#: Categories by priority, with the types that belong to each.
CATEGORIES = {"time_series": ("spike", "dip", "trend", "seasonal"), "collective": ("collective",), "contextual": ("contextual",), "multivariate": ("multivariate",), "geospatial": ("geospatial",), "point_global": ("point",)}
TYPES = ("point", "contextual", "collective", "multivariate", "geospatial", "spike", "dip", "trend", "seasonal")
ACTIONS = {
    "geospatial": "Check the coordinates against another source.", "spike": "Look at what happened at this time.", "dip": "Look at what happened at this time.",
    "trend": "Look at what changed at this time.", "seasonal": "Compare with the same phase of other seasons.", "contextual": "Compare with the rest of its group.",
    "multivariate": "Check the combination of values.", "collective": "Check the whole run of rows.", "point": "Check the extreme values."}


def scored(df: DataFrame, key: str, numeric: list[str], config: Config = DEFAULT) -> DataFrame:
    """``df`` with filled numbers, point flags, model scores, ``score`` and ``severity``."""
    flags = points.flagged(df, numeric, config)
    judged = models.local_outlier_factor(models.isolation_scores(flags, key, numeric, config), key, numeric, config)
    # Written once: several aggregates follow, and models score each row in Python.
    return models.ensemble(written(judged), config)


KINDS = ("spike", "dip", "trend", "seasonal")


def series_base(df: DataFrame, key: str, numeric: list[str], order: str) -> DataFrame:
    """The numbers of ``df`` by their place (``pos``) in the order of ``order``."""
    return written(series.positioned(df.select(key, order, *[F.col(c).cast("double").alias(c) for c in numeric if c not in (key, order)]), [F.col(order).asc_nulls_last(), F.col(key)]))


def events_of(df: DataFrame, key: str, numeric: list[str], order: str, config: Config = DEFAULT, base: DataFrame | None = None) -> DataFrame:
    """``key``, ``column``, ``kind``, ``pos``, ``value``, ``baseline``, ``deviation``, ``threshold`` of all series anomalies of each
    numeric column (the first ``series_columns``)."""
    n = df.count()
    if n < config.series_rows:
        return df.select(F.col(key), F.lit("").alias("column"), F.lit("").alias("kind"), *[F.lit(0).cast(t).alias(c) for c, t in (("pos", "bigint"), ("value", "double"), ("baseline", "double"), ("deviation", "double"), ("threshold", "double"))]).limit(0)
    base = series_base(df, key, numeric, order) if base is None else base
    columns = [c for c in numeric if c not in (key, order)][: config.series_columns]
    if not columns:
        return events_of(df.limit(0), key, numeric, order, config)
    found = series.Series(base.select("pos", F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in columns]), columns, series.window_size(n), config, config.block_rows).events(KINDS)
    return found.select(F.col(f"`{key}`"), "column", "kind", F.col("pos").cast("bigint").alias("pos"), "value", "baseline", "deviation", "threshold")


def listed(events: DataFrame, numeric: list[str], config: Config = DEFAULT) -> DataFrame:
    """The events that a report lists: at most ``events_per_type`` of a column and kind, ``events`` in all,
    in order of the table's columns, the kinds and the places."""
    capped = events.withColumn("r", F.row_number().over(Window.partitionBy("column", "kind").orderBy("pos"))).filter(F.col("r") <= config.events_per_type).drop("r")
    place = lambda c, names: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return capped.orderBy(place("column", numeric), place("kind", KINDS), "pos").limit(config.events)


#: Rows with marks of other tables that are broadcast to all rows; more are joined by shuffling.
BROADCAST_MARKS = 50_000


def judged(df: DataFrame, key: str, numeric: list[str], order: str | None = None, contexts: list[str] | None = None, coordinates: tuple[str, str] | None = None, config: Config = DEFAULT, events: DataFrame | None = None) -> DataFrame:
    """All rows of ``df``, scored and labelled(). ``events`` is events_of(df), if at hand."""
    return labelled(df, scored(df, key, numeric, config), key, numeric, order, contexts, coordinates, config, events)


def labelled(df: DataFrame, data: DataFrame, key: str, numeric: list[str], order: str | None = None, contexts: list[str] | None = None, coordinates: tuple[str, str] | None = None, config: Config = DEFAULT, events: DataFrame | None = None) -> DataFrame:
    """``data`` (scored rows of the raw table ``df``, whatever models scored them) with ``raw`` (score), ``score`` (to four places), ``severity``,
    ``types`` (array, may be empty), ``category`` (the first by priority), ``categories`` (all), ``affected`` (columns), ``action``, ``methods`` (detectors) and ``why`` (marks with their details).

    What a row's own columns say stays in the row; only marks that come from elsewhere are joined."""

    def mark(rows: DataFrame, kind, columns=None, detail=None) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(F.col(key), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (F.array().cast("array<string>") if columns is None else columns).alias("cols"), (none if detail is None else detail).alias("detail"))

    marks = []
    if contexts:
        marks.append(mark(context.contextual(data, key, contexts, numeric, config), "contextual", F.array(F.col("value_column")), F.concat("value_column", F.lit(" is "), explain.metric(F.col("z")), F.lit(" deviations from the mean of its "), "context_column")))
    if order:
        marks.append(mark(events_of(data, key, numeric, order, config) if events is None else events, F.col("kind"), F.array(F.col("column"))))
    placed = series.positioned(data.select(key, "score", *([order] if order else [])), [*([F.col(order).asc_nulls_last()] if order else []), F.col(key)])
    placed = written(placed)
    runs = series.high_runs(placed, "score", config)
    members = runs.select(F.explode(F.sequence("start_pos", "end_pos")).alias("pos"), "length", "peak")
    marks.append(mark(placed.join(members, "pos"), "collective", detail=F.concat(F.lit("one of "), F.col("length").cast("string"), F.lit(" rows in a row of high score (peak "), explain.metric(F.col("peak")), F.lit(")"))))
    if coordinates:
        said = F.concat(explain.metric(F.col("km")), F.lit(" km from the median place ("), explain.metric(F.col("center_lat")), F.lit(", "), explain.metric(F.col("center_lon")), F.lit("), limit "), explain.metric(F.col("threshold_km")), F.lit(" km ("), explain.metric(F.col("ratio")), F.lit(" times)"))
        marks.append(mark(geo.outliers(df, *coordinates), "geospatial", F.array(*map(F.lit, sorted(coordinates))), said))
    # a row has a mark for each of its types and columns: few, and bounded by the table's columns
    others = written(reduce(DataFrame.union, marks).groupBy(key).agg(F.collect_set("type").alias("__found"), F.collect_set(F.struct("type", "cols", "detail")).alias("why")))
    rows = data.join(F.broadcast(others) if others.count() <= BROADCAST_MARKS else others, key, "left")
    own = F.array_compact(F.array(*[F.when(F.col(t), F.lit(t)) for t in ("point", "multivariate")]))
    rows = rows.withColumn("found", F.concat(own, F.coalesce("__found", F.array().cast("array<string>")))).drop("__found")
    ordered = F.filter(F.array(*[F.lit(t) for t in TYPES]), lambda t: F.array_contains("found", t))
    of_types = {name: F.arrays_overlap(F.array(*map(F.lit, of)), "found") for name, of in CATEGORIES.items()}
    category = F.coalesce(*[F.when(has, name) for name, has in of_types.items()])
    categories = F.array_compact(F.array(*[F.when(has, F.lit(name)) for name, has in of_types.items()]))
    action = F.coalesce(*[F.when(F.array_contains("found", t), text) for t, text in ACTIONS.items()])
    flagged = F.array_compact(F.array(*[F.when(F.col(f"iqr_{i}") | F.col(f"z_{i}"), F.lit(c)) for i, c in enumerate(numeric)]))

    def columns_of(kinds: tuple[str, ...]):
        return F.array_sort(F.flatten(F.transform(F.filter("why", lambda m: m["type"].isin(*kinds)), lambda m: m["cols"])))

    of_marks = [columns_of(kinds) for kinds in (("contextual",), KINDS, ("geospatial",))]
    affected = F.array_distinct(F.concat(flagged, *[F.coalesce(x, F.array().cast("array<string>")) for x in of_marks]))
    strengths = F.array_sort(F.array(*[F.struct(F.col(f"zs_{i}").alias("z"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(numeric)]))
    farthest = F.transform(F.filter(F.slice(strengths, -min(3, len(numeric)), min(3, len(numeric))), lambda x: x["z"] > 0), lambda x: x["c"])
    affected = F.when(F.size(affected) > 0, affected).otherwise(farthest)  # else the three columns farthest out
    return rows.withColumns({"types": ordered, "category": category, "categories": categories, "methods": explain.methods(), "action": action, "affected": affected, "raw": F.col("score"), "score": F.round("score", 4)})


def breakdowns(rows: DataFrame) -> DataFrame:
    """``what`` (type, severity), ``name``, ``n``: the counts over all of labelled() ``rows``, zeros included, in one scan."""
    names = [("type", t, F.array_contains("types", t)) for t in TYPES] + [("severity", s, F.col("severity") == s) for s in ("critical", "high", "medium", "low")]
    wide = rows.agg(*[F.count_if(test).alias(f"n{i}") for i, (_, _, test) in enumerate(names)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(w).alias("what"), F.lit(n).alias("name"), F.col(f"n{i}").alias("n")) for i, (w, n, _) in enumerate(names)])).alias("r")).select("r.*")


def visible(rows: DataFrame) -> DataFrame:
    """The suspicious ones of judged rows: those with a type, and a severity or a type beyond single values."""
    return rows.filter((F.size("types") > 0) & ((F.col("severity") != "low") | (F.size(F.array_except("types", F.array(F.lit("point")))) > 0)))


def suspicious(df: DataFrame, key: str, numeric: list[str], order: str | None = None, contexts: list[str] | None = None, coordinates: tuple[str, str] | None = None, config: Config = DEFAULT, top_n: int | None = None) -> DataFrame:
    """``key``, ``score``, ``severity``, ``category``, ``types``, ``affected`` (columns), ``action``, ``record`` (JSON) of the
    suspicious rows, most suspicious first, ``top_n`` of them (config.top_n; 0: all)."""
    rows = visible(judged(df, key, numeric, order, contexts, coordinates, config))
    out = rows.select(key, "score", "severity", "category", F.array_join("types", ",").alias("types"), "affected", "action")
    first = [F.desc("score"), F.desc(F.size(F.split("types", ","))), F.col(key)]
    n = config.top_n if top_n is None else top_n
    out = out.orderBy(*first).limit(n) if n else out
    # the rows as they stand in the table, not as the detectors fill them
    raw = df.select(key, record_of(df).alias("record"))
    return (raw.join(F.broadcast(out), key) if n else raw.join(out, key)).select(*out.columns, "record").orderBy(*first)


def record_of(df: DataFrame, without: tuple[str, ...] = ()):
    """The row as JSON, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]), {"ignoreNullFields": "false"})
