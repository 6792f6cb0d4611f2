"""Queries over the analysis as a whole, with given model columns in place of trained ones, so that SQL can say the rest: votes, scores,
types, categories, affected columns, methods, actions, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import models, points, quality, series
from ..session import written
from . import analysis, explain
from .registry import query
from .views import DIRTY_ORDERS, dirty_orders, seasonal_values, table

COLUMNS = ["user_id", "value", "load"]
#: A lower floor of collective runs, as given scores seldom reach the usual one.
CONFIG = Config(run_floor=0.3)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a seasonal column beside theirs."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.col("user_id").cast("double").alias("user_id"), "value", seasonal_values(k).cast("double").alias("load"))


def _modelled(raw: DataFrame) -> DataFrame:
    k = F.col("event_id")
    iso = F.when((k % 400).between(10, 16), 0.9).otherwise(0.3 + (k % 97) / 413)
    lof = F.when((k % 400).between(8, 15), 2.5).otherwise(1 + (k % 53) / 211)
    return models.ensemble(written(points.flagged(raw, COLUMNS).withColumns({"iso_score": iso, "lof": lof})))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return analysis.labelled(raw, _modelled(raw), "event_id", COLUMNS, "ts", ["event_type"], None, CONFIG)


def _sql() -> str:
    every = COLUMNS
    stats = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}, avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in every)
    flags = ", ".join(f"(b_{c} - a_{c} > 1e-8 AND ({c} < a_{c} - 1.5 * (b_{c} - a_{c}) OR {c} > b_{c} + 1.5 * (b_{c} - a_{c}))) AS q_{c}, abs({c} - m_{c}) / s_{c} AS z_{c}" for c in every)
    scale = lambda x: f"CASE WHEN abs({x}1 - {x}0) <= 1e-8 + 1e-5 * abs({x}0) THEN 0.0::DOUBLE ELSE ({x} - {x}0) / ({x}1 - {x}0) END"
    parts = [
        """ev AS (SELECT event_id, ts, event_type, user_id::DOUBLE AS user_id, value, ((event_id % 24) * 10 + CASE WHEN event_id % 1777 = 100 THEN 500 ELSE 0 END)::DOUBLE AS load,
 CASE WHEN event_id % 400 BETWEEN 10 AND 16 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE + (event_id % 97) / 413.0::DOUBLE END AS iso, CASE WHEN event_id % 400 BETWEEN 8 AND 15 THEN 2.5::DOUBLE ELSE 1::DOUBLE + (event_id % 53) / 211.0::DOUBLE END AS lof,
 row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, least(31, greatest(7, count(*) OVER () // 40))::BIGINT AS w FROM events)""",
        f"st AS (SELECT {stats}, min(iso) AS iso0, max(iso) AS iso1, min(lof) AS lof0, max(lof) AS lof1 FROM ev)", f"fl AS (SELECT ev.*, {flags}, {scale('iso')} AS iso_norm, {scale('lof')} AS lof_norm FROM ev, st)",
        f"""f2 AS (SELECT *, ({' + '.join(f'q_{c}::INT' for c in every)}) / 3.0::DOUBLE AS iqr_ratio, least(greatest({', '.join(f'z_{c}' for c in every)}) / 3.0::DOUBLE, 1.0::DOUBLE) AS z_peak, {' OR '.join(f'q_{c}' for c in every)} AS iqr_any,
 {' OR '.join(f'z_{c} > 3' for c in every)} AS z_any, iso > 0.5 AS iso_flag, lof > 1.5 AS lof_flag FROM fl)""",
        "f3 AS (SELECT *, (iqr_any::INT + z_any::INT + iso_flag::INT + lof_flag::INT) / 4.0::DOUBLE AS votes, (iso_flag AND lof_flag) OR iso_norm > 0.8 AS multi FROM f2)",
        """sc AS (SELECT *, least(greatest(0.36::DOUBLE * votes + 0.2::DOUBLE * iqr_ratio + 0.2::DOUBLE * z_peak + 0.14::DOUBLE * iso_norm + 0.1::DOUBLE * lof_norm, 0), 1) AS raw FROM f3)""",
        "sv AS (SELECT *, CASE WHEN raw >= 0.8 THEN 'critical' WHEN raw >= 0.6 THEN 'high' WHEN raw >= 0.35 THEN 'medium' ELSE 'low' END AS severity FROM sc)",
        "lim AS (SELECT greatest(0.3::DOUBLE, quantile_cont(raw, 0.9)) AS t FROM sv)", "hi AS (SELECT pos, event_id, pos - row_number() OVER (ORDER BY pos) AS island FROM sv, lim WHERE raw >= t)",
        "co AS (SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY island) AS k FROM hi) WHERE k >= 3)"]
    frame = "OVER (ORDER BY pos ROWS BETWEEN w // 2 PRECEDING AND (w - 1) // 2 FOLLOWING)"
    ctx, ser = [], []
    for c in every:
        parts += [
            f"g_{c} AS (SELECT event_type, avg({c}) AS m, stddev_samp({c}) AS s FROM ev GROUP BY event_type HAVING count(*) >= 8)",
            f"r1_{c} AS (SELECT event_id, pos, w, {c} AS x, coalesce({c} - lag({c}) OVER (ORDER BY pos), 0) AS d, lag({c}, 24) OVER (ORDER BY pos) AS before FROM ev)",
            f"r2_{c} AS (SELECT *, median(x) {frame} AS med, median(d) {frame} AS dmed FROM r1_{c})", f"r3_{c} AS (SELECT *, median(abs(x - med)) {frame} AS mad, median(abs(d - dmed)) {frame} AS dmad FROM r2_{c})",
            f"sd_{c} AS (SELECT stddev_pop(x) AS xs, stddev_pop(d) AS ds FROM r1_{c})"]
        ctx.append(f"SELECT event_id, '{c}' AS c FROM ev JOIN g_{c} USING (event_type) WHERE s > 1e-8 AND abs({c} - m) / s > 3.2 AND (SELECT count(*) FROM g_{c}) >= 2")
        ser += [
            f"SELECT event_id, '{c}' AS c, CASE WHEN x > med THEN 'spike' ELSE 'dip' END AS kind FROM r3_{c}, sd_{c} WHERE abs(x - med) > greatest(6 * mad, 1.5 * xs)",
            f"SELECT event_id, '{c}', 'trend' FROM r3_{c}, sd_{c} WHERE abs(d - dmed) > greatest(6 * dmad, 2 * ds) AND pos > greatest(2, w // 3)"]
    parts += [  # of the three columns only this one has a season, of 24 rows
        "se1 AS (SELECT event_id, abs(x - before) AS dev FROM r1_load WHERE before IS NOT NULL)", "se2 AS (SELECT median(dev) AS m, stddev_pop(dev) AS s FROM se1)", "se3 AS (SELECT median(abs(dev - m)) AS mad FROM se1, se2)"]
    ser.append("SELECT event_id, 'load', 'seasonal' FROM se1, se2, se3 WHERE dev > greatest(m + 6 * mad, 2.5 * s)")
    parts += ["cx AS (" + " UNION ALL ".join(ctx) + ")", "sr AS (" + " UNION ALL ".join(ser) + ")"]
    kinds = ("spike", "dip", "trend", "seasonal")
    parts.append("mk AS (SELECT event_id, " + ", ".join([*(f"bool_or(c = '{c}') AS x_{c}" for c in every)]) + " FROM cx GROUP BY event_id)")
    parts.append("ms AS (SELECT event_id, " + ", ".join([*(f"bool_or(c = '{c}') AS s_{c}" for c in every), *(f"bool_or(kind = '{k}') AS is_{k}" for k in kinds)]) + " FROM sr GROUP BY event_id)")
    no = lambda x: f"coalesce({x}, false)"
    parts.append("al AS (SELECT sv.*, iqr_any OR z_any AS point, " + ", ".join([*(f"{no(f'x_{c}')} AS x_{c}, {no(f's_{c}')} AS s_{c}, q_{c} OR z_{c} > 3 AS f_{c}" for c in every), *(f"{no(f'is_{k}')} AS is_{k}" for k in kinds)]) + f", {no('mk.event_id IS NOT NULL')} AS ctx, co.event_id IS NOT NULL AS coll FROM sv LEFT JOIN mk USING (event_id) LEFT JOIN ms USING (event_id) LEFT JOIN co USING (event_id))")
    has = {"point": "point", "contextual": "ctx", "collective": "coll", "multivariate": "multi", "spike": "is_spike", "dip": "is_dip", "trend": "is_trend", "seasonal": "is_seasonal"}
    joined = lambda pairs: "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs) + ")"
    of = {name: " OR ".join(has[t] for t in types if t in has) or "false" for name, types in analysis.CATEGORIES.items()}
    ordered = sorted(every)
    affected = [*((c, f"f_{c}") for c in every), *((c, f"x_{c} AND NOT f_{c}") for c in ordered), *((c, f"s_{c} AND NOT f_{c} AND NOT x_{c}") for c in ordered)]
    farthest = "array_to_string(list_transform(list_filter(list_sort([" + ", ".join(f"{{'z': z_{c}, 'i': {i}, 'c': '{c}'}}" for i, c in enumerate(every)) + "]), lambda y: y.z > 0), lambda y: y.c), ',')"
    chosen = lambda pairs: "CASE " + " ".join(f"WHEN {cond} THEN '{text}'" for text, cond in pairs) + " END"
    named = {"IQR": "iqr_any", "z-score": "z_any", "Isolation Forest": "iso_flag", "Local Outlier Factor": "lof_flag"}
    parts.append(f"""j AS (SELECT event_id, raw, round(raw, 4) AS score, severity, {joined((t, has[t]) for t in analysis.TYPES if t in has)} AS types, {chosen((n, c) for n, c in of.items())} AS category, {joined(of.items())} AS categories,
 CASE WHEN {joined(affected)} <> '' THEN {joined(affected)} ELSE {farthest} END AS affected, {joined(named.items())} AS methods, {chosen((text, has[t]) for t, text in analysis.ACTIONS.items() if t in has)} AS action FROM al)""")
    parts.append("v AS (SELECT * FROM j WHERE types <> '' AND (severity <> 'low' OR types <> 'point'))")
    return "WITH " + ", ".join(parts) + " "


PATH = _sql()


def _texts(rows: DataFrame) -> DataFrame:
    joined = [F.array_join(c, ",").alias(c) for c in ("types", "categories", "affected", "methods")]
    return rows.select("event_id", "score", "severity", "category", "action", *joined)


@query(PATH + "SELECT event_id, votes, round(iso_norm, 6) AS iso_norm, round(lof_norm, 6) AS lof_norm, round(raw, 6) AS score, severity, multi AS multivariate FROM sv")
def model_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, scaled model scores, the ensemble's score and severity, and the multivariate flag of every row."""
    return _modelled(_raw(spark, sf_dir)).select("event_id", "votes", F.round("iso_norm", 6).alias("iso_norm"), F.round("lof_norm", 6).alias("lof_norm"), F.round("score", 6).alias("score"), "severity", "multivariate")


@query(PATH + "SELECT event_id, score, severity, types, category, categories, affected, methods, action FROM j")
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its types, categories, affected columns, detectors and action."""
    return _texts(_labelled(spark, sf_dir))


@query(PATH + "SELECT event_id, score, severity, types, category, affected, action FROM v ORDER BY score DESC, len(string_split(types, ',')) DESC, event_id LIMIT 100")
def suspicious_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's list: visible rows, most suspicious first."""
    rows = analysis.visible(_labelled(spark, sf_dir)).orderBy(F.desc("score"), F.desc(F.size("types")), "event_id").limit(CONFIG.top_n)
    return _texts(rows).drop("categories", "methods")


@query(PATH + "SELECT * FROM (SELECT 'type' AS what, unnest(string_split(types, ',')) AS name, count(*) AS n FROM j WHERE types <> '' GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM j GROUP BY severity)")
def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each type and severity, over all rows."""
    return analysis.breakdowns(written(_labelled(spark, sf_dir))).filter("n > 0")


@query(PATH + "SELECT event_id, round(raw, 6) AS raw FROM j ORDER BY raw DESC, event_id LIMIT 400")
def score_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _modelled(_raw(spark, sf_dir)).orderBy(F.desc("score"), "event_id").limit(400)
    return rows.select("event_id", F.round("score", 6).alias("raw"))


@query(PATH + "SELECT category, severity, count(*) AS n, max(score) AS top FROM v GROUP BY category, severity")
def group_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.mix_of_groups(analysis.visible(_labelled(spark, sf_dir)))


_TOP = "SELECT category, item, n FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, item) AS r FROM (SELECT category, unnest(string_split({0}, ',')) AS item, count(*) AS n FROM v WHERE {0} <> '' GROUP BY 1, 2)) WHERE r <= 6"


@query(PATH + _TOP.format("affected"))
def group_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most affected columns of each category."""
    return explain.top_of_groups(analysis.visible(_labelled(spark, sf_dir)), "affected")


@query(PATH + _TOP.format("types"))
def group_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent types of each category."""
    return explain.top_of_groups(analysis.visible(_labelled(spark, sf_dir)), "types")


@query(PATH + "SELECT category, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, event_id) AS r FROM v) WHERE r <= 8")
def group_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rows of highest score of each category."""
    return explain.samples_of_groups(analysis.visible(_labelled(spark, sf_dir)), "event_id").select("category", "event_id", "score")


_FIGURES = """, e1 AS (SELECT event_id, pos, 'trend' AS kind, x, dmed AS base, abs(d - dmed) AS dev, greatest(6 * dmad, 2 * ds) AS lim FROM r3_load, sd_load WHERE abs(d - dmed) > greatest(6 * dmad, 2 * ds) AND pos > greatest(2, w // 3)
 UNION ALL SELECT event_id, pos, 'seasonal', x, before, abs(x - before), greatest(m + 6 * mad_, 2.5 * s) FROM r1_load, se2, (SELECT mad AS mad_ FROM se3) WHERE before IS NOT NULL AND abs(x - before) > greatest(m + 6 * mad_, 2.5 * s)),
e2 AS (SELECT e1.*, p.x AS prev, row_number() OVER (PARTITION BY kind ORDER BY e1.pos) AS r FROM e1 LEFT JOIN r1_load p ON p.pos = e1.pos - 1)
SELECT event_id, kind, round(x, 6) AS value, round(base, 6) AS baseline, round(round(dev, 6) / nullif(round(lim, 6), 0), 6) AS threshold_ratio, CASE WHEN kind <> 'trend' THEN round(100 * (round(x, 6) - round(base, 6)) / nullif(abs(round(base, 6)), 0), 6) END AS pct_from_baseline,
 round(prev, 6) AS prev_value, round(x - prev, 6) AS delta_from_prev, round(100 * (round(x, 6) - round(prev, 6)) / nullif(abs(round(prev, 6)), 0), 6) AS pct_from_prev FROM e2 WHERE r <= 120"""


@query(PATH.rstrip() + _FIGURES)
def trend_and_season_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed trend changes and seasonal breaks of the seasonal column, with their figures."""
    base = analysis.series_base(_raw(spark, sf_dir), "event_id", COLUMNS, "ts")
    found = series.Series(base.select("pos", "event_id", "load"), ["load"], series.window_size(base.count())).events(("trend", "seasonal"))
    told = explain.enriched(written(analysis.listed(found, COLUMNS)), base, "ts", ["load"])
    return told.select("event_id", "kind", *[F.round(c, 6).alias(c) for c in ("value", "baseline", "prev_value")], "threshold_ratio", "pct_from_baseline", "delta_from_prev", "pct_from_prev")


def _placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return dirty_orders(spark, sf_dir).withColumns({
        "latitude": F.when(k % 103 == 0, None).when(k % 101 == 0, 95.0).otherwise(40 + (k % 97) / 1000), "longitude": F.when(k % 107 == 0, None).when(k % 109 == 0, 190.0).otherwise(-74 + (k % 89) / 1000),
        "steep": F.pow((k % 50).cast("double"), F.lit(4.0))})


PLACED = DIRTY_ORDERS + """, po AS (SELECT *, CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 95.0::DOUBLE ELSE 40 + (o_orderkey % 97) / 1000.0::DOUBLE END AS a,
 CASE WHEN o_orderkey % 107 = 0 THEN NULL WHEN o_orderkey % 109 = 0 THEN 190.0::DOUBLE ELSE -74 + (o_orderkey % 89) / 1000.0::DOUBLE END AS o, pow((o_orderkey % 50)::DOUBLE, 4) AS steep FROM dirty_orders),
pq AS (SELECT *, a IS NOT NULL AND o IS NOT NULL AND NOT (a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180) AS bad FROM po),
sk AS (SELECT c, abs(s) > 1 AS steep FROM (SELECT unnest(['item_qty', 'disc_pct', 'steep']) AS c, unnest([skewness(item_qty), skewness(disc_pct), skewness(steep)]) AS s FROM pq)),
ic AS (SELECT coalesce(sum(n), 0)::BIGINT AS n FROM (SELECT lower(trim(o_orderstatus)) AS s, count(DISTINCT o_orderstatus) AS k, count(*) AS n FROM pq GROUP BY 1) WHERE k > 1)"""


@query(f"""WITH {PLACED} SELECT 'missing_values' AS issue, 3 * count(*) - count(o_totalprice) - count(a) - count(o) AS n, 'latitude,longitude,o_totalprice' AS columns FROM pq
UNION ALL SELECT 'duplicates', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM pq)), '' FROM pq
UNION ALL SELECT 'impossible_values', count(*) FILTER (item_qty < 0) + count(*) FILTER (disc_pct < 0 OR disc_pct > 100), 'disc_pct,item_qty' FROM pq
UNION ALL SELECT 'inconsistent_categories', n, CASE WHEN n > 0 THEN 'o_orderstatus' ELSE '' END FROM ic
UNION ALL SELECT 'extreme_skew', count(*) FILTER (steep), coalesce(string_agg(c, ',' ORDER BY c) FILTER (steep), '') FROM sk
UNION ALL SELECT 'invalid_dates', count(*) FILTER (try_cast(date_text AS DATE) IS NULL), 'date_text' FROM pq
UNION ALL SELECT 'invalid_geospatial', count(*) FILTER (bad) + count(*) FILTER ((a IS NULL) <> (o IS NULL)) + count(*) FILTER (NOT a BETWEEN -90 AND 90) + count(*) FILTER (NOT o BETWEEN -180 AND 180), 'latitude,longitude' FROM pq""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven issues with the columns that have them."""
    df = _placed_orders(spark, sf_dir)
    return quality.summary(quality.by_column(df, ["item_qty", "disc_pct", "steep"], ["o_orderstatus", "code_mix", "const_col"], ["date_text", "o_orderdate"], ("latitude", "longitude"))).withColumn("columns", F.array_join("columns", ","))
