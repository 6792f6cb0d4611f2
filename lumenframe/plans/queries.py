"""Named queries over the standard tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.scalars import severity
from ..operators import context, geo, models, points, profile, series, times
from ..session import written
from . import analysis, explain, path_queries, source_queries  # noqa: F401  (two register their queries)
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .views import DIRTY_GEO, DIRTY_ORDERS, POSITIONED, RUNS, SEASONAL, SPELLED, dirty_geo, dirty_orders, run_scores, seasonal_values, spelled_dates, table

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.positioned(table(spark, sf_dir, "events"), [F.col("ts"), F.col("event_id")])


# Profiles

@query("SELECT count(*) AS row_count, 11::BIGINT AS column_count FROM lineitem")
def row_and_column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("bigint").alias("column_count"))


DIRTY_COLUMNS = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "date_text", "code_mix", "item_qty", "disc_pct", "const_col"]


def _counts_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS distinct_values, count(*) AS n FROM {source}" for c in columns)


@query(f"WITH {DIRTY_ORDERS} SELECT \"column\", missing, missing_pct FROM ({_counts_sql('dirty_orders', DIRTY_COLUMNS)})")
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.counts(dirty_orders(spark, sf_dir)).select("column", "missing", "missing_pct")


LINEITEM = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(f"SELECT \"column\", distinct_values FROM ({_counts_sql('lineitem', LINEITEM)})")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.counts(table(spark, sf_dir, "lineitem")).select("column", "distinct_values")


@query(f"WITH {DIRTY_ORDERS} SELECT \"column\" FROM ({_counts_sql('dirty_orders', DIRTY_COLUMNS)}) WHERE distinct_values <= 1")
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.counts(dirty_orders(spark, sf_dir)).filter("distinct_values <= 1").select("column")


@query(f"SELECT \"column\", distinct_values FROM ({_counts_sql('customer', ['c_name', 'c_mktsegment'])}) WHERE distinct_values > 50 AND distinct_values > 0.5 * n")
def high_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile.counts(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))
    return found.filter((F.col("distinct_values") > 50) & (F.col("distinct_values") > 0.5 * F.col("rows"))).select("column", "distinct_values")


@query(f"WITH {DIRTY_ORDERS} SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)))::BIGINT AS duplicate_rows FROM dirty_orders")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_rows(dirty_orders(spark, sf_dir))


@query(f"WITH {DIRTY_ORDERS} SELECT 'code_mix' AS \"column\", round(avg(CASE WHEN regexp_matches(code_mix, '^[+-]?[0-9]+(\\.[0-9]*)?$') THEN 1.0 ELSE 0.0 END), 6) AS castable_share, count(*) FILTER (NOT regexp_matches(code_mix, '^[+-]?[0-9]+(\\.[0-9]*)?$')) AS not_castable FROM dirty_orders")
def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.type_mismatch(dirty_orders(spark, sf_dir), ["code_mix"])


@query(f"WITH {DIRTY_ORDERS} SELECT count(*) FILTER (try_cast(date_text AS DATE) IS NULL) AS invalid_dates, count(*) AS dates FROM dirty_orders")
def invalid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.invalid_dates(dirty_orders(spark, sf_dir), "date_text").drop("column")


@query(f"WITH {SPELLED} SELECT 'day_text' AS \"column\", count(*) FILTER (day IS NULL AND NOT absent) AS invalid_dates, count(*) FILTER (NOT absent) AS dates FROM sp UNION ALL SELECT 'order_year', 0, count(order_year) FROM sp")
def invalid_date_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.invalid_dates(spelled_dates(spark, sf_dir), "day_text", "order_year")


@query(f"WITH {SPELLED} SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day FROM sp")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling as the date that it means."""
    return spelled_dates(spark, sf_dir).select("o_orderkey", F.date_format(times.parsed_time(F.col("day_text")), "yyyy-MM-dd").alias("day"))


@query(f"WITH {SPELLED} SELECT CASE WHEN count(day) >= count(order_year) THEN 'day_text' ELSE 'order_year' END AS best FROM sp")
def best_time_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = times.best_time(spelled_dates(spark, sf_dir), ["day_text", "order_year"])
    return spark.createDataFrame([(found,)], "best string")


@query("SELECT 'value' AS \"column\", round(skewness(value), 6) AS skewness FROM events")
def skew_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.skew(table(spark, sf_dir, "events"), ["value"])


def _iqr_sql(source: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, count(*) FILTER (q3 - q1 > 1e-8 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS outliers FROM {source}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source})"


@query(f"{_iqr_sql('events', 'value')} UNION ALL {_iqr_sql('events', 'user_id')}")
def iqr_outlier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.iqr_outliers(table(spark, sf_dir, "events"), ["value", "user_id"])


@query(f"WITH {DIRTY_GEO} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END), 6) AS castable, round(avg(CASE WHEN {c} BETWEEN -90 AND 90 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END), 6) AS lat_share, round(avg(CASE WHEN {c} BETWEEN -180 AND 180 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END), 6) AS lon_share FROM dirty_geo" for c in ("c_custkey", "latitude", "longitude")))
def geo_candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.geo_scores(dirty_geo(spark, sf_dir), ["c_custkey", "latitude", "longitude"])


@query(f"""WITH {DIRTY_GEO}, g AS (SELECT latitude AS a, longitude AS o, coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) AS ok FROM dirty_geo)
SELECT count(*) FILTER (NOT a BETWEEN -90 AND 90) AS invalid_latitude, count(*) FILTER (NOT o BETWEEN -180 AND 180) AS invalid_longitude, count(*) FILTER (ok) AS valid_pairs,
 count(*) FILTER (a IS NOT NULL AND o IS NOT NULL AND NOT ok) AS invalid_pairs, count(*) FILTER ((a IS NULL) <> (o IS NULL)) AS missing_pairs,
 round(min(a) FILTER (ok), 6) AS min_lat, round(max(a) FILTER (ok), 6) AS max_lat, round(min(o) FILTER (ok), 6) AS min_lon, round(max(o) FILTER (ok), 6) AS max_lon FROM g""")
def geo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.geo_summary(dirty_geo(spark, sf_dir), "latitude", "longitude")


@query(f"WITH {DIRTY_GEO} SELECT count(*) FILTER (geom LIKE 'POINT%(%') AS geometries, count(*) FILTER (NOT geom LIKE 'POINT%(%') AS invalid_geometries FROM dirty_geo")
def geometry_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.geometry_counts(dirty_geo(spark, sf_dir), "geom")


@query()
def semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("customer", "orders", "lineitem", "events", "documents", "embeddings"):
        rows += [(name, c, t) for c, t in profile.semantic_types(table(spark, sf_dir, name)).items()]
    return spark.createDataFrame(rows, "table_name string, column string, semantic_type string")


@query(f"""WITH {DIRTY_ORDERS}, c AS ({_counts_sql('dirty_orders', DIRTY_COLUMNS)}), i AS (
 SELECT "column", 'missing' AS issue, missing_pct FROM c WHERE missing > 0 UNION ALL SELECT "column", 'constant', missing_pct FROM c WHERE distinct_values <= 1
 UNION ALL SELECT 'code_mix', 'type mismatch', 0.0::DOUBLE UNION ALL SELECT 'date_text', 'invalid dates', 0.0::DOUBLE)
SELECT "column", string_agg(issue, ',' ORDER BY issue) AS issues, max(missing_pct) AS missing_pct, CASE WHEN max(missing_pct) >= 30 OR count(*) >= 3 THEN 'critical' ELSE 'warning' END AS status FROM i GROUP BY "column" """)
def column_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty_orders(spark, sf_dir)
    c = profile.counts(df)
    mixed = profile.type_mismatch(df, ["code_mix"]).filter((F.col("castable_share") >= 0.2) & (F.col("castable_share") < 0.95)).select("column", F.lit("type mismatch").alias("issue"), F.lit(0.0).alias("missing_pct"))
    dates = profile.invalid_dates(df, "date_text").filter("invalid_dates > 0").select("column", F.lit("invalid dates").alias("issue"), F.lit(0.0).alias("missing_pct"))
    return profile.column_health([
        c.filter("missing > 0").select("column", F.lit("missing").alias("issue"), "missing_pct"),
        c.filter("distinct_values <= 1").select("column", F.lit("constant").alias("issue"), "missing_pct"), mixed, dates])


# Points and quality

@query(f"WITH {DIRTY_ORDERS} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM dirty_orders)), 6) AS o_totalprice FROM dirty_orders")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.filled(dirty_orders(spark, sf_dir), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


POINTS = """s AS (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3, avg(value) AS am, stddev_pop(value) AS asd,
 quantile_cont(user_id::DOUBLE, 0.25) AS b1, quantile_cont(user_id::DOUBLE, 0.75) AS b3, avg(user_id) AS bm, stddev_pop(user_id) AS bsd FROM events),
p AS (SELECT event_id, event_type, ts, (value < a1 - 1.5 * (a3 - a1) OR value > a3 + 1.5 * (a3 - a1)) AS iqr_value, (user_id < b1 - 1.5 * (b3 - b1) OR user_id > b3 + 1.5 * (b3 - b1)) AS iqr_user,
 abs(value - am) / asd AS zv, abs(user_id - bm) / bsd AS zu FROM events, s),
q AS (SELECT *, (iqr_value::INT + iqr_user::INT) / 2.0::DOUBLE AS iqr_ratio, least(greatest(zv, zu) / 3.0, 1.0) AS z_peak, iqr_value OR iqr_user AS iqr_any, zv > 3 OR zu > 3 AS z_any FROM p),
sc AS (SELECT *, least(0.36 * (iqr_any::INT + z_any::INT) / 2.0 + 0.2 * iqr_ratio + 0.2 * z_peak, 1.0) AS score FROM q)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.flagged(table(spark, sf_dir, "events"), ["user_id", "value"])


def _point_score(flags: DataFrame) -> DataFrame:
    """The score of the two methods that need no model."""
    votes = (F.col("iqr_any").cast("int") + F.col("z_any").cast("int")) / 2
    return flags.withColumn("score", F.least(0.36 * votes + 0.2 * F.col("iqr_ratio") + 0.2 * F.col("z_peak"), F.lit(1.0)))


@query(f"WITH {POINTS} SELECT event_id, iqr_value, iqr_user, zv > 3 AS z_value, zu > 3 AS z_user, iqr_any OR z_any AS point FROM q WHERE iqr_any OR z_any")
def point_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).filter("point").select("event_id", F.col("iqr_1").alias("iqr_value"), F.col("iqr_0").alias("iqr_user"), F.col("z_1").alias("z_value"), F.col("z_0").alias("z_user"), "point")


@query(f"WITH {POINTS} SELECT event_id, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, event_id LIMIT 100")
def point_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _point_score(_flags(spark, sf_dir)).select("event_id", F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "event_id").limit(DEFAULT.top_n)


@query(f"WITH {POINTS} SELECT event_id, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, event_id LIMIT 400")
def score_curve_top400(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _point_score(_flags(spark, sf_dir)).select("event_id", F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "event_id").limit(400)


SEVERITY_SQL = "CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END"


@query(f"WITH {POINTS} SELECT {SEVERITY_SQL} AS severity, count(*) AS n FROM sc GROUP BY 1")
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _point_score(_flags(spark, sf_dir)).groupBy(severity(F.col("score")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS} SELECT count(*) FILTER (iqr_value) AS iqr_value, count(*) FILTER (iqr_user) AS iqr_user, count(*) FILTER (zv > 3) AS z_value, count(*) FILTER (zu > 3) AS z_user, count(*) FILTER (iqr_any OR z_any) AS point FROM q")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flags(spark, sf_dir)
    return f.agg(*[F.count_if(c).alias(n) for n, c in (("iqr_value", "iqr_1"), ("iqr_user", "iqr_0"), ("z_value", "z_1"), ("z_user", "z_0"), ("point", "point"))])


@query(f"""WITH {POINTS}, g AS (SELECT event_type, {SEVERITY_SQL} AS severity, score FROM sc WHERE iqr_any OR z_any)
SELECT event_type, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, round(max(score), 6) AS top_score FROM g GROUP BY event_type""")
def anomaly_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _point_score(_flags(spark, sf_dir)).filter("point").withColumn("severity", severity(F.col("score")))
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.round(F.max("score"), 6).alias("top_score"))


@query(f"WITH {DIRTY_ORDERS} SELECT 'item_qty' AS \"column\", count(*) FILTER (item_qty < 0) AS impossible FROM dirty_orders UNION ALL SELECT 'disc_pct', count(*) FILTER (disc_pct < 0 OR disc_pct > 100) FROM dirty_orders")
def impossible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.impossible(dirty_orders(spark, sf_dir), ["item_qty", "disc_pct"])


INCONSISTENT = "(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT lower(trim(o_orderstatus)) AS s, count(DISTINCT o_orderstatus) AS k, count(*) AS n FROM dirty_orders GROUP BY 1) WHERE k > 1)"


@query(f"WITH {DIRTY_ORDERS} SELECT {INCONSISTENT} AS inconsistent_rows")
def inconsistent_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.inconsistent(dirty_orders(spark, sf_dir), "o_orderstatus")


@query(f"""WITH {DIRTY_ORDERS} SELECT 'duplicates' AS issue, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_orders)) AS n FROM dirty_orders
UNION ALL SELECT 'impossible_values', count(*) FILTER (item_qty < 0) + count(*) FILTER (disc_pct < 0 OR disc_pct > 100) FROM dirty_orders
UNION ALL SELECT 'inconsistent_categories', {INCONSISTENT} UNION ALL SELECT 'invalid_dates', count(*) FILTER (try_cast(date_text AS DATE) IS NULL) FROM dirty_orders
UNION ALL SELECT 'missing_values', count(*) - count(o_totalprice) FROM dirty_orders""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty_orders(spark, sf_dir)
    parts = [
        ("duplicates", profile.duplicate_rows(df), F.col("duplicate_rows")),
        ("impossible_values", points.impossible(df, ["item_qty", "disc_pct"]).agg(F.sum("impossible").alias("k")), F.col("k")),
        ("inconsistent_categories", context.inconsistent(df, "o_orderstatus"), F.col("inconsistent_rows")),
        ("invalid_dates", profile.invalid_dates(df, "date_text"), F.col("invalid_dates")),
        ("missing_values", profile.counts(df).agg(F.sum("missing").alias("k")), F.col("k"))]
    rows = [d.select(F.lit(n).alias("issue"), c.cast("bigint").alias("n")) for n, d, c in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


# Context

GROUPS = "g AS (SELECT event_type AS context, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1 HAVING count(*) >= 8)"


@query(f"WITH {GROUPS} SELECT context, n, round(mean, 6) AS mean, round(sd, 6) AS sd FROM g WHERE (SELECT count(*) FROM g) >= 2")
def context_group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.group_stats(table(spark, sf_dir, "events"), "event_type", "value").select("context", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"WITH {GROUPS} SELECT event_id, 'event_type' AS context_column, 'value' AS value_column, round(abs(value - mean) / sd, 6) AS z FROM events JOIN g ON event_type = context WHERE sd > 1e-8 AND abs(value - mean) / sd > 3.2 AND (SELECT count(*) FROM g) >= 2")
def contextual_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.contextual(table(spark, sf_dir, "events"), "event_id", ["event_type"], ["value"])


# Series

def _rolled(source: str, x: str, w: int) -> str:
    frame = f"OVER (ORDER BY pos ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING)"
    return f"r1 AS (SELECT *, median({x}) {frame} AS med FROM {source}), r2 AS (SELECT *, median(abs({x} - med)) {frame} AS mad FROM r1), sd AS (SELECT stddev_pop({x}) AS sd FROM {source})"


@query(f"WITH {POSITIONED}, {_rolled('ev', 'value', 31)} SELECT event_id, round(med, 6) AS med, round(mad, 6) AS mad FROM r2")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rolling(_events(spark, sf_dir), "value", 31).select("event_id", F.round("value_med", 6).alias("med"), F.round("value_mad", 6).alias("mad"))


@query(f"WITH {POSITIONED}, {_rolled('ev', 'value', 31)} SELECT event_id, CASE WHEN value - med > 0 THEN 'spike' ELSE 'dip' END AS kind, round(value - med, 6) AS deviation, round(greatest(6 * mad, 1.5 * sd), 6) AS threshold FROM r2, sd WHERE abs(value - med) > greatest(6 * mad, 1.5 * sd)")
def ts_spikes_and_dips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.level_shifts(_events(spark, sf_dir), "value", 31).select("event_id", "kind", F.round("deviation", 6).alias("deviation"), F.round("threshold", 6).alias("threshold"))


EVENT_METRICS = f"""WITH {POSITIONED}, {_rolled('ev', 'value', 31)}, e AS (SELECT event_id, pos, value, med, value - med AS dev, greatest(6 * mad, 1.5 * sd) AS lim, lag(value) OVER (ORDER BY pos) AS prev FROM r2, sd),
k AS (SELECT *, CASE WHEN dev > lim THEN 'spike' WHEN dev < -lim THEN 'dip' END AS kind FROM e), c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos) AS r FROM k WHERE kind IS NOT NULL)
SELECT event_id, kind, round(value, 6) AS value, round(med, 6) AS baseline, round(round(abs(dev), 6) / round(lim, 6), 6) AS threshold_ratio, round(100 * (round(value, 6) - round(med, 6)) / nullif(abs(round(med, 6)), 0), 6) AS pct_from_baseline,
round(prev, 6) AS prev_value, round(value - prev, 6) AS delta_from_prev, round(100 * (round(value, 6) - round(prev, 6)) / nullif(abs(round(prev, 6)), 0), 6) AS pct_from_prev FROM c WHERE r <= 120"""


@query(EVENT_METRICS)
def ts_event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed spikes and dips (120 of each) with their figures."""
    base = written(_events(spark, sf_dir))
    found = series.level_shifts(base, "value", 31).select("event_id", F.lit("value").alias("column"), "kind", "pos", "value", "baseline", "deviation", "threshold")
    told = explain.enriched(written(analysis.listed(found, ["value"])), base, "ts", ["value"])
    plain = ("value", "baseline", "prev_value")
    return told.select("event_id", "kind", *[F.round(c, 6).alias(c) for c in plain], "threshold_ratio", "pct_from_baseline", "delta_from_prev", "pct_from_prev")


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _point_score(_flags(spark, sf_dir)).filter("point")
    columns = F.transform("beyond", lambda b: b["column"])
    return flags.select("event_id", F.col("event_type").alias("category"), F.round("score", 6).alias("score"), columns.alias("affected"))


GROUPED = f"WITH {POINTS}, f AS (SELECT event_id, event_type AS category, round(score, 6) AS score, iqr_value OR zv > 3 AS a, iqr_user OR zu > 3 AS b FROM sc WHERE iqr_any OR z_any)"


@query(GROUPED + " SELECT category, 'value' AS item, count(*) AS n FROM f WHERE a GROUP BY 1 UNION ALL SELECT category, 'user_id', count(*) FROM f WHERE b GROUP BY 1")
def group_top_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.top_of_groups(_grouped(spark, sf_dir), "affected")


@query(GROUPED + " SELECT category, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, event_id) AS r FROM f) WHERE r <= 8")
def group_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.samples_of_groups(_grouped(spark, sf_dir), "event_id").select("category", "event_id", "score")


@query("SELECT event_id, CASE WHEN abs(value) >= 1000 THEN format('{:,.1f}', value) WHEN abs(value) >= 100 THEN format('{:.2f}', value) WHEN abs(value) >= 1 THEN format('{:.3f}', value) ELSE format('{:.4f}', value) END AS shown FROM events")
def metric_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", explain.metric(F.col("value")).alias("shown"))


STEPS = POSITIONED + ", st AS (SELECT *, coalesce(value - lag(value) OVER (ORDER BY pos), 0) AS d FROM ev)"


@query(f"WITH {STEPS}, {_rolled('st', 'd', 31)} SELECT event_id, round(abs(d - med), 6) AS deviation, round(greatest(6 * mad, 2 * sd), 6) AS threshold FROM r2, sd WHERE abs(d - med) > greatest(6 * mad, 2 * sd) AND pos > 10")
def ts_trend_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trend_changes(_events(spark, sf_dir), "value", 31).select("event_id", F.round("deviation", 6).alias("deviation"), F.round("threshold", 6).alias("threshold"))


LAGGED = SEASONAL + ", lg AS (SELECT pos, x, lag(x, 7) OVER o AS l7, lag(x, 12) OVER o AS l12, lag(x, 24) OVER o AS l24, lag(x, 30) OVER o AS l30 FROM se WINDOW o AS (ORDER BY pos))"


def _seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("pos", seasonal_values(F.col("pos")).cast("double").alias("x"))


@query(f"WITH {LAGGED} " + " UNION ALL ".join(f"SELECT {k} AS lag, round(corr(x, l{k}), 6) AS correlation FROM lg" for k in (7, 12, 24, 30)))
def seasonal_lag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lag_scores(_seasonal(spark, sf_dir), "x")


@query(f"""WITH {LAGGED}, r AS (SELECT pos, x, abs(x - l24) AS dev FROM lg WHERE l24 IS NOT NULL), m AS (SELECT median(dev) AS m, stddev_pop(dev) AS sd FROM r), a AS (SELECT median(abs(dev - m)) AS mad FROM r, m)
SELECT pos, 24 AS lag, round(dev, 6) AS deviation, round(greatest(m + 6 * mad, 2.5 * sd), 6) AS threshold FROM r, m, a WHERE dev > greatest(m + 6 * mad, 2.5 * sd)""")
def ts_seasonal_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.seasonal_breaks(_seasonal(spark, sf_dir), "x").select("pos", "lag", F.round("deviation", 6).alias("deviation"), F.round("threshold", 6).alias("threshold"))


@query(f"""WITH {RUNS}, t AS (SELECT greatest(0.58, quantile_cont(s, 0.9)) AS t FROM ru), h AS (SELECT pos, s, pos - row_number() OVER (ORDER BY pos) AS island FROM ru, t WHERE s >= t)
SELECT min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS length, round(max(s), 6) AS peak FROM h GROUP BY island HAVING count(*) >= 3""")
def collective_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.high_runs(_events(spark, sf_dir).select("pos", run_scores(F.col("pos")).alias("s")), "s")


# Places

CENTRE = DIRTY_GEO + """, v AS (SELECT * FROM dirty_geo WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180), c AS (SELECT median(latitude) AS a0, median(longitude) AS o0 FROM v),
h AS (SELECT v.*, power(sin(radians(latitude - a0) / 2), 2) + cos(radians(a0)) * cos(radians(latitude)) * power(sin(radians(longitude - o0) / 2), 2) AS a FROM v, c),
k AS (SELECT *, 2 * 6371.0::DOUBLE * atan2(sqrt(a), sqrt(greatest(1 - a, 1e-12))) AS km FROM h),
m AS (SELECT median(km) AS m, quantile_cont(km, 0.995) AS q FROM k), d AS (SELECT median(abs(km - m)) AS mad FROM k, m), t AS (SELECT greatest(m + 6 * mad, q, 0.5) AS t FROM m, d)"""


@query(f"WITH {CENTRE} SELECT c_custkey, round(km, 4) AS km FROM k")
def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.distances(dirty_geo(spark, sf_dir), "latitude", "longitude").select("c_custkey", F.round("km", 4).alias("km"))


@query(f"WITH {CENTRE} SELECT c_custkey, round(km, 4) AS km, round(t, 4) AS threshold_km FROM k, t WHERE km > t")
def geo_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.outliers(dirty_geo(spark, sf_dir), "latitude", "longitude").select("c_custkey", F.round("km", 4).alias("km"), F.round("threshold_km", 4).alias("threshold_km"))


# Models

@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|42'), l_orderkey LIMIT 1000")
def train_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    k = F.concat_ws("|", *df.columns)
    return models.hash_sample(df.withColumn("k", k), "k", 1000).drop("k")


@query("""WITH e AS (SELECT a.c_custkey AS id, b.c_custkey AS nb, sqrt(power(a.c_nationkey::FLOAT::DOUBLE - b.c_nationkey::FLOAT::DOUBLE, 2) + power(a.c_acctbal::FLOAT::DOUBLE - b.c_acctbal::FLOAT::DOUBLE, 2)) AS d FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS r FROM e), k AS (SELECT * FROM n WHERE r <= 20), kd AS (SELECT id, max(d) AS kd FROM k GROUP BY id),
l AS (SELECT k.id, 1 / (avg(greatest(k.d, kd.kd)) + 1e-10) AS lrd FROM k JOIN kd ON k.nb = kd.id GROUP BY k.id)
SELECT k.id AS c_custkey, round(avg(n.lrd) / any_value(o.lrd), 4) AS lof FROM k JOIN l n ON k.nb = n.id JOIN l o ON k.id = o.id GROUP BY k.id""")
def lof_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return models.local_outlier_factor(df, "c_custkey", ["c_nationkey", "c_acctbal"]).select("c_custkey", F.round("lof", 4).alias("lof"))


@query()
def isolation_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return models.isolation_scores(df, "event_id", ["user_id", "value"]).select("event_id", F.round("iso_score", 6).alias("iso_score"))


@query()
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.scored(table(spark, sf_dir, "events"), "event_id", ["user_id", "value"]).select("event_id", F.round("votes", 4).alias("votes"), F.round("score", 6).alias("score"), "severity")


@query()
def full_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.suspicious(table(spark, sf_dir, "events"), "event_id", ["user_id", "value"], order="ts", contexts=["event_type"])
