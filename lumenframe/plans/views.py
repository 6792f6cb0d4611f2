"""Derived tables with known faults, by integer rules on keys; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.when(k % 13 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 11 == 0, F.concat(F.lower("o_orderstatus"), F.lit(" "))).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 17 == 0, "not-a-date").when(k % 29 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_text"),
        F.when(k % 3 == 0, F.concat(F.lit("x"), (k % 7).cast("string"))).otherwise((k % 1000).cast("string")).alias("code_mix"),
        F.when(k % 19 == 0, F.lit(-1).cast("bigint")).otherwise(k % 50).alias("item_qty"),
        F.when(k % 23 == 0, F.lit(150.0)).otherwise((k % 101).cast("double")).alias("disc_pct"),
        F.lit("A").alias("const_col"))
    return d.unionAll(d.filter(k % 50 == 0))


DIRTY_ORDERS = """do_ AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderstatus) || ' ' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 17 = 0 THEN 'not-a-date' WHEN o_orderkey % 29 = 0 THEN '2024-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
 CASE WHEN o_orderkey % 3 = 0 THEN 'x' || (o_orderkey % 7) ELSE (o_orderkey % 1000)::VARCHAR END AS code_mix,
 CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE o_orderkey % 50 END AS item_qty,
 CASE WHEN o_orderkey % 23 = 0 THEN 150.0::DOUBLE ELSE (o_orderkey % 101)::DOUBLE END AS disc_pct, 'A' AS const_col FROM orders),
dirty_orders AS (SELECT * FROM do_ UNION ALL SELECT * FROM do_ WHERE o_orderkey % 50 = 0)"""


#: Sixteen ways to write a date, as patterns.
SPELLINGS = [
    "yyyy-MM-dd", "M/d/yyyy", "MMM d yyyy", "d-MMM-yyyy", "dd-MMM-yy", "M/d/yy", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "M/d/yyyy hh:mm a", "MMM d, yyyy HH:mm", "yyyyMMdd'T'HHmmss", "yyyy.MM.dd", "yyyy/M/d", "d MMMM yyyy",
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "MMMM yyyy", "yyyy"]


def spelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders in sixteen spellings, some of them none, beside the order's year as a number."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(SPELLINGS):
        text = F.when(k % 16 == i, F.date_format(d, pattern)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 17 == 0, "not a date").when(k % 29 == 0, "2024-02-30").when(k % 31 == 0, None).otherwise(text).alias("day_text"), F.when(k % 5 != 0, F.year("o_orderdate")).alias("order_year"))


SPELLED = """sp AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 29 = 0 OR o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 16 = 15 THEN date_trunc('year', o_orderdate) WHEN o_orderkey % 16 = 14 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS day,
 NOT (o_orderkey % 17 = 0 OR o_orderkey % 29 = 0) AND o_orderkey % 31 = 0 AS absent, CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END AS order_year FROM orders)"""


def dirty_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 103 == 0, None).when(k % 101 == 0, 95.0).when(k % 499 == 7, -33.9).otherwise(40 + (k % 97) / 1000).alias("latitude"),
        F.when(k % 107 == 0, None).when(k % 109 == 0, 190.0).when(k % 499 == 7, 151.2).otherwise(-74 + (k % 89) / 1000).alias("longitude"),
        F.when(k % 31 == 0, "bad geom").otherwise(F.concat(F.lit("POINT ("), (k % 97).cast("string"), F.lit(" "), (k % 89).cast("string"), F.lit(")"))).alias("geom"))


DIRTY_GEO = """dirty_geo AS (SELECT c_custkey,
 CASE WHEN c_custkey % 103 = 0 THEN NULL WHEN c_custkey % 101 = 0 THEN 95.0::DOUBLE WHEN c_custkey % 499 = 7 THEN -33.9::DOUBLE ELSE 40 + (c_custkey % 97) / 1000.0::DOUBLE END AS latitude,
 CASE WHEN c_custkey % 107 = 0 THEN NULL WHEN c_custkey % 109 = 0 THEN 190.0::DOUBLE WHEN c_custkey % 499 = 7 THEN 151.2::DOUBLE ELSE -74 + (c_custkey % 89) / 1000.0::DOUBLE END AS longitude,
 CASE WHEN c_custkey % 31 = 0 THEN 'bad geom' ELSE 'POINT (' || (c_custkey % 97) || ' ' || (c_custkey % 89) || ')' END AS geom FROM customer)"""


def seasonal_values(pos):
    return (pos % 24) * 10 + F.when(pos % 1777 == 100, 500).otherwise(0)


def run_scores(pos):
    return F.when((pos % 400).between(10, 14), 0.9).when(pos % 37 == 0, 0.7).otherwise(0.1 + (pos % 10) / 100)


POSITIONED = "ev AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos FROM events)"
SEASONAL = POSITIONED + ", se AS (SELECT pos, ((pos % 24) * 10 + CASE WHEN pos % 1777 = 100 THEN 500 ELSE 0 END)::DOUBLE AS x FROM ev)"
RUNS = POSITIONED + ", ru AS (SELECT pos, CASE WHEN pos % 400 BETWEEN 10 AND 14 THEN 0.9::DOUBLE WHEN pos % 37 = 0 THEN 0.7::DOUBLE ELSE 0.1::DOUBLE + (pos % 10) / 100.0::DOUBLE END AS s FROM ev)"
