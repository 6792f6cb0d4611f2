"""Queries that read a table back from the formats it was written in, and number its rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile
from ..session import scratch_base
from ..sources.readers import read_table, with_row_index
from .registry import query
from .views import table

_CUSTOMER = "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal::DOUBLE AS c_acctbal, c_mktsegment FROM customer"


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _again(spark: SparkSession, df: DataFrame, suffix: str, **options) -> DataFrame:
    """``df`` written in the format of ``suffix`` and read by the library's reader."""
    path = f"{scratch_base(spark)}/t-{uuid.uuid4().hex}{suffix}"
    kind = "json" if suffix == ".jsonl" else "csv"
    df.write.format(kind).options(**options).save(path)
    return read_table(spark, path)


@query(_CUSTOMER)
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, null tokens and types of a delimited file; headers with white space around them."""
    df = _customer(spark, sf_dir)
    return _again(spark, df.toDF(*[f" {c} " for c in df.columns]), ".csv", header=True)


@query(_CUSTOMER)
def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, _customer(spark, sf_dir), ".tsv", header=True, sep="\t")


@query(_CUSTOMER)
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, _customer(spark, sf_dir), ".jsonl").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("""SELECT o_orderkey::BIGINT AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status, o_orderkey % 2 = 0 AS even FROM orders""")
def read_null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several spellings of a missing value in numbers and texts of a delimited file, and a column of booleans."""
    k = F.col("o_orderkey")
    price = F.when(k % 5 != 0, F.col("o_totalprice").cast("string")).when(k % 3 == 0, "N/A").when(k % 3 == 1, "null").otherwise("NaN")
    status = F.when(k % 7 != 0, F.col("o_orderstatus")).when(k % 2 == 0, "None").otherwise("#N/A")
    return _again(spark, table(spark, sf_dir, "orders").select(k.alias("k"), price.alias("price"), status.alias("status"), (k % 2 == 0).alias("even")), ".csv", header=True)


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_index FROM events")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in the table's files."""
    return with_row_index(table(spark, sf_dir, "events").select("event_id"))


@query("""WITH c AS (SELECT 'customer' AS t, 'c_name' AS "column", count(DISTINCT c_name) AS d FROM customer UNION ALL SELECT 'customer', 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer
UNION ALL SELECT 'customer', 'c_nationkey', count(DISTINCT c_nationkey) FROM customer) SELECT "column", d AS distinct_values FROM c WHERE d <= 200""")
def few_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of few distinct values, counted exactly because a sketch can't rule the thresholds out."""
    df = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_nationkey")
    scan = profile.Scan(df)
    for c in df.columns:
        scan.add("distinct", c, value=profile.distinct_sketch(df, c))
        scan.add("missing", c, value=F.count_if(profile.is_missing(df, c)))
    got = scan.run()
    found = profile.distinct_by_need(df, {c: got["distinct", c] for c in df.columns}, {c: got["rows",] - got["missing", c] for c in df.columns})
    return spark.createDataFrame([(c, n) for c, (n, exact) in found.items() if exact and n <= 200], "column string, distinct_values bigint")
