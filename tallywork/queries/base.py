"""Query registry and the input frames that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)``; ``sql`` is the same question for DuckDB."""
    def keep(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round floating columns: sums differ in the last bits with the order of addition."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


# The derivations below read the same in Spark SQL and in DuckDB.
MESSY = """
SELECT o_orderkey AS rid,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
       WHEN o_orderkey % 23 = 0 THEN 'Free (comp)'
       WHEN o_orderkey % 19 = 0 THEN 'one hundred twenty five'
       WHEN o_orderkey % 31 = 0 THEN 'Five'
       WHEN o_orderkey % 17 = 0 THEN ' n/a '
       WHEN o_orderkey % 13 = 0 THEN concat('$', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING))
       WHEN o_orderkey % 11 = 0 THEN concat('Item A - $', CAST(o_orderkey % 90 AS STRING), ', Item B $40')
       WHEN o_orderkey % 7 = 0 THEN concat(CAST(o_orderkey % 9 AS STRING), ' hours')
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS amount,
  concat('  ', o_orderstatus, ' ') AS status,
  CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1000
       WHEN o_orderkey % 89 = 0 THEN NULL ELSE o_totalprice END AS price,
  o_orderkey % 101 AS Progress,
  CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS Finished
FROM orders
"""
SURVEY = """
SELECT c_custkey AS rid, c_acctbal AS y,
  CAST(0.5 AS DOUBLE) + (c_custkey % 7) / CAST(4 AS DOUBLE) AS w,
  c_nationkey % 5 AS stratum, c_nationkey AS psu, c_mktsegment AS segment,
  CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS level
FROM customer
"""
SERIES = """
SELECT date_trunc('day', ts) AS day, avg(value) AS value, count(*) AS n FROM events GROUP BY 1
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(
        sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source)
    )


def messy(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, MESSY, "orders")


def survey(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, SURVEY, "customer")


def with_messy(sql: str) -> str:
    return f"WITH messy AS ({MESSY}) {sql}"


def with_survey(sql: str) -> str:
    return f"WITH survey AS ({SURVEY}) {sql}"
