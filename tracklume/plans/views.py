"""The reference roles as views of the driver's tables, for Spark and (as SQL text) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: a supplier's line items by month."""
    c = F.col
    day = F.datediff(c("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", day, c("l_quantity").cast("long"), F.round(c("l_extendedprice") * 100).cast("long"))
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").cast("string").alias("sequence_id"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("double").alias("time_s"),
        c("l_returnflag").alias("source"),
        c("l_linestatus").alias("candidate_branch"),
        c("l_quantity").alias("x_m"),
        F.round(c("l_discount") * 100).alias("y_m"),
        F.round(c("l_tax") * 100).alias("z_m"),
        c("l_extendedprice").alias("score"),
        key.alias("key"),
    )


CANDIDATES = """
cand AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS sequence_id, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS DOUBLE) AS time_s,
         l_returnflag AS source, l_linestatus AS candidate_branch, l_quantity AS x_m,
         round(l_discount * 100) AS y_m, round(l_tax * 100) AS z_m, l_extendedprice AS score,
         concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)),
                   CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS key
  FROM lineitem
)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements: a user's events; x is the value, y the number in the properties."""
    c = F.col
    return table(spark, sf_dir, "events").select(
        c("user_id").cast("string").alias("sequence_id"),
        ((F.unix_micros(c("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / F.lit(1e6)).alias("time_s"),
        c("event_type").alias("source"),
        c("value").alias("x_m"),
        F.get_json_object("props", "$.k").cast("double").alias("y_m"),
        c("event_id").alias("key"),
    )


MEASUREMENTS = """
meas AS (
  SELECT CAST(user_id AS VARCHAR) AS sequence_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS time_s, event_type AS source,
         value AS x_m, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y_m, event_id AS key
  FROM events
)"""


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories: a customer's orders; time in days."""
    c = F.col
    return table(spark, sf_dir, "orders").select(
        c("o_custkey").cast("string").alias("sequence_id"),
        F.datediff(c("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double").alias("time_s"),
        c("o_orderstatus").alias("source"),
        (c("o_totalprice") / 1000).alias("x_m"),
        c("o_orderpriority").alias("phase"),
        c("o_orderkey").alias("key"),
    )


TRAJECTORIES = """
traj AS (
  SELECT CAST(o_custkey AS VARCHAR) AS sequence_id, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS time_s,
         o_orderstatus AS source, o_totalprice / 1000 AS x_m, o_orderpriority AS phase, o_orderkey AS key
  FROM orders
)"""
