"""Readings derived from the driver's tables, with the matching SQL for the oracle.

``readings``     D-1: events as readings of four units, tag = event type
``instruments``  D-1 with instrument-style tag names (plant_unit_code_suffix)
``shipments``    D-2: lineitem as readings of suppliers; the natural key repeats
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Instrument code given to each event type.
CODES = {"click": "SI-101", "view": "FI-201", "purchase": "PIA-301", "error": "TI-401", "signup": "XI-501"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit_number() -> Column:
    return F.col("user_id") % 4


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("P-"), (_unit_number() % 2).cast("string")).alias("plant"),
        F.concat(F.lit("U-"), _unit_number().cast("string")).alias("unit"),
        F.col("event_type").alias("tag"),
        F.col("ts").cast("timestamp").alias("time"),
        "value",
        F.col("event_id").alias("seq"),
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lit(CODES["signup"])
    for event, name in CODES.items():
        code = F.when(F.col("tag") == event, F.lit(name)).otherwise(code)
    return readings(spark, sf_dir).withColumn("tag", F.concat_ws("_", "plant", "unit", code, F.lit("PV")))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "r_name")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("r_name").alias("plant"),
            F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("unit"),
            F.concat("l_returnflag", "l_linestatus").alias("tag"),
            F.col("l_shipdate").cast("timestamp").alias("time"),
            F.col("l_extendedprice").alias("value"),
            ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq"),
        )
    )


READINGS = """readings AS (
  SELECT 'P-' || ((user_id % 4) % 2) AS plant, 'U-' || (user_id % 4) AS unit, event_type AS tag,
         ts AS time, value, event_id AS seq
  FROM events)"""

INSTRUMENTS = f"""{READINGS}, instruments AS (
  SELECT plant, unit, plant || '_' || unit || '_' || CASE tag
           WHEN 'click' THEN 'SI-101' WHEN 'view' THEN 'FI-201' WHEN 'purchase' THEN 'PIA-301'
           WHEN 'error' THEN 'TI-401' ELSE 'XI-501' END || '_PV' AS tag, time, value, seq
  FROM readings)"""

SHIPMENTS = """shipments AS (
  SELECT r_name AS plant, 'S-' || l_suppkey AS unit, l_returnflag || l_linestatus AS tag, l_shipdate AS time,
         l_extendedprice AS value, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
