"""Parquet table access and the canonical views bound to the test tables.

Canonical model (every operator takes one of these):

* ``incidents(id, ts TIMESTAMP_NTZ, district STRING, label STRING, measure DOUBLE)``
* ``readings(day DATE, segment BIGINT, speed DOUBLE)`` with -1 as missing sentinel
* ``places(place_id, place STRING, ptype STRING)``
* ``cells(cell_id, lon DOUBLE, lat DOUBLE, ctype STRING)``

The bindings below map the driver's TPC-H-like tables onto that model. They
are plain projections, so Catalyst prunes the scan to the used columns and
pushes later filters into the Parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table (columnar; pruning and pushdown by Catalyst)."""
    return spark.read.parquet(table_path(sf_dir, name))


def padded_district(key: Column, modulo: int) -> Column:
    """Zero-padded three character district code, e.g. ``'007'``."""
    return F.lpad((key % F.lit(modulo)).cast("string"), 3, "0")


def incidents_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incidents_e``: events as incidents, 25 districts, 5 labels, one month."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        padded_district(F.col("user_id"), 25).alias("district"),
        F.col("event_type").alias("label"),
        F.col("value").alias("measure"),
    )


def incidents_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incidents_o``: orders as incidents over ~6.5 years.

    The order date is midnight only, so the hour is taken from the key.
    """
    od = read_table(spark, sf_dir, "orders")
    return od.select(
        F.col("o_orderkey").alias("id"),
        F.expr("timestampadd(HOUR, CAST(o_orderkey % 24 AS INT), o_orderdate)").alias("ts"),
        padded_district(F.col("o_custkey"), 5).alias("district"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_totalprice").alias("measure"),
    )


def readings_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``readings``: per segment daily sensor readings, -1 = missing."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.to_date("l_shipdate").alias("day"),
        F.col("l_suppkey").alias("segment"),
        F.when(F.col("l_discount") == 0, F.lit(-1.0)).otherwise(F.col("l_quantity")).alias("speed"),
    )


def places_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``places``: location descriptions (64 values) and a type column."""
    pt = read_table(spark, sf_dir, "part")
    return pt.select(
        F.col("p_partkey").alias("place_id"),
        F.col("p_name").alias("place"),
        F.col("p_type").alias("ptype"),
    )


def cells_from_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cells``: coordinates scaled into a city-sized box (some fall outside)."""
    cu = read_table(spark, sf_dir, "customer")
    return cu.select(
        F.col("c_custkey").alias("cell_id"),
        (F.lit(-88.2) + (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0) * F.lit(1.4)).alias("lon"),
        (F.lit(41.55) + (F.col("c_custkey") % F.lit(997)).cast("double") / F.lit(997.0) * F.lit(0.6)).alias("lat"),
        F.col("c_mktsegment").alias("ctype"),
    )
