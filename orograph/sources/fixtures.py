"""Terrain, stations, targets, routes and zones derived from the relational tables by integer arithmetic.

The terrain is ``orders`` laid out 120 cells wide, one row per cell (r, c, z, valid).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, z, valid); z is null nowhere, and cells that are not valid hold no elevation."""
    key = F.col("o_orderkey")
    r, c = F.floor(key / WIDTH), key % WIDTH
    z = (r * 37 + c * c * 11) % 211 + F.floor("o_totalprice") % 13
    return table(spark, sf_dir, "orders").select(r.cast("int").alias("r"), c.cast("int").alias("c"), z.cast("double").alias("z"), (F.col("o_custkey") % 97 != 0).alias("valid"))


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of whole rows of the terrain, as one row to broadcast."""
    return F.broadcast(table(spark, sf_dir, "orders").agg(F.floor((F.max("o_orderkey") + 1) / WIDTH).alias("tall")))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, r, c, height_m, range_cells, azimuth_deg, width_deg)."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").join(tall(spark, sf_dir)).select(
        k.alias("station_id"),
        (k % F.col("tall")).cast("int").alias("r"),
        (k * 37 % 120).cast("int").alias("c"),
        (5 + n + 100).cast("double").alias("height_m"),
        (10 + k % 15).cast("int").alias("range_cells"),
        (n * 14 % 360).cast("int").alias("azimuth_deg"),
        F.element_at(F.array(*map(F.lit, (60, 90, 120, 360))), (k % 4 + 1).cast("int")).alias("width_deg"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target_id, r, c, z_abs)."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(tall(spark, sf_dir)).select(
        k.alias("target_id"), (k % F.col("tall")).cast("int").alias("r"), (k * 7 % 120).cast("int").alias("c"), (150 + F.pmod(F.floor("c_acctbal"), F.lit(200))).cast("double").alias("z_abs")
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, seq, x, y, heading): waypoints in cell units."""
    from pyspark.sql import Window

    e = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").join(tall(spark, sf_dir)).select(
        F.col("user_id").alias("route_id"),
        seq.alias("seq"),
        (e * 17 % 120).cast("double").alias("x"),
        (e * 5 % F.col("tall")).cast("double").alias("y"),
        (e * 29 % 360).cast("double").alias("heading"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, r, c, r_inner, r_outer, level)."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").join(tall(spark, sf_dir)).select(
        k.alias("zone_id"), (k % F.col("tall")).cast("int").alias("r"), (k * 11 % 120).cast("int").alias("c"), (2 + s % 4).cast("int").alias("r_inner"), (7 + s % 4).cast("int").alias("r_outer"), (1 + s % 5).cast("int").alias("level")
    )


#: The same tables as common table expressions, for the oracle.
SQL = {
    "terrain": "terrain AS (SELECT (o_orderkey // 120)::INT AS r, (o_orderkey % 120)::INT AS c, ((o_orderkey // 120 * 37 + (o_orderkey % 120) * (o_orderkey % 120) * 11) % 211 + floor(o_totalprice)::BIGINT % 13)::DOUBLE AS z, o_custkey % 97 <> 0 AS valid FROM orders)",
    "stations": "stations AS (SELECT s_suppkey AS station_id, (s_suppkey % (SELECT (max(o_orderkey) + 1) // 120 FROM orders))::INT AS r, (s_suppkey * 37 % 120)::INT AS c, (105 + s_nationkey)::DOUBLE AS height_m, (10 + s_suppkey % 15)::INT AS range_cells, (s_nationkey * 14 % 360)::INT AS azimuth_deg, CASE s_suppkey % 4 WHEN 0 THEN 60 WHEN 1 THEN 90 WHEN 2 THEN 120 ELSE 360 END AS width_deg FROM supplier)",
    "targets": "targets AS (SELECT c_custkey AS target_id, (c_custkey % (SELECT (max(o_orderkey) + 1) // 120 FROM orders))::INT AS r, (c_custkey * 7 % 120)::INT AS c, (150 + (floor(c_acctbal)::BIGINT % 200 + 200) % 200)::DOUBLE AS z_abs FROM customer)",
    "routes": "routes AS (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (event_id * 17 % 120)::DOUBLE AS x, (event_id * 5 % (SELECT (max(o_orderkey) + 1) // 120 FROM orders))::DOUBLE AS y, (event_id * 29 % 360)::DOUBLE AS heading FROM events)",
    "zones": "zones AS (SELECT p_partkey AS zone_id, (p_partkey % (SELECT (max(o_orderkey) + 1) // 120 FROM orders))::INT AS r, (p_partkey * 11 % 120)::INT AS c, (2 + p_size % 4)::INT AS r_inner, (7 + p_size % 4)::INT AS r_outer, (1 + p_size % 5)::INT AS level FROM part)",
}


def with_(*names: str) -> str:
    """``WITH`` and the named fixtures, ready for more expressions."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
