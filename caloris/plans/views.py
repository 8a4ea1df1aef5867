"""Deterministic projections of the star-schema tables to thermal tables, in Spark and as DuckDB CTEs.

Only integer arithmetic decides what a row is, so both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A small material library that leaves out one of the part types, which then falls back to DEFAULT.
MATERIALS = (
    ("STANDARD", 2700.0, 896.0, 167.0, 0.09),
    ("MEDIUM", 8960.0, 385.0, 401.0, 0.35),
    ("SMALL", 8000.0, 500.0, 16.2, 0.35),
    ("LARGE", 1410.0, 1460.0, 0.31, 0.85),
    ("PROMO", 8050.0, 515.0, 13.0, 0.3),
    ("DEFAULT", 2200.0, 800.0, 2.0, 0.85),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(x: Column, n: int) -> Column:
    """Integer division as DuckDB's //: exact for every key, towards zero."""
    return F.call_function("div", x, F.lit(n))


def cells(spark: SparkSession, sf_dir: str, largest: int | None = 45) -> DataFrame:
    """A grid of cubes 10 mm apart, 20 by 20 by n, of 10 or 6 mm; parts of larger p_size are air (None: every part is a cell)."""
    p = F.col("p_partkey").cast("long")
    i, j, k = p % 20, _whole(p, 20) % 20, _whole(p, 400)
    size = F.when(F.col("p_size") > 10, 10.0).otherwise(6.0)
    rows = table(spark, sf_dir, "part")
    if largest is not None:
        rows = rows.where(F.col("p_size") <= largest)
    return rows.select(
        p.alias("node_id"), i.alias("i"), j.alias("j"), k.alias("k"), *[(v * 10.0).alias(f"c{a}") for v, a in ((i, "x"), (j, "y"), (k, "z"))], *[size.alias(f"s{a}") for a in "xyz"],
        F.col("p_brand").alias("component"), F.col("p_type").alias("material"), (p % 5).cast("int").alias("level"), F.col("p_size").cast("int").alias("p_size"),
    )


def materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*MATERIALS], "name string, density_kg_m3 double, cp_j_kgk double, k_w_mk double, emissivity double")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 4 mm beside the cell of id 7 * s_suppkey mod 2000: even keys heat, odd ones measure."""
    s = F.col("s_suppkey").cast("long")
    n = s * 7 % 2000
    i, j, k = n % 20, _whole(n, 20) % 20, _whole(n, 400)
    return table(spark, sf_dir, "supplier").select(
        s.alias("role_id"), F.when(s % 2 == 0, "heater").otherwise("sensor").alias("kind"), F.concat(F.lit("role_"), (s % 3).cast("string"), F.when(s % 5 == 0, "_mesh").otherwise("")).alias("name"),
        (i * 10.0 + 6.0).alias("cx"), (j * 10.0).alias("cy"), (k * 10.0).alias("cz"), *[F.lit(4.0).alias(f"s{a}") for a in "xyz"],
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor_id, time_s (seconds of the event's number), value: one series for each user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("sensor_id"), F.col("event_id").cast("double").alias("time_s"), (273.15 + F.col("value") / 10).alias("value"))


def gains(spark: SparkSession, sf_dir: str, returned: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == returned)
    return rows.groupBy((F.col("l_suppkey") % 20).cast("long").alias("sensor_id"), (F.col("l_partkey") % 20).cast("long").alias("heater_id")).agg(F.avg("l_discount").alias("gain"))


_VALUES = ", ".join(f"('{n}', {d}::DOUBLE, {c}::DOUBLE, {k}::DOUBLE, {e}::DOUBLE)" for n, d, c, k, e in MATERIALS)
CTES = {
    "cells": """cells AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, p_partkey % 20 AS i, (p_partkey // 20) % 20 AS j, p_partkey // 400 AS k,
        10.0::DOUBLE * (p_partkey % 20) AS cx, 10.0::DOUBLE * ((p_partkey // 20) % 20) AS cy, 10.0::DOUBLE * (p_partkey // 400) AS cz,
        CASE WHEN p_size > 10 THEN 10.0::DOUBLE ELSE 6.0::DOUBLE END AS s, p_brand AS component, p_type AS material,
        CAST(p_partkey % 5 AS INTEGER) AS level, CAST(p_size AS INTEGER) AS p_size FROM part WHERE p_size <= 45)""",
    "conn": "conn AS (SELECT * FROM cells WHERE p_size <= 20)",
    "mats": f"mats(name, rho, cp, kc, eps) AS (VALUES {_VALUES})",
    "props": """props AS (SELECT c.*, m.name AS resolved, m.rho, m.cp, m.kc, m.eps, m.rho * (s * s * s * 1e-9::DOUBLE) AS mass, m.rho * (s * s * s * 1e-9::DOUBLE) * m.cp AS cap
        FROM cells c JOIN mats m ON m.name = CASE WHEN c.material IN (SELECT name FROM mats) THEN c.material ELSE 'DEFAULT' END)""",
    "grid": """grid AS (SELECT least(a.node_id, b.node_id) AS node_i, greatest(a.node_id, b.node_id) AS node_j, a.node_id AS ai, b.node_id AS bi,
        CASE WHEN b.i = a.i + 1 THEN 0 WHEN b.j = a.j + 1 THEN 1 ELSE 2 END AS axis
        FROM cells a JOIN cells b ON (b.i = a.i + 1 AND b.j = a.j AND b.k = a.k) OR (b.i = a.i AND b.j = a.j + 1 AND b.k = a.k) OR (b.i = a.i AND b.j = a.j AND b.k = a.k + 1))""",
    "gedges": """gedges AS (SELECT node_i, node_j, 1 / (a.s * 1e-3 * 0.5 / (a.kc * least(a.s, b.s) * 1e-3 * least(a.s, b.s) * 1e-3) + b.s * 1e-3 * 0.5 / (b.kc * least(a.s, b.s) * 1e-3 * least(a.s, b.s) * 1e-3)) AS g
        FROM grid JOIN props a ON a.node_id = node_i JOIN props b ON b.node_id = node_j)""",
    "ends": "ends AS (SELECT node_i AS node, node_j AS other, g FROM gedges UNION ALL SELECT node_j, node_i, g FROM gedges)",
    "roles": """roles AS (SELECT CAST(s_suppkey AS BIGINT) AS role_id, CASE WHEN s_suppkey % 2 = 0 THEN 'heater' ELSE 'sensor' END AS kind,
        'role_' || (s_suppkey % 3) || CASE WHEN s_suppkey % 5 = 0 THEN '_mesh' ELSE '' END AS name,
        10.0::DOUBLE * ((s_suppkey * 7 % 2000) % 20) + 6 AS cx, 10.0::DOUBLE * (((s_suppkey * 7 % 2000) // 20) % 20) AS cy, 10.0::DOUBLE * ((s_suppkey * 7 % 2000) // 400) AS cz FROM supplier)""",
    "readings": "readings AS (SELECT CAST(user_id AS BIGINT) AS sensor_id, CAST(event_id AS DOUBLE) AS time_s, 273.15::DOUBLE + value / 10 AS value FROM events)",
    "near": """near AS (SELECT role_id, kind, node_id, sqrt(gx * gx + gy * gy + gz * gz) AS gap,
        CASE WHEN ax >= ay AND ax >= az THEN oy * oz WHEN ay >= az THEN ox * oz ELSE ox * oy END AS area,
        sqrt(dx * dx + dy * dy + dz * dz) AS dist FROM (
          SELECT role_id, kind, node_id, greatest(abs(dx) - h, 0) AS gx, greatest(abs(dy) - h, 0) AS gy, greatest(abs(dz) - h, 0) AS gz,
                 abs(dx) - h AS ax, abs(dy) - h AS ay, abs(dz) - h AS az, dx, dy, dz,
                 greatest(least(h - abs(dx), least(s, 4)), 0) AS ox, greatest(least(h - abs(dy), least(s, 4)), 0) AS oy, greatest(least(h - abs(dz), least(s, 4)), 0) AS oz
          FROM (SELECT r.role_id, r.kind, c.node_id, r.cx - c.cx AS dx, r.cy - c.cy AS dy, r.cz - c.cz AS dz, (c.s + 4) / 2 AS h, c.s
                FROM roles r JOIN cells c ON abs(r.cx - c.cx) < 30 AND abs(r.cy - c.cy) < 30 AND abs(r.cz - c.cz) < 30))
        WHERE sqrt(gx * gx + gy * gy + gz * gz) <= 6)""",
    "gain_a": "gain_a AS (SELECT CAST(l_suppkey % 20 AS BIGINT) AS sensor_id, CAST(l_partkey % 20 AS BIGINT) AS heater_id, avg(l_discount) AS gain FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)",
    "gain_r": "gain_r AS (SELECT CAST(l_suppkey % 20 AS BIGINT) AS sensor_id, CAST(l_partkey % 20 AS BIGINT) AS heater_id, avg(l_discount) AS gain FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)",
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """A query over the named CTEs."""
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(CTES[n] for n in names.split())} {body}"
