"""Sensor by heater gain matrices as long tables (sensor_id, heater_id, gain): identification, pruning, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def identify(readings: DataFrame) -> DataFrame:
    """Gains from readings (sensor_id, heater_id, phase, value, power_w): the change of the mean from phase 'baseline' to
    'experiment' over the change of power; not finite becomes 0."""
    mean = lambda c, p: F.avg(F.when((F.col("phase") == p) & ~F.isnan(c), F.col(c)))
    g = readings.groupBy("sensor_id", "heater_id").agg(((mean("value", "experiment") - mean("value", "baseline")) / F.nullif(mean("power_w", "experiment") - mean("power_w", "baseline"), F.lit(0.0))).alias("gain"))
    good = F.col("gain").isNotNull() & ~F.isnan("gain") & (F.abs("gain") < float("inf"))
    return g.withColumn("gain", F.when(good, F.col("gain")).otherwise(F.lit(0.0)))


def prune(gains: DataFrame, sensors: DataFrame, heaters: DataFrame) -> DataFrame:
    """Gains other than 0 of sensors and heaters that exist."""
    return gains.where("gain <> 0").join(sensors.select("sensor_id").distinct(), "sensor_id", "left_semi").join(heaters.select("heater_id").distinct(), "heater_id", "left_semi")


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """sensor_id, heater_id, a, b over all sensors and heaters of either matrix; what is missing is 0.

    The grid of ids is the result's own size: every sensor with every heater.
    """
    sensors = a.select("sensor_id").union(b.select("sensor_id")).distinct()
    heaters = a.select("heater_id").union(b.select("heater_id")).distinct()
    every = heaters.agg(F.collect_set("heater_id").alias("hs"))  # one row: heaters of a controller
    grid = sensors.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one").select("sensor_id", F.explode("hs").alias("heater_id"))
    pick = lambda d, n: d.groupBy("sensor_id", "heater_id").agg(F.sum("gain").alias(n))
    zero = F.lit(0.0)
    return grid.join(pick(a, "a"), ["sensor_id", "heater_id"], "left").join(pick(b, "b"), ["sensor_id", "heater_id"], "left").select("sensor_id", "heater_id", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cells, max_abs, mean_abs, relative (Frobenius of b - a over that of a), correlation (null if undefined)."""
    d = F.col("b") - F.col("a")
    size = F.sqrt(F.sum(F.col("a") * F.col("a")))
    return align(a, b).agg(
        F.count("*").alias("cells"), F.max(F.abs(d)).alias("max_abs"), F.avg(F.abs(d)).alias("mean_abs"),
        F.when(size > 0, F.sqrt(F.sum(d * d)) / size).alias("relative"), (F.covar_pop("a", "b") / F.nullif(F.stddev_pop("a") * F.stddev_pop("b"), F.lit(0.0))).alias("correlation"),
    )


def from_maps(rows: DataFrame, column: str = "gains") -> DataFrame:
    """Long gains from rows of sensor_id and a map heater_id -> gain, zeros dropped."""
    return rows.select("sensor_id", F.explode(column).alias("heater_id", "gain")).where("gain <> 0")


def to_maps(gains: DataFrame) -> DataFrame:
    return gains.where("gain <> 0").groupBy("sensor_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("heater_id", "gain")))).alias("gains"))
