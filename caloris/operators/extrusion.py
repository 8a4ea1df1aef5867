"""Drawing on a grid: the face that was picked, how far to extrude, the coordinates until something is met, and copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def face_normal(offset: Column) -> Column:
    """The axis of the largest offset (x, y, z) from a cube's centre, with its sign, as three whole numbers; x if there is none."""
    part = [F.coalesce(offset[a], F.lit(float("nan"))) for a in "xyz"]
    good = ~F.isnan(part[0] + part[1] + part[2]) & (F.abs(part[0]) + F.abs(part[1]) + F.abs(part[2]) > 1e-8)
    size = [F.abs(p) for p in part]
    axis = F.when(~good | ((size[0] >= size[1]) & (size[0] >= size[2])), 0).when(size[1] >= size[2], 1).otherwise(2)
    sign = lambda k: F.when(good & (part[k] < 0), -1).otherwise(1)
    return F.array(*[F.when(axis == k, sign(k)).otherwise(0) for k in range(3)])


def drag_count(dx: Column, dy: Column, direction_x: Column, direction_y: Column, pixels: float = 80.0) -> Column:
    """Whole cells that a drag covers along a direction on the screen; none against it or without a direction."""
    length = F.sqrt(direction_x * direction_x + direction_y * direction_y)
    # the direction is normalised before the drag is projected on it: in any other order whole cells are lost or won at their borders
    along = F.floor((dx * (direction_x / length) + dy * (direction_y / length)) / pixels)
    return F.coalesce(F.when(length > 1e-9, F.greatest(along, F.lit(0))), F.lit(0)).cast("int")


def extrude(starts: DataFrame, occupied: DataFrame) -> DataFrame:
    """source_id, step, i, j, k: the cells from each start (source_id, i, j, k, normal, count) on, up to the first that is
    occupied."""
    steps = starts.where("count > 0").withColumn("step", F.explode(F.sequence(F.lit(1), F.col("count"))))
    cells = steps.select("source_id", "step", *[(F.col(a) + F.col("step") * F.col("normal")[n]).cast("long").alias(a) for n, a in enumerate("ijk")])
    met = cells.join(occupied.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_semi").groupBy("source_id").agg(F.min("step").alias("stop"))
    return cells.join(met, "source_id", "left").where(F.col("stop").isNull() | (F.col("step") < F.col("stop"))).select("source_id", "step", "i", "j", "k")


def clone(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Copies of nodes at new places (source_id, i, j, k) with ids after the largest: geometry, material and mass as they
    were, without roles, cooler and radiation; capacity is mass times heat capacity unless it was set by hand."""
    from pyspark.sql import Window

    last = nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0]
    number = F.row_number().over(Window.partitionBy("one").orderBy("source_id", "i", "j", "k"))  # what a user has drawn
    new = placed.withColumn("one", F.lit(1)).withColumn("new_id", number + F.lit(last)).drop("one")
    rows = new.join(nodes.drop("i", "j", "k").withColumnRenamed("node_id", "source_id"), "source_id")
    reset = {"is_heater": F.lit(False), "is_sensor": F.lit(False), "has_cryocooler": F.lit(False), "g_rad_w_k": F.lit(0.0)}
    rows = rows.withColumns({c: v for c, v in reset.items() if c in rows.columns})
    rows = rows.withColumn("capacity_j_k", F.when(F.col("capacity_by_hand"), F.col("capacity_j_k")).otherwise(F.col("mass_kg") * F.col("cp_j_kgk")))
    return rows.withColumnRenamed("new_id", "node_id").drop("step")
