"""Heater and sensor roles: grouping, contact with cells, pairing, readouts and power deposits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caloris.functions import physics as P
from caloris.functions.text import strip_solid_suffix
from caloris.operators.graph import VISUAL_SOURCE, VISUAL_TYPE, both_ways, components
from caloris.operators.spatial import AXES, corners, pairs, with_corners
from caloris.session import ship_package, staged


#: Shares of the candidates, by distance, that greedy_pairs settles before the others.
BANDS = (0.01, 0.1)


def box(prefix: str = "") -> tuple[list[Column], list[Column]]:
    return [F.col(f"{prefix}c{a}") - F.col(f"{prefix}s{a}") / 2 for a in AXES], [F.col(f"{prefix}c{a}") + F.col(f"{prefix}s{a}") / 2 for a in AXES]


def _near(left: DataFrame, right: DataFrame, reach: float, l_id: str, r_id: str) -> DataFrame:
    """Pairs of boxes whose surfaces are at most `reach` apart, once each: l_*, r_* and gap_mm."""
    both = pairs(with_corners(left), with_corners(right), reach / 2 + P.TOUCH_MM)
    return both.withColumn("gap_mm", P.surface_gap(*corners("l_"), *corners("r_"))).where(F.col("gap_mm") <= reach)


def contacts(roles: DataFrame, cells: DataFrame, reach_mm: float) -> DataFrame:
    """role_id, node_id, gap_mm, area_mm2 of the cells a role's box touches within the reach; the area is that of the
    face across the axis of the widest gap."""
    met = _near(roles, cells, reach_mm, "role_id", "node_id")
    (al, ah), (bl, bh) = box("l_"), box("r_")
    g, o = P.gaps(al, ah, bl, bh), [F.greatest(x, F.lit(0.0)) for x in P.overlaps(al, ah, bl, bh)]
    area = F.when((g[0] >= g[1]) & (g[0] >= g[2]), o[1] * o[2]).when(g[1] >= g[2], o[0] * o[2]).otherwise(o[0] * o[1])
    return met.select(F.col("l_role_id").alias("role_id"), F.col("r_node_id").alias("node_id"), "gap_mm", area.alias("area_mm2"))


def deposit_weights(touching: DataFrame) -> DataFrame:
    """role_id, node_id, weight: a role's power goes to its nearest cells in proportion to max(area, 1)."""
    w = Window.partitionBy("role_id")
    nearest = touching.withColumn("m", F.min("gap_mm").over(w)).where(F.col("gap_mm") <= F.col("m") + 1e-9)
    share = F.greatest("area_mm2", F.lit(1.0))
    return nearest.select("role_id", "node_id", (share / F.sum(share).over(w)).alias("weight"))


def tolerance_rung(touching: DataFrame, start_mm: float, growth: float, most_mm: float) -> DataFrame:
    """role_id, rung: the first step of the tolerances start, start*growth, ... (at most most_mm) at which the role
    touches a cell. The ladder is monotone, so the nearest gap decides; there is no loop."""
    ladder, t = [start_mm], start_mm
    while t < most_mm:
        t = min(most_mm, t * max(1.01, growth)) if t > 0 else most_mm
        ladder.append(t)
    gap = touching.groupBy("role_id").agg(F.min("gap_mm").alias("gap"))
    rung = F.when(F.col("gap") <= ladder[-1], F.size(F.filter(F.array(*[F.lit(x) for x in ladder]), lambda x: x < F.col("gap"))))
    return gap.select("role_id", rung.alias("rung")).where("rung IS NOT NULL")


def nearest_cells(roles: DataFrame, cells: DataFrame, reach_mm: float, n: int = 3) -> DataFrame:
    """The n nearest cells of each role within the reach, by gap, centre distance and the id as text."""
    met = _near(roles, cells, reach_mm, "role_id", "node_id")
    distance = P.norm([F.col(f"l_c{a}") - F.col(f"r_c{a}") for a in AXES])
    rows = met.select(F.col("l_role_id").alias("role_id"), F.col("r_node_id").alias("node_id"), "gap_mm", distance.alias("distance_mm"))
    order = Window.partitionBy("role_id").orderBy("gap_mm", "distance_mm", F.col("node_id").cast("string"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def pair_candidates(heaters: DataFrame, sensors: DataFrame, reach_mm: float) -> DataFrame:
    """heater_id, sensor_id, distance_mm of every heater and sensor whose surfaces are within the reach."""
    met = _near(heaters, sensors, reach_mm, "role_id", "role_id")
    return met.select(F.col("l_role_id").alias("heater_id"), F.col("r_role_id").alias("sensor_id"), F.col("gap_mm").alias("distance_mm"))


def greedy_pairs(candidates: DataFrame, capacity: int = 1) -> DataFrame:
    """Greedy matching by (distance, heater, sensor): a heater once, a sensor up to its capacity.

    Greedy in a total order equals rounds in which every candidate that is first for its heater and within its sensor's
    free places is taken, so it needs no single task: each round settles all locally best pairs.
    """
    order = ("distance_mm", "heater_id", "sensor_id")
    d = F.col("distance_mm")
    rest, taken = staged(candidates), None

    def still(rows: DataFrame) -> DataFrame:
        """Candidates whose heater is free and whose sensor has places left."""
        if taken is None:
            return rows
        full = taken.groupBy("sensor_id").count().where(F.col("count") >= capacity).select("sensor_id")
        return rows.join(taken.select("heater_id"), "heater_id", "left_anti").join(full, "sensor_id", "left_anti")

    # all of lesser distance come first in the order, so distances are settled in bands, and far candidates are looked at once near ones are
    for end in [*sorted(set(rest.approxQuantile("distance_mm", list(BANDS), 0.0005))), None]:
        open_ = rest if end is None else staged(rest.where(d.isNull() | (d <= end)))
        while not open_.isEmpty():
            used = taken.groupBy("sensor_id").agg(F.count("*").alias("used")) if taken is not None else None
            rows = open_.join(used, "sensor_id", "left").withColumn("free", F.lit(capacity) - F.coalesce("used", F.lit(0))) if used is not None else open_.withColumn("free", F.lit(capacity))
            rows = rows.withColumn("h", F.row_number().over(Window.partitionBy("heater_id").orderBy(*order))).withColumn("s", F.row_number().over(Window.partitionBy("sensor_id").orderBy(*order)))
            won = staged(rows.where("h = 1 AND s <= free").select("heater_id", "sensor_id", "distance_mm"))
            taken = won if taken is None else staged(taken.unionByName(won))
            open_ = staged(still(open_))
        if end is not None:
            rest = staged(still(rest.where(d > end)))
    return taken if taken is not None else candidates.select("heater_id", "sensor_id", "distance_mm")


def clusters(boxes: DataFrame, reach_mm: float) -> DataFrame:
    """role_id, label: boxes of one kind and name within the reach of each other, transitively."""
    met = _near(boxes, boxes, reach_mm, "role_id", "role_id").where((F.col("l_kind") == F.col("r_kind")) & (F.col("l_name") == F.col("r_name")) & (F.col("l_role_id") < F.col("r_role_id")))
    edges = met.select(F.col("l_role_id").alias("node_i"), F.col("r_role_id").alias("node_j"))
    return components(boxes.select(F.col("role_id").alias("node_id")), edges).withColumnRenamed("node_id", "role_id")


def collapse(boxes: DataFrame, reach_mm: float) -> DataFrame:
    """Role components: one for each cluster of a (kind, base name) group, numbered by least x where there are several."""
    named = boxes.withColumn("name", strip_solid_suffix(F.col("name")))
    rows = named.join(clusters(named, reach_mm), "role_id")
    out = rows.groupBy("kind", "name", "label").agg(F.count("*").alias("objects"), F.min(F.col("cx") - F.col("sx") / 2).alias("min_x"))
    group = Window.partitionBy("kind", "name")
    k, n = F.row_number().over(group.orderBy("min_x", "label")), F.count("*").over(group)
    return out.select("kind", F.when(n > 1, F.concat("name", F.lit("_"), k.cast("string"))).otherwise(F.col("name")).alias("role"), "objects", "min_x")


def role_contact_edges(roles: DataFrame, cells: DataFrame, known: DataFrame, tolerance_mm: float) -> DataFrame:
    """Edges that only show which cells a role touches: node_i (role), node_j, shared_area_m2, distance_m, gap_mm.

    A role's box touches a cell within the tolerance along one axis at most, with a common part along the other two; pairs
    that are connected already (known: node_i, node_j) stay out.
    """
    met = _near(roles, cells, max(0.0, tolerance_mm), "role_id", "node_id")
    (al, ah), (bl, bh) = box("l_"), box("r_")
    gap, common = [F.greatest(g, F.lit(0.0)) for g in P.gaps(al, ah, bl, bh)], P.overlaps(al, ah, bl, bh)
    m = F.explode(F.array(F.struct(*[g.alias(f"g{n}") for n, g in enumerate(gap)], *[o.alias(f"o{n}") for n, o in enumerate(common)])))
    rows = met.withColumn("m", m)
    g, o = [F.col(f"m.g{n}") for n in range(3)], [F.col(f"m.o{n}") for n in range(3)]
    apart, touch = ([F.when(c, 1).otherwise(0) for c in x] for x in ([v > P.TOUCH_MM for v in g], [F.abs(v) <= P.TOUCH_MM for v in o]))
    n_apart, n_touch = apart[0] + apart[1] + apart[2], touch[0] + touch[1] + touch[2]
    plus = [F.greatest(v, F.lit(0.0)) for v in o]
    least = F.when((plus[0] <= plus[1]) & (plus[0] <= plus[2]), 0).when(plus[1] <= plus[2], 1).otherwise(2)
    first = lambda flags: F.when(flags[0] == 1, 0).when(flags[1] == 1, 1).otherwise(2)
    axis = F.when(n_apart == 1, first(apart)).when(n_touch == 1, first(touch)).otherwise(least)
    rows = rows.where(n_apart <= 1).withColumn("axis", axis)
    p, q = F.when(F.col("axis") == 0, o[1]).otherwise(o[0]), F.when(F.col("axis") == 2, o[1]).otherwise(o[2])
    distance = P.norm([F.col(f"l_c{a}") - F.col(f"r_c{a}") for a in AXES])
    out = rows.where((p > 0) & (q > 0)).select(F.col("l_role_id").alias("node_i"), F.col("r_node_id").alias("node_j"), (p * q * 1e-6).alias("shared_area_m2"), (distance * 1e-3).alias("distance_m"), "gap_mm")
    pair = known.select(F.least("node_i", "node_j").alias("p"), F.greatest("node_i", "node_j").alias("q"))
    out = out.join(pair, (F.least("node_i", "node_j") == F.col("p")) & (F.greatest("node_i", "node_j") == F.col("q")), "left_anti")
    return out.withColumns({"edge_type": F.lit(VISUAL_TYPE), "source": F.lit(VISUAL_SOURCE), "g_w_k": F.lit(0.0), "contact_confidence": F.lit("visual")})


def isolated_roles(roles: DataFrame, edges: DataFrame, cells: DataFrame, reach_mm: float) -> DataFrame:
    """role_id and the nearest cells as text of every role without a contact edge."""
    lonely = roles.join(edges.select(F.col("node_i").alias("role_id")).distinct(), "role_id", "left_anti")
    near = nearest_cells(lonely, cells, reach_mm)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id", "gap_mm"))), lambda x: F.concat(x["node_id"].cast("string"), F.lit(" gap="), F.format_string("%.3f", x["gap_mm"]))), "; ")
    return lonely.select("role_id").join(near.groupBy("role_id").agg(text.alias("nearest")), "role_id", "left")


def append_role_nodes(nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """node_id, role_id, node_type, cell_id of new marker nodes: ids after the largest, in order of the roles' ids."""
    last = nodes.agg(F.coalesce(F.max("node_id"), F.lit(-1))).first()[0]
    number = F.row_number().over(Window.partitionBy("one").orderBy("role_id")) + F.lit(last)  # the roles of a drawing
    rows = roles.withColumn("one", F.lit(1)).withColumn("new_id", number)
    return rows.select(F.col("new_id").cast("long").alias("node_id"), "role_id", F.col("kind").alias("node_type"), F.concat_ws("_", "kind", F.col("new_id").cast("string")).alias("cell_id"))


def cell_lookup(nodes: DataFrame) -> DataFrame:
    """cell_id, node_id of every cell a node stands for: its own and its sources'."""
    every = F.explode(F.array_distinct(F.array_compact(F.concat(F.array("cell_id"), F.coalesce("source_cell_ids", F.array().cast("array<string>"))))))
    return nodes.select(every.alias("cell_id"), "node_id")


def role_summary(components: DataFrame) -> DataFrame:
    """kind, roles, single (those of one object), suspicious (100 or more, of which three quarters are single)."""
    rows = components.groupBy("kind").agg(F.count("*").alias("roles"), F.count_if(F.col("objects") == 1).alias("single"))
    return rows.withColumn("suspicious", (F.col("roles") >= 100) & (F.col("single") >= F.floor(0.75 * F.col("roles"))))


def union_bounds(boxes: DataFrame, key: str) -> DataFrame:
    """key and the bounds of all its boxes."""
    low, high = box()
    return boxes.groupBy(key).agg(*[F.min(x).alias(f"low_{a}") for a, x in zip(AXES, low, strict=True)], *[F.max(x).alias(f"high_{a}") for a, x in zip(AXES, high, strict=True)])


def assignments(pairs: DataFrame) -> DataFrame:
    """sensor_id, heater_ids (sorted), first_heater_id, distance_mm (the least) of every sensor with heaters."""
    ids = F.sort_array(F.collect_set("heater_id"))
    return pairs.groupBy("sensor_id").agg(ids.alias("heater_ids"), F.min("heater_id").alias("first_heater_id"), F.min("distance_mm").alias("distance_mm"))


def associated_heaters(pairs: DataFrame, sensors: DataFrame, heaters: DataFrame) -> DataFrame:
    """sensor_id, heater_id from all three places that say so: the sensor's list, its one heater, the heaters' own sensor."""
    listed = sensors.select("sensor_id", F.explode("assigned_heater_ids").alias("heater_id"))
    single = sensors.where("assigned_heater_id IS NOT NULL").select("sensor_id", F.col("assigned_heater_id").alias("heater_id"))
    own = heaters.where("assigned_sensor_id IS NOT NULL").select(F.col("assigned_sensor_id").alias("sensor_id"), "heater_id")
    every = listed.unionByName(single).unionByName(own).unionByName(pairs.select("sensor_id", "heater_id")).distinct()
    return every.join(heaters.select("heater_id"), "heater_id", "left_semi").join(sensors.select("sensor_id"), "sensor_id", "left_semi").select("sensor_id", "heater_id")


def normalise_weights(rows: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """Weights that sum to 1 in each key; uniform if any is null, NaN or negative, or all are 0."""
    w, c = Window.partitionBy(key), F.col(weight)
    good = F.every(c.isNotNull() & ~F.isnan(c) & (c >= 0)).over(w) & (F.sum(c).over(w) > 0)
    return rows.withColumn(weight, F.when(good, c / F.sum(c).over(w)).otherwise(F.lit(1.0) / F.count("*").over(w)))


def readout(links: DataFrame, temperatures: DataFrame) -> DataFrame:
    """sensor_id, readout_k: weighted mean of the finite temperatures of a sensor's nodes; null if there are none."""
    t = F.col("temperature_k")
    fine = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    rows = links.join(temperatures, "node_id", "left")
    w = F.sum(F.when(fine, F.col("weight")))
    return rows.groupBy("sensor_id").agg(F.when(w > 0, F.sum(F.when(fine, F.col("weight") * t)) / w).alias("readout_k"))


def inverse_capacity(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """sensor_id, inverse_c: mean of 1 / C over a sensor's nodes with positive capacity."""
    return links.join(nodes, "node_id").where("capacity_j_k > 0").groupBy("sensor_id").agg(F.avg(F.lit(1.0) / F.col("capacity_j_k")).alias("inverse_c"))


def body_neighbours(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """role node and the nodes without a role it shares an edge with."""
    ids = roles.select(F.col("node_id").alias("node")).distinct()
    both = both_ways(edges).join(ids, "node", "left_semi")
    return both.join(ids.withColumnRenamed("node", "other"), "other", "left_anti").select(F.col("node").alias("role_node"), "other").distinct()


def sensor_nodes(explicit: DataFrame, direct: DataFrame, inherited: DataFrame) -> DataFrame:
    """sensor_id, node_id: the explicit set, else the direct one, else the inherited one of each sensor."""
    rows = None
    for level, df in enumerate((explicit, direct, inherited)):
        part = df.select("sensor_id", "node_id").withColumn("level", F.lit(level))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("sensor_id").agg(F.min("level").alias("level"))
    return rows.join(best, ["sensor_id", "level"]).select("sensor_id", "node_id").distinct()


def assign_pair(pairs: DataFrame, heater_id: int, sensor_id: int, distance_mm: float) -> DataFrame:
    """Pairs after a manual assignment: both sides lose what they had."""
    new = pairs.sparkSession.createDataFrame([(heater_id, sensor_id, distance_mm)], pairs.select("heater_id", "sensor_id", "distance_mm").schema)
    return pairs.where((F.col("heater_id") != heater_id) & (F.col("sensor_id") != sensor_id)).unionByName(new)


def deposit(commands: DataFrame, weights: DataFrame) -> DataFrame:
    """node_id, power_w: each heater's command spread over its nodes by weight."""
    return commands.join(weights, "heater_id").groupBy("node_id").agg(F.sum(F.col("power_w") * F.col("weight")).alias("power_w"))


def triangle_hits(pairs: DataFrame) -> DataFrame:
    """The (triangle, cell) pairs whose triangle meets the cell's box, by separating axes.

    pairs: tri (array of nine doubles), cx, cy, cz, sx, sy, sz and any more columns, which stay. Vectorised over Arrow
    batches: thirteen axes for all pairs at once.
    """
    ship_package(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from caloris.functions.boxes import triangles_meet_boxes

        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(triangles_meet_boxes(batch)))

    return pairs.mapInArrow(run, pairs.schema)
