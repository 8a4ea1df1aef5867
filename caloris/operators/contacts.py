"""Spatial joins between cells, and the conductances that follow from them.

Cells have node_id, cx, cy, cz, sx, sy, sz (mm), component and material. All joins are equi-joins on integer buckets (see
spatial), so they shuffle by key and scale with the number of contacts, not with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caloris.functions import physics as P
from caloris.operators.spatial import AXES, corners, self_pairs, with_corners


def bucket_size(cells: DataFrame, gap_mm: float) -> float:
    """Median of the cells' shortest edges plus the gap."""
    m = cells.agg(F.percentile(F.least("sx", "sy", "sz"), F.lit(0.5)).alias("m")).first()["m"]
    return max(float(m or 1.0) + gap_mm, 1e-6)


def candidate_pairs(cells: DataFrame, gap_mm: float = 0.0) -> DataFrame:
    """Every pair of cells whose boxes, grown by the gap, meet: columns a_* and b_* with a_node_id < b_node_id."""
    return self_pairs(with_corners(cells), gap_mm / 2 + P.TOUCH_MM, "node_id")


def _distance() -> Column:
    return P.norm([F.col(f"a_c{a}") - F.col(f"b_c{a}") for a in AXES])


def shared_faces(pairs: DataFrame) -> DataFrame:
    """Pairs that touch along exactly one axis and overlap along the others: area_mm2, distance_mm."""
    (al, ah), (bl, bh) = corners("a_"), corners("b_")
    g, o = P.gaps(al, ah, bl, bh), P.overlaps(al, ah, bl, bh)
    touch = [F.abs(x) <= P.TOUCH_MM for x in g]
    apart = [(x > 0) & ~t for x, t in zip(g, touch, strict=True)]
    n = sum((t.cast("int") for t in touch[1:]), touch[0].cast("int"))
    area = F.when(touch[0], o[1] * o[2]).when(touch[1], o[0] * o[2]).otherwise(o[0] * o[1])
    out = pairs.where((n == 1) & ~(apart[0] | apart[1] | apart[2]))
    return out.withColumns({"area_mm2": F.greatest(area, F.lit(0.0)), "distance_mm": _distance()}).where("area_mm2 > 0")


def near_faces(pairs: DataFrame, gap_mm: float) -> DataFrame:
    """Pairs at most gap_mm apart along one axis at most, with positive overlap along the other two."""
    (al, ah), (bl, bh) = corners("a_"), corners("b_")
    named = {f"_g{n}": F.greatest(x, F.lit(0.0)) for n, x in enumerate(P.gaps(al, ah, bl, bh))} | {f"_o{n}": x for n, x in enumerate(P.overlaps(al, ah, bl, bh))}
    # a generator of one row computes gaps and overlaps once; inlined into each use they would be too much to compile
    rows = pairs.withColumn("_m", F.explode(F.array(F.struct(*[x.alias(n) for n, x in named.items()]))))
    pos, o = [F.col(f"_m._g{n}") for n in range(3)], [F.col(f"_m._o{n}") for n in range(3)]
    count = lambda flags: flags[0].cast("int") + flags[1].cast("int") + flags[2].cast("int")
    rows = rows.withColumn("_apart", count([x > P.TOUCH_MM for x in pos])).withColumn("_touch", count([F.abs(x) <= P.TOUCH_MM for x in o]))
    rows = rows.where((P.norm(pos) <= gap_mm) & ((F.col("_apart") == 1) | ((F.col("_apart") == 0) & (F.col("_touch") == 1))))
    # the axis of the face: the one that is apart, else the one that touches
    face = F.lit(2)
    for n in (1, 0):
        face = F.when(F.when(F.col("_apart") == 1, pos[n] > P.TOUCH_MM).otherwise(F.abs(o[n]) <= P.TOUCH_MM), F.lit(n)).otherwise(face)
    rows = rows.withColumn("_face", face)
    p = F.when(F.col("_face") == 0, o[1]).otherwise(o[0])
    q = F.when(F.col("_face") == 2, o[1]).otherwise(o[2])
    out = rows.where((p > 0) & (q > 0)).withColumns({"area_mm2": p * q, "gap_mm": P.norm(pos), "distance_mm": _distance()})
    return out.drop("_m", "_apart", "_touch", "_face")


def typed_edges(contacts: DataFrame, *, near: bool = False, interface: float = P.INTERFACE_W_M2K) -> DataFrame:
    """Edges with type, confidence and conductance; contacts also have a_k and b_k (W/mK). Non-conducting pairs go."""
    same_part, same_material = F.col("a_component") == F.col("b_component"), F.col("a_material") == F.col("b_material")
    k, d = (F.col("a_k"), F.col("b_k")), (F.col("area_mm2"), F.col("distance_mm"))
    g = F.when(same_part, P.contact_conductance(*k, *d)).otherwise(P.contact_conductance(*k, *d, F.lit(interface)))
    names = ("near_internal_conduction", "near_same_material_contact", "near_component_contact") if near else ("internal_conduction", "same_material_spatial", "uncertain_contact")
    sure = ("medium", "medium", "low") if near else ("high", "medium", "low")
    pick = lambda v: F.when(same_part, v[0]).when(same_material, v[1]).otherwise(v[2])
    return contacts.select(
        F.col("a_node_id").alias("node_i"), F.col("b_node_id").alias("node_j"), pick(names).alias("edge_type"), g.alias("g_w_k"),
        (F.col("area_mm2") * 1e-6).alias("shared_area_m2"), (F.col("distance_mm") * 1e-3).alias("distance_m"), pick(sure).alias("contact_confidence"),
        F.lit("geometry_contact_distance" if near else "geometry").alias("source"),
    ).where("g_w_k > 0")


def without_pairs(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose pair of nodes is not connected yet."""
    return edges.join(known.select("node_i", "node_j"), ["node_i", "node_j"], "left_anti")


def plane_contacts(cells: DataFrame, tolerance_mm: float = P.TOUCH_MM) -> DataFrame:
    """Contacts by matching high faces with low faces of the same plane; a plane's faces are tiled, so a large plane is
    many keys: node_i, node_j, axis, area_mm2."""
    out = None
    size = bucket_size(cells, 0.0) * 4
    for n, axis in enumerate(AXES):
        u, v = [a for a in AXES if a != axis]
        def tiles(c: str) -> Column:
            return F.sequence(F.floor((F.col(f"c{c}") - F.col(f"s{c}") / 2) / size).cast("long"), F.floor((F.col(f"c{c}") + F.col(f"s{c}") / 2) / size).cast("long"))
        rows = cells.withColumn("tu", F.explode(tiles(u))).withColumn("tv", F.explode(tiles(v)))
        face = lambda sign, p, rows=rows, axis=axis, u=u, v=v: rows.select(
            F.round((F.col(f"c{axis}") + sign * F.col(f"s{axis}") / 2) / 1e-7).cast("long").alias("plane"), "tu", "tv", F.col("node_id").alias(f"{p}_id"),
            *[(F.col(f"c{w}") + s * F.col(f"s{w}") / 2).alias(f"{p}_{w}{e}") for w in (u, v) for s, e in ((-1, "l"), (1, "h"))],
        )
        both = face(1, "p").join(face(-1, "q"), ["plane", "tu", "tv"])
        lo = {w: F.greatest(f"p_{w}l", f"q_{w}l") for w in (u, v)}
        width = {w: F.least(f"p_{w}h", f"q_{w}h") - lo[w] for w in (u, v)}
        once = (F.floor(lo[u] / size).cast("long") == F.col("tu")) & (F.floor(lo[v] / size).cast("long") == F.col("tv"))
        rows = both.where(once & (width[u] > tolerance_mm) & (width[v] > tolerance_mm)).select(F.least("p_id", "q_id").alias("node_i"), F.greatest("p_id", "q_id").alias("node_j"), F.lit(n).alias("axis"), (width[u] * width[v]).alias("area_mm2"))
        out = rows if out is None else out.unionByName(rows)
    return out


def grid_edges(cells: DataFrame) -> DataFrame:
    """Edges between neighbours of an integer grid (columns i, j, k): one shifted equi-join over three directions."""
    shifted = cells.withColumn("d", F.explode(F.array(*[F.array(*[F.lit(int(n == m)) for m in range(3)]) for n in range(3)])))
    shifted = shifted.select(F.col("node_id").alias("p"), (F.col("i") + F.col("d")[0]).alias("i"), (F.col("j") + F.col("d")[1]).alias("j"), (F.col("k") + F.col("d")[2]).alias("k"))
    met = shifted.join(cells.select("node_id", "i", "j", "k"), ["i", "j", "k"])
    return met.select(F.least("p", "node_id").alias("node_i"), F.greatest("p", "node_id").alias("node_j"))


def exposed_area(cells: DataFrame, faces: DataFrame) -> DataFrame:
    """node_id, exposed_mm2: each cell's surface less what it shares; faces have a_node_id, b_node_id, area_mm2."""
    ends = F.explode(F.array(F.col("a_node_id"), F.col("b_node_id")))
    shared = faces.select(ends.alias("node_id"), "area_mm2").groupBy("node_id").agg(F.sum("area_mm2").alias("shared"))
    whole = 2.0 * (F.col("sx") * F.col("sy") + F.col("sx") * F.col("sz") + F.col("sy") * F.col("sz"))
    return cells.join(shared, "node_id", "left").select("node_id", F.greatest(F.lit(0.0), whole - F.coalesce("shared", F.lit(0.0))).alias("exposed_mm2"))


def cell_nodes(cells: DataFrame) -> DataFrame:
    """Solid cells (those with a dominant component) as nodes: volume_m3, mass_kg and capacity_j_k by the largest share of
    `occupancy`, and the linear radiative conductance of the exposed surface with its resistance (null for none).

    cells have their material's density_kg_m3, cp_j_kgk and emissivity, occupancy (a map) and exposed_mm2.
    """
    volume = F.col("sx") * F.col("sy") * F.col("sz") * 1e-9
    share = F.coalesce(F.array_max(F.map_values("occupancy")), F.lit(0.0))
    g = P.radiation_linear(F.col("emissivity"), F.col("exposed_mm2") * 1e-6)
    rows = cells.where("coalesce(dominant_component, '') <> ''").withColumns({"volume_m3": volume, "mass_kg": F.col("density_kg_m3") * volume * share, "g_rad_w_k": g})
    return rows.withColumns({"capacity_j_k": F.col("mass_kg") * F.col("cp_j_kgk"), "r_rad_k_w": F.when(F.col("g_rad_w_k") > 0, 1.0 / F.col("g_rad_w_k"))})


def coarse_neighbours(cells: DataFrame, ratio: float) -> DataFrame:
    """node_id of cells that touch a solid cell more than `ratio` times smaller."""
    pairs = candidate_pairs(cells, 0.0)
    size = lambda p: F.greatest(*[F.col(f"{p}_s{a}") for a in AXES])
    coarse = F.when(size("a") > size("b") * ratio, F.col("a_node_id")).when(size("b") > size("a") * ratio, F.col("b_node_id"))
    return pairs.select(coarse.alias("node_id")).where("node_id IS NOT NULL").distinct()


def overlapping_boxes(boxes: DataFrame) -> DataFrame:
    """Unordered pairs of boxes with a common inside."""
    (al, ah), (bl, bh) = corners("a_"), corners("b_")
    o = P.overlaps(al, ah, bl, bh)
    return candidate_pairs(boxes, 0.0).where((o[0] > 0) & (o[1] > 0) & (o[2] > 0)).select(F.col("a_node_id").alias("node_i"), F.col("b_node_id").alias("node_j"))
