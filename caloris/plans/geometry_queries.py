"""Queries over cells: materials, contacts, conductances, exposure, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caloris.functions import physics as P
from caloris.operators import build, contacts, materials, octree, roles
from caloris.plans import views
from caloris.plans.registry import Registry
from caloris.plans.views import sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with their material's properties, mass_kg and capacity_j_k."""
    rows = materials.resolve(views.cells(spark, sf_dir), views.materials(spark), default="DEFAULT")
    mass = F.col("density_kg_m3") * (F.col("sx") * F.col("sy") * F.col("sz") * 1e-9)
    return rows.withColumn("mass_kg", mass).withColumn("capacity_j_k", mass * F.col("cp_j_kgk"))


def grid_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid edges with the conductance of two half cubes."""
    p = props(spark, sf_dir).select("node_id", (F.col("sx") * 1e-3).alias("side"), F.col("k_w_mk").alias("k"))
    e = contacts.grid_edges(views.cells(spark, sf_dir))
    rows = e.join(p.toDF("node_i", "side_i", "k_i"), "node_i").join(p.toDF("node_j", "side_j", "k_j"), "node_j")
    return rows.select("node_i", "node_j", P.cubic_conductance(F.col("k_i"), F.col("k_j"), F.col("side_i"), F.col("side_j")).alias("g_w_k"))


def with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as the contact operators take them, with k."""
    cols = ["node_id", *[f"{c}{a}" for c in "cs" for a in "xyz"], "component"]
    return props(spark, sf_dir).select(*cols, F.col("resolved_material").alias("material"), F.col("k_w_mk").alias("k"))


@query(sql("cells mats props", "SELECT node_id, component, resolved AS material, resolved <> material AS fell_back, round(mass, 9) AS mass_kg, round(cap, 6) AS capacity_j_k FROM props"))
def cell_thermal_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir).select("node_id", "component", F.col("resolved_material").alias("material"), "fell_back", F.round("mass_kg", 9).alias("mass_kg"), F.round("capacity_j_k", 6).alias("capacity_j_k"))


@query(sql("cells mats props grid gedges", "SELECT node_i, node_j, round(g, 6) AS g_w_k FROM gedges"))
def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_conductance(spark, sf_dir).select("node_i", "node_j", F.round("g_w_k", 6).alias("g_w_k"))


_PAIR = """SELECT node_i, node_j, CASE WHEN a.component = b.component THEN '{0}' WHEN a.resolved = b.resolved THEN '{1}' ELSE '{2}' END AS edge_type,
    CASE WHEN a.component = b.component THEN '{3}' WHEN a.resolved = b.resolved THEN '{4}' ELSE 'low' END AS contact_confidence,
    round(1 / (0.005::DOUBLE / (a.kc * {5}) + 0.005::DOUBLE / (b.kc * {5}) + CASE WHEN a.component = b.component THEN 0 ELSE 1 / (1e4::DOUBLE * {5}) END), 6) AS g_w_k
    FROM grid JOIN props a ON a.node_id = node_i JOIN props b ON b.node_id = node_j WHERE {6}"""


@query(sql("cells mats props grid", _PAIR.format("internal_conduction", "same_material_spatial", "uncertain_contact", "high", "medium", "1e-4::DOUBLE", "a.s = 10 AND b.s = 10")))
def face_contact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = contacts.shared_faces(contacts.candidate_pairs(with_k(spark, sf_dir)))
    return contacts.typed_edges(faces).select("node_i", "node_j", "edge_type", "contact_confidence", F.round("g_w_k", 6).alias("g_w_k"))


@query(sql("cells mats props grid", _PAIR.format("near_internal_conduction", "near_same_material_contact", "near_component_contact", "medium", "medium", "36e-6::DOUBLE", "NOT (a.s = 10 AND b.s = 10)")))
def near_contact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = with_k(spark, sf_dir)
    edges = build.contact_edges(cells, 4.5).where("source = 'geometry_contact_distance'")
    return edges.select("node_i", "node_j", "edge_type", "contact_confidence", F.round("g_w_k", 6).alias("g_w_k"))


@query(f"""SELECT (SELECT count(*) FROM ({ORACLES['cell_thermal_props']})) AS nodes, (SELECT count(*) FROM ({ORACLES['face_contact_edges']})) AS exact_edges, (SELECT count(*) FROM ({ORACLES['near_contact_edges']})) AS near_edges,
    (SELECT round(sum(g_w_k), 2) FROM (SELECT g_w_k FROM ({ORACLES['face_contact_edges']}) UNION ALL SELECT g_w_k FROM ({ORACLES['near_contact_edges']}))) AS total_g_w_k, (SELECT round(sum(capacity_j_k), 3) FROM ({ORACLES['cell_thermal_props']})) AS capacity_j_k, CAST(0 AS BIGINT) AS violations""")
def built_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build from cells to a checked graph, in one row."""
    g = build.thermal_graph(views.cells(spark, sf_dir), views.materials(spark), gap_mm=4.5, default="DEFAULT", role_boxes=views.roles(spark, sf_dir), tolerance_mm=2.0)
    exact = F.col("source") == "geometry"
    near = F.col("source") == "geometry_contact_distance"
    e = g.edges.agg(F.count_if(exact).alias("exact_edges"), F.count_if(near).alias("near_edges"), F.round(F.sum(F.round(F.when(exact | near, F.col("g_w_k")), 6)), 2).alias("total_g_w_k"))
    n = g.nodes.agg(F.count("*").alias("nodes"), F.round(F.sum(F.round("capacity_j_k", 6)), 3).alias("capacity_j_k"))
    v = g.violations.agg(F.count("*").alias("violations"))
    one = F.lit(1).alias("one")
    return n.select("*", one).join(e.select("*", one), "one").join(v.select("*", one), "one").select("nodes", "exact_edges", "near_edges", "total_g_w_k", "capacity_j_k", "violations")


@query(sql("cells grid", "SELECT node_i, node_j, axis, 100.0::DOUBLE AS area_mm2 FROM grid JOIN cells a ON a.node_id = node_i JOIN cells b ON b.node_id = node_j WHERE a.s = 10 AND b.s = 10"))
def plane_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.plane_contacts(views.cells(spark, sf_dir)).select("node_i", "node_j", "axis", F.round("area_mm2", 6).alias("area_mm2"))


@query(sql("cells mats props grid", """, f AS (SELECT node_i, node_j FROM grid JOIN cells a ON a.node_id = node_i JOIN cells b ON b.node_id = node_j WHERE a.s = 10 AND b.s = 10),
    n AS (SELECT node, count(*) AS c FROM (SELECT node_i AS node FROM f UNION ALL SELECT node_j FROM f) GROUP BY 1)
    SELECT node_id, round(greatest(0, 6 * s * s - 100 * coalesce(c, 0)), 6) AS exposed_mm2, round(4 * eps * 5.670374419e-8::DOUBLE * (greatest(0, 6 * s * s - 100 * coalesce(c, 0)) * 1e-6) * 293.15::DOUBLE ** 3, 9) AS g_rad_w_k,
           greatest(0, 6 * s * s - 100 * coalesce(c, 0)) > 0 AS is_exposed FROM props LEFT JOIN n ON node = node_id"""))
def exposed_area_radiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = with_k(spark, sf_dir)
    area = contacts.exposed_area(cells, contacts.shared_faces(contacts.candidate_pairs(cells)))
    g = P.radiation_linear(F.col("emissivity"), F.col("exposed_mm2") * 1e-6)
    return props(spark, sf_dir).select("node_id", "emissivity").join(area, "node_id").select("node_id", F.round("exposed_mm2", 6).alias("exposed_mm2"), F.round(g, 9).alias("g_rad_w_k"), (F.col("exposed_mm2") > 0).alias("is_exposed"))


@query(sql("cells grid", """, t AS (SELECT a.node_id AS x, b.node_id AS y, a.s AS sa, b.s AS sb FROM cells a JOIN cells b ON a.s = 10 AND b.s = 6 AND abs(a.cx - b.cx) <= 10 AND abs(a.cy - b.cy) <= 10 AND abs(a.cz - b.cz) <= 10)
    SELECT DISTINCT x AS node_id FROM t"""))
def leaf_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large cells, grown to 14 mm so that they touch the small ones, beside a cell more than twice smaller."""
    grown = views.cells(spark, sf_dir).withColumns({f"s{a}": F.when(F.col(f"s{a}") > 6, 14.0).otherwise(6.0) for a in "xyz"})
    return contacts.coarse_neighbours(grown, 2.0)


@query(sql("cells", """SELECT a.node_id AS node_i, b.node_id AS node_j FROM cells a JOIN cells b ON a.node_id < b.node_id AND abs(a.cx - b.cx) < (a.s + b.s) * 0.7 AND abs(a.cy - b.cy) < (a.s + b.s) * 0.7 AND abs(a.cz - b.cz) < (a.s + b.s) * 0.7"""))
def overlapping_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of overlapping boxes after growing every cell by 0.4 of its size."""
    grown = views.cells(spark, sf_dir).select("node_id", "cx", "cy", "cz", *[(F.col(f"s{a}") * 1.4).alias(f"s{a}") for a in "xyz"])
    return contacts.overlapping_boxes(grown)


@query(sql("cells roles near", "SELECT role_id, node_id, round(gap, 6) AS gap_mm, round(area, 6) AS area_mm2 FROM near WHERE gap <= 3"))
def role_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = roles.contacts(views.roles(spark, sf_dir), views.cells(spark, sf_dir), 3.0)
    return c.select("role_id", "node_id", F.round("gap_mm", 6).alias("gap_mm"), F.round("area_mm2", 6).alias("area_mm2"))


@query(sql("cells roles near", "SELECT role_id, node_id, CAST(r AS INTEGER) AS rank, round(gap, 6) AS gap_mm FROM (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY gap, dist, CAST(node_id AS VARCHAR)) AS r FROM near) WHERE r <= 3"))
def role_nearest3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.nearest_cells(views.roles(spark, sf_dir), views.cells(spark, sf_dir), 6.0).select("role_id", "node_id", "rank", F.round("gap_mm", 6).alias("gap_mm"))


@query(sql("cells roles near", """SELECT role_id, node_id, round(greatest(area, 1) / sum(greatest(area, 1)) OVER (PARTITION BY role_id), 6) AS weight
    FROM (SELECT *, min(gap) OVER (PARTITION BY role_id) AS m FROM near) WHERE gap <= m + 1e-9"""))
def deposition_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = roles.deposit_weights(roles.contacts(views.roles(spark, sf_dir), views.cells(spark, sf_dir), 6.0))
    return w.select("role_id", "node_id", F.round("weight", 6).alias("weight"))


@query(sql("cells roles near", "SELECT role_id, CAST(CASE WHEN min(gap) <= 0.5 THEN 0 WHEN min(gap) <= 1 THEN 1 WHEN min(gap) <= 2 THEN 2 WHEN min(gap) <= 4 THEN 3 ELSE 4 END AS INTEGER) AS rung FROM near GROUP BY role_id"))
def contact_tolerance_rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.tolerance_rung(roles.contacts(views.roles(spark, sf_dir), views.cells(spark, sf_dir), 6.0), 0.5, 2.0, 6.0)


_CANDIDATES = """SELECT h.role_id AS heater_id, s.role_id AS sensor_id, round(sqrt(greatest(abs(h.cx - s.cx) - 4, 0) ** 2 + greatest(abs(h.cy - s.cy) - 4, 0) ** 2 + greatest(abs(h.cz - s.cz) - 4, 0) ** 2), 6) AS distance_mm
    FROM roles h JOIN roles s ON h.kind = 'heater' AND s.kind = 'sensor' AND sqrt(greatest(abs(h.cx - s.cx) - 4, 0) ** 2 + greatest(abs(h.cy - s.cy) - 4, 0) ** 2 + greatest(abs(h.cz - s.cz) - 4, 0) ** 2) <= 40"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.roles(spark, sf_dir)
    c = roles.pair_candidates(r.where("kind = 'heater'"), r.where("kind = 'sensor'"), 40.0)
    return c.withColumn("distance_mm", F.round("distance_mm", 6))


@query(sql("roles", _CANDIDATES))
def heater_sensor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


@query()
def heater_sensor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.greedy_pairs(_candidates(spark, sf_dir), capacity=1)


@query(f"WITH RECURSIVE {views.CTES['roles']}, e AS (SELECT a.role_id AS a, b.role_id AS b FROM roles a JOIN roles b ON a.kind = b.kind AND replace(a.name, '_mesh', '') = replace(b.name, '_mesh', '') AND sqrt(greatest(abs(a.cx - b.cx) - 4, 0) ** 2 + greatest(abs(a.cy - b.cy) - 4, 0) ** 2 + greatest(abs(a.cz - b.cz) - 4, 0) ** 2) <= 30), "
       "r(n, m) AS (SELECT role_id, role_id FROM roles UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m) SELECT n AS role_id, min(m) AS label FROM r GROUP BY n")
def role_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.roles(spark, sf_dir).withColumn("name", F.regexp_replace("name", "_mesh$", ""))
    return roles.clusters(r, 30.0)


@query()
def role_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.collapse(views.roles(spark, sf_dir), 30.0)


@query("""WITH pts AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    lv AS (SELECT unnest(range(0, 4)) AS level),
    k AS (SELECT level, CAST(least(greatest(floor((x + 4) / 8 * (1 << level)), 0), (1 << level) - 1) AS BIGINT) AS i, CAST(least(greatest(floor((y + 4) / 8 * (1 << level)), 0), (1 << level) - 1) AS BIGINT) AS j,
                 CAST(least(greatest(floor((z + 4) / 8 * (1 << level)), 0), (1 << level) - 1) AS BIGINT) AS m FROM pts, lv),
    c AS (SELECT CAST(level AS INTEGER) AS level, i, j, m, count(*) AS points FROM k GROUP BY ALL),
    up AS (SELECT c.*, p.points AS above FROM c LEFT JOIN c p ON p.level = c.level - 1 AND p.i = c.i // 2 AND p.j = c.j // 2 AND p.m = c.m // 2)
    SELECT level, CAST(i * (1 << level) * (1 << level) + j * (1 << level) + m AS BIGINT) AS key, CAST(points AS BIGINT) AS points FROM up
    WHERE (level = 0 OR above > 20) AND (points <= 20 OR level = 3)""")
def octree_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[n].cast("double").alias(a) for n, a in enumerate("xyz")])
    return octree.point_octree(e, (-4.0, -4.0, -4.0, 8.0), 20, 3)


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triangle beside every part's cell."""
    c = views.cells(spark, sf_dir, None)
    corners = F.array(F.col("cx") - 3, F.col("cy") - 3, F.col("cz"), F.col("cx") + 3, F.col("cy") - 3, F.col("cz"), F.col("cx"), F.col("cy") + 3, F.col("cz") + 2.0)
    return c.select("component", corners.alias("tri"))


@query()
def surface_octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of surface octrees over all triangles, by level: one root of 320 mm for each 320 mm of height."""
    tri = _triangles(spark, sf_dir)
    high = tri.agg(F.max(F.greatest(*[F.col("tri")[n] for n in (2, 5, 8)]))).first()[0] or 0.0
    stacked = spark.range(int((high + 160.0) // 320.0) + 1)
    root = stacked.select(F.format_string("r%d-", "id").alias("cell_id"), F.lit(0).alias("level"), F.lit(100.0).alias("cx"), F.lit(100.0).alias("cy"), (F.col("id") * 320.0).alias("cz"), *[F.lit(320.0).alias(f"s{a}") for a in "xyz"])
    leaves = octree.build(tri, root, max_size_mm=20.0, max_depth=4)
    return octree.histograms(leaves).where("level IS NOT NULL").select("level", "leaves", "solid")


@query(sql("cells", "SELECT level, CAST(count(*) AS BIGINT) AS leaves, CAST(count(component) AS BIGINT) AS solid, s AS size_mm FROM cells GROUP BY GROUPING SETS ((level), (s), ())"))
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.histograms(views.cells(spark, sf_dir))


@query(sql("cells", "SELECT node_id AS cell, (n * 8 + d) AS child, cx + (2 * (d // 4) - 1) * s / 4 AS x, cy + (2 * (d // 2 % 2) - 1) * s / 4 AS y, cz + (2 * (d % 2) - 1) * s / 4 AS z, s / 2 AS size_mm, level + 1 AS level FROM (SELECT *, node_id % 4 AS n, unnest(range(0, 8)) AS d FROM cells)"))
def subdivision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's eight children: numbers, centres and sizes."""
    c = views.cells(spark, sf_dir).withColumn("cell_id", F.concat((F.col("node_id") % 4).cast("string"), F.lit("_"), F.col("node_id").cast("string"), F.lit("_")))
    kids = octree.subdivide(c)
    parts = F.split("cell_id", "_")
    return kids.select(parts[1].cast("long").alias("cell"), (parts[0].cast("long") * 8 + parts[2].cast("long")).alias("child"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), F.col("sx").alias("size_mm"), "level")


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, round(greatest(0, CASE WHEN p_size % 7 = 0 THEN 120 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 7500 + 250 * (p_size % 4) ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 90 + 5 * (p_size % 4) ELSE 0 END
    + CASE WHEN p_size > 30 THEN least(80.0::DOUBLE, 10 + 0.25::DOUBLE * p_size) ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 45 + 35 ELSE 0 END + CASE WHEN p_size % 11 = 0 THEN 25 ELSE 0 END + CASE WHEN p_size % 4 = 1 THEN 20 ELSE 0 END
    + CASE WHEN p_size > 25 THEN 10000 + 100 * p_size::DOUBLE / 25 ELSE 0 END + CASE WHEN p_size < 5 THEN 5 ELSE 0 END - CASE WHEN p_size % 4 <= 1 AND p_size % 6 = 0 THEN 15 ELSE 0 END), 6) AS score,
    CASE WHEN p_size % 3 = 0 AND p_size % 6 = 0 THEN 'surface_and_watertight_inside' WHEN p_size % 3 = 0 THEN 'triangle_surface_intersection' WHEN p_size % 6 = 0 THEN 'watertight_point_containment'
         WHEN p_size % 4 > 0 THEN 'near_surface_empty' WHEN p_size < 30 THEN 'bbox_only_empty' ELSE 'empty' END AS reason,
    CASE WHEN NOT (p_size % 3 = 0) THEN CASE WHEN p_size < 30 THEN 'low' ELSE 'high' END WHEN p_size % 6 = 0 THEN 'high' WHEN p_size / 50.0 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence,
    round(CASE WHEN p_size % 2 = 0 THEN 3.0 ELSE 0.5 * p_size END, 6) AS margin_mm FROM part""")
def refinement_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    mod = lambda n, r=0: p % n == r
    score = P.refinement_score(role=mod(7), gap=mod(5), multi=mod(3), complex_=p > 30, crowded=F.lit(False), parts=mod(2), materials=mod(2), contrast=mod(11), surface_needed=mod(4, 1), occupied=p > 0, bbox_only=p < 5, inside=mod(6), surface=F.lit(False), near_count=p % 4, crowded_count=F.lit(0), tests=p, size_mm=p.cast("double"), max_size_mm=25.0)
    return views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("long").alias("id"), F.round(score, 6).alias("score"), P.acceptance_reason(mod(3), mod(6), p % 4 > 0, p < 30).alias("reason"),
        P.confidence(mod(3), mod(3), mod(6), p / 50.0, p < 30, 0.5).alias("confidence"), F.round(P.crowded_margin(F.when(mod(2), 3.0).otherwise(0.0), F.lit(0.5), p.cast("double")), 6).alias("margin_mm"),
    )
