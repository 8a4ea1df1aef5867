"""Queries over matrices, their checks and repair, material defaults, and why cells are refined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caloris.functions import physics as P
from caloris.operators import adaptive, graph, materials, matrices, reports
from caloris.plans import views
from caloris.plans.geometry_queries import grid_conductance, props
from caloris.plans.registry import Registry, rounded
from caloris.plans.views import sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_SEEDED = """, v AS (SELECT node_id + CASE WHEN node_id % 61 = 0 THEN 1000000 ELSE 0 END AS id, CASE WHEN node_id % 67 = 0 THEN NULL ELSE i END AS i, CASE WHEN node_id % 71 = 0 THEN -1.0::DOUBLE ELSE cap END AS c, CASE WHEN node_id % 73 = 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM props
      UNION ALL SELECT node_id, i, cap, 0.0::DOUBLE FROM props WHERE node_id % 79 = 1),
    gm AS (SELECT node AS r, other AS c, CASE WHEN node < other AND (node + other) % 83 = 5 THEN -g WHEN node < other AND (node + other) % 89 = 7 THEN g * 1.5 ELSE g END AS v FROM ends),
    ids AS (SELECT 'missing_id' AS rule, CAST(node_id AS VARCHAR) AS subject FROM cells WHERE node_id NOT IN (SELECT id FROM v) UNION ALL SELECT DISTINCT 'unknown_id', CAST(id AS VARCHAR) FROM v WHERE id NOT IN (SELECT node_id FROM cells)
      UNION ALL SELECT 'repeated_id', CAST(id AS VARCHAR) FROM v GROUP BY id HAVING count(*) > 1),
    g AS (SELECT DISTINCT 'g_outside' AS rule, r || '-' || c AS subject FROM gm WHERE r NOT IN (SELECT id FROM v) OR c NOT IN (SELECT id FROM v) UNION ALL SELECT 'g_asymmetric', r || '-' || c FROM gm WHERE r < c AND ((r + c) % 83 = 5 OR (r + c) % 89 = 7) UNION ALL SELECT 'negative_conductance', r || '-' || c FROM gm WHERE v < 0)"""


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, n = props(spark, sf_dir), F.col("node_id")
    one = lambda c, v: F.when(c, F.lit(v).cast("double"))
    v = p.select((n + F.when(n % 61 == 0, 1000000).otherwise(0)).alias("node_id"), F.when(n % 67 != 0, F.col("i")).alias("i"), "j", "k", one(n % 71 == 0, -1.0).otherwise(F.col("capacity_j_k")).alias("capacity_j_k"), one(n % 73 == 0, -1.0).otherwise(F.lit(0.0)).alias("g_rad_w_k"))
    v = v.unionByName(p.where("node_id % 79 = 1").select("node_id", "i", "j", "k", "capacity_j_k", F.lit(0.0).alias("g_rad_w_k")))
    both = graph.both_ways(grid_conductance(spark, sf_dir), "g_w_k")
    a, b, g = F.col("node"), F.col("other"), F.col("g_w_k")
    return p, v, both.select(a.alias("row"), b.alias("col"), F.when((a < b) & ((a + b) % 83 == 5), -g).when((a < b) & ((a + b) % 89 == 7), g * 1.5).otherwise(g).alias("value"))


@query(sql("cells mats props grid gedges ends", _SEEDED + """ SELECT * FROM ids UNION ALL SELECT * FROM g UNION ALL SELECT 'bad_coordinate', CAST(id AS VARCHAR) FROM v WHERE i IS NULL UNION ALL SELECT 'negative_capacity', CAST(id AS VARCHAR) FROM v WHERE c < 0
    UNION ALL SELECT 'negative_radiation', CAST(id AS VARCHAR) FROM v WHERE r < 0 UNION ALL SELECT 'l_outside', subject FROM g WHERE rule = 'g_outside' UNION ALL SELECT 'l_asymmetric', subject FROM g WHERE rule = 'g_asymmetric' AND CAST(split_part(subject, '-', 1) AS BIGINT) % 97 <> 0
    UNION ALL SELECT 'l_not_finite', r || '-' || c FROM gm WHERE r % 97 = 0 OR c % 97 = 0"""))
def matrix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a graph's matrices, with seeded defects."""
    p, v, g = _seeded(spark, sf_dir)
    lap = g.withColumn("value", F.when((F.col("row") % 97 == 0) | (F.col("col") % 97 == 0), float("nan")).otherwise(-F.col("value")))
    found = matrices.check_matrices(v, g, lap, p)
    return found.where("NOT (rule = 'l_asymmetric' AND cast(split(subject, '-')[1] AS bigint) % 97 = 0)")


@query(sql("cells mats props grid gedges ends", _SEEDED + " SELECT * FROM ids UNION ALL SELECT * FROM g"))
def conductance_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a matrix from being taken as the graph's conductances."""
    p, v, g = _seeded(spark, sf_dir)
    return matrices.check_conductance(v, g, p)


@query(sql("cells mats props grid gedges", """SELECT 'empty' AS kind, node_i, node_j, round(g, 6) AS g_w_k FROM gedges UNION ALL SELECT 'conducting', node_i, node_j, 1.0::DOUBLE FROM gedges WHERE node_i % 2 = 0
    UNION ALL SELECT 'loaded', node_i, node_j, 0.0::DOUBLE FROM gedges WHERE node_i % 3 = 0 UNION ALL SELECT 'shown', node_i, node_j, round(g, 6) FROM gedges UNION ALL SELECT 'shown', node_i, node_j, 0.0::DOUBLE FROM gedges WHERE node_i % 3 = 0"""))
def repaired_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after repair: of a graph without any, one that conducts, a loaded one, and one that only shows contacts."""
    n = props(spark, sf_dir).select("node_id", "i", "j", "k", (F.col("sx") * 1e-3).alias("side_m"), "k_w_mk")
    e = grid_conductance(spark, sf_dir).select("node_i", "node_j", F.lit(1.0).alias("g_w_k"), F.lit("grid").alias("edge_type"), F.lit("auto").alias("source"))
    shown = e.where("node_i % 3 = 0").withColumns({"g_w_k": F.lit(0.0), "edge_type": F.lit("role_node_contact")})
    cases = {"empty": (e.limit(0), "auto"), "conducting": (e.where("node_i % 2 = 0"), "auto"), "loaded": (shown, "loaded_G"), "shown": (shown, "auto")}
    out = None
    for kind, (edges, mode) in cases.items():
        rows = matrices.repair(n, edges, mode)[0].select(F.lit(kind).alias("kind"), "node_i", "node_j", rounded("g_w_k"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH m(name, rho, cp, k, eps) AS (VALUES {", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in views.MATERIALS)})
    SELECT CAST(p_partkey AS BIGINT) AS id, coalesce(m.rho, 2200.0::DOUBLE) AS density_kg_m3, coalesce(m.k, 2.0::DOUBLE) AS k_w_mk, round(CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE p_size * coalesce(m.cp, 800.0::DOUBLE) END, 6) AS capacity_j_k
    FROM part LEFT JOIN m ON lower(name) = lower(p_type)""")
def material_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties by material name in any case, and capacities but for those set by hand."""
    t = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), t.alias("material"), F.col("p_size").cast("double").alias("mass_kg"), "p_retailprice")
    out = materials.defaults_for(rows, views.materials(spark), "DEFAULT")
    return out.select("id", "density_kg_m3", "k_w_mk", F.round(materials.heat_capacity(F.col("mass_kg"), F.col("cp_j_kgk"), F.col("p_retailprice"), F.col("mass_kg") % 3 == 0), 6).alias("capacity_j_k"))


@query("""WITH c AS (SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS id, l_quantity % 4 AS near, l_quantity % 5 = 0 AS surf, l_quantity % 3 = 0 AS inn, l_quantity % 7 < 3 AS nearhit, l_quantity / 50.0::DOUBLE AS f, l_partkey % 3 AS parts, l_partkey % 4 AS mats, l_partkey % 5 = 0 AS con, l_suppkey % 90 AS tests, l_suppkey % 6 AS crowd, l_suppkey % 9 = 0 AS role, l_linenumber AS lvl, 4.0::DOUBLE + l_suppkey % 60 AS s FROM lineitem),
    b AS (SELECT *, NOT (surf OR inn) AND NOT nearhit AS bbox, near >= 2 AND (surf OR nearhit OR (NOT (surf OR inn) AND NOT nearhit)) AND (NOT inn OR f <= 0.12) AS gap, lvl < 8 AND s > 5 AS can, (surf OR inn) AND s > 50 AS must FROM c)
    SELECT id, must, can AND (role OR gap OR near >= 2 OR tests >= 64 OR crowd >= 4 OR parts > 1 OR mats > 1 OR con OR surf OR nearhit OR ((surf OR inn) AND f > 0 AND f < 0.95)) AS may,
      array_to_string(list_filter([CASE WHEN role THEN 'role_region' END, CASE WHEN gap THEN 'gap_preservation' END, CASE WHEN near >= 2 THEN 'multi_surface_ambiguity' END, CASE WHEN tests >= 64 THEN 'surface_complexity' END, CASE WHEN crowd >= 4 THEN 'crowded_component_bounds' END,
        CASE WHEN parts > 1 THEN 'mixed_parts' END, CASE WHEN mats > 1 THEN 'mixed_materials' END, CASE WHEN con THEN 'material_contrast' END, CASE WHEN surf OR nearhit THEN 'surface_or_near_surface' END, CASE WHEN must THEN 'above_max_cell_size' END], lambda x: x IS NOT NULL), ',') AS reasons,
      round(greatest(0, CASE WHEN role THEN 120 ELSE 0 END + CASE WHEN gap THEN 7500 + 250 * near ELSE 0 END + CASE WHEN near >= 2 THEN 90 + 5 * near ELSE 0 END + CASE WHEN tests >= 64 THEN least(80, 10 + 0.25::DOUBLE * tests) ELSE 0 END + CASE WHEN crowd >= 4 THEN 30 + 2 * crowd ELSE 0 END + CASE WHEN parts > 1 THEN 45 ELSE 0 END
        + CASE WHEN mats > 1 THEN 35 ELSE 0 END + CASE WHEN con THEN 25 ELSE 0 END + CASE WHEN surf OR nearhit THEN 20 ELSE 0 END + CASE WHEN must THEN 10000 + 100 * s / 50 ELSE 0 END + CASE WHEN bbox THEN 5 ELSE 0 END - CASE WHEN inn AND NOT surf AND near <= 1 THEN 15 ELSE 0 END), 6) AS score FROM b""")
def refinement_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cells must or may be refined, why, and with what priority."""
    q, p, s = (F.col(c) for c in ("l_quantity", "l_partkey", "l_suppkey"))
    size = (4.0 + s % 60).cast("double")
    rows = views.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("id"), (q % 4).cast("long").alias("near_count"), (q % 5 == 0).alias("surface_hit"), (q % 3 == 0).alias("inside_hit"), (q % 7 < 3).alias("near_hit"), (q / 50.0).alias("fraction"), (p % 3).alias("parts"), (p % 4).alias("materials"),
        (p % 5 == 0).alias("contrast"), (s % 90).alias("tests"), (s % 6).alias("crowded_count"), F.when(s % 9 == 0, 1).otherwise(0).alias("role_count"), F.col("l_linenumber").cast("int").alias("level"), *[size.alias(f"s{a}") for a in "xyz"],
    )
    rows = rows.withColumn("occupied", F.col("surface_hit") | F.col("inside_hit")).withColumn("bbox_only", ~F.col("occupied") & ~F.col("near_hit"))
    out = adaptive.decide(rows, adaptive.Params(crowded=4))
    return out.select("id", "must", "may", F.array_join("reasons", ",").alias("reasons"), rounded("score"))


@query(sql("cells", "SELECT CAST(count(*) AS BIGINT) AS leaves, CAST(count(*) FILTER (component <> 'Brand#4') AS BIGINT) AS solid, CAST(count(*) FILTER (component = 'Brand#4') AS BIGINT) AS empty, max(level) AS deepest FROM cells"))
def leaf_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.leaf_diagnostics(views.cells(spark, sf_dir).withColumn("component", F.when(F.col("component") != "Brand#4", F.col("component"))))


@query(sql("cells", "SELECT node_id, component <> 'Brand#4' AND s > 8 AS oversized, CASE WHEN component <> 'Brand#4' AND s > 8 THEN 'low' ELSE 'high' END AS confidence FROM cells"))
def oversized_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid leaves above the largest size, which lose confidence."""
    c = views.cells(spark, sf_dir).withColumns({"component": F.when(F.col("component") != "Brand#4", F.col("component")), "confidence": F.lit("high")})
    return adaptive.mark_oversized(c, 8.0).select("node_id", "oversized", "confidence")


@query()
def adaptive_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of an adaptive octree over boxes of all suppliers, by level and confidence."""
    r = views.roles(spark, sf_dir).select(F.concat(F.lit("role"), F.col("role_id").cast("string")).alias("component"), F.col("role_id").alias("ordinal"), *[F.col(f"c{a}") for a in "xyz"])
    corner = [[F.col(f"c{a}") + (6.0 if bit else -6.0) for a, bit in zip("xyz", bits, strict=True)] for bits in [(n >> 2 & 1, n >> 1 & 1, n & 1) for n in range(8)]]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tri = F.explode(F.array(*[F.array(*[x for k in t for x in corner[k]]) for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]))
    scene = adaptive.Scene(r.select("component", tri.alias("tri")), r.select("component", "ordinal", F.when(F.col("ordinal") % 2 == 0, "copper").otherwise("steel").alias("material"), F.when(F.col("ordinal") % 2 == 0, 400.0).otherwise(16.0).alias("k_w_mk"), F.lit(3.5e6).alias("rho_cp")))
    high = r.agg(F.max("cz")).first()[0] or 0.0
    root = spark.range(int(high // 256) + 1).select(F.format_string("r%d-", "id").alias("cell_id"), F.lit(0).alias("level"), F.lit(100.0).alias("cx"), F.lit(100.0).alias("cy"), (F.col("id") * 256.0 + 100.0).alias("cz"), *[F.lit(256.0).alias(f"s{a}") for a in "xyz"])
    leaves = adaptive.build(scene, root, adaptive.Params(min_size_mm=12.0, max_size_mm=32.0, max_depth=4, balance_passes=1))
    return leaves.groupBy("level", "confidence").agg(F.count("*").alias("leaves"), F.count("component").alias("solid"))
