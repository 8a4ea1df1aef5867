"""Queries over the thermal graph: matrices, components, reports, validation, time stepping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caloris.functions import physics as P
from caloris.operators import graph, reports, simulate
from caloris.plans import views
from caloris.plans.geometry_queries import grid_conductance, props
from caloris.plans.registry import Registry, rounded
from caloris.plans.views import sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a simulation state: 300 K and a little by id, one heated cell in seven, faces radiating to 290 K."""
    p = props(spark, sf_dir)
    return p.select(
        "node_id", "capacity_j_k", (300.0 + F.col("node_id") % 10).alias("temperature_k"), F.when(F.col("node_id") % 7 == 0, 0.01).otherwise(0.0).alias("power_w"),
        (F.col("emissivity") * P.STEFAN_BOLTZMANN * (F.col("sx") * F.col("sx") * 1e-6)).alias("radiation_w_k4"), F.lit(290.0).alias("surroundings_k"),
    )


def conn(spark: SparkSession, sf_dir: str, largest: int | None = 20) -> tuple[DataFrame, DataFrame]:
    """The sparse cells, whose components are not trivial, and their grid edges; with largest None, those of the whole table.

    The recursive SQL of the component queries is written for the sparse cells; their namesakes in _all take every row.
    """
    from caloris.operators.contacts import grid_edges

    cells = views.cells(spark, sf_dir, largest)
    return cells, grid_edges(cells)


@query(sql("cells mats props grid gedges ends", "SELECT node_id, round(cap, 6) AS capacity_j_k, round(sum(g), 6) AS total_g_w_k, round(cap / sum(g), 6) AS tau_s FROM props JOIN ends ON node = node_id GROUP BY node_id, cap ORDER BY cap / sum(g) DESC, node_id LIMIT 20"))
def time_constants_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = state(spark, sf_dir)
    taus = simulate.time_constants(s, grid_conductance(spark, sf_dir)).join(s.select("node_id", "capacity_j_k"), "node_id")
    return taus.where("tau_s IS NOT NULL").orderBy(F.desc("tau_s"), "node_id").limit(20).select("node_id", rounded("capacity_j_k"), rounded("total_g_w_k"), rounded("tau_s"))


@query(sql("cells mats props grid gedges ends", "SELECT node AS row, other AS col, round(-sum(g), 6) AS value FROM ends GROUP BY ALL UNION ALL SELECT node, node, round(sum(g), 6) FROM ends GROUP BY node"))
def laplacian_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.laplacian(grid_conductance(spark, sf_dir)).select("row", "col", rounded("value"))


@query(sql("cells mats props grid gedges ends", ", l AS (SELECT node, other, -sum(g) AS v FROM ends GROUP BY ALL) SELECT round(max(abs(a.v - coalesce(b.v, 0))), 9) AS max_delta, max(abs(a.v - coalesce(b.v, 0))) <= 1e-12 AS symmetric FROM l a LEFT JOIN l b ON a.node = b.other AND a.other = b.node"))
def laplacian_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.asymmetry(graph.laplacian(grid_conductance(spark, sf_dir))).select(rounded("max_delta", 9), "symmetric")


@query(sql("cells mats props grid gedges ends", """SELECT node_id, CAST(count(other) AS BIGINT) AS degree, CAST(count(DISTINCT other) AS BIGINT) AS neighbours, CAST(count(DISTINCT CASE WHEN other % 2 = 0 THEN other END) AS BIGINT) AS visible_neighbours
    FROM cells LEFT JOIN ends ON node = node_id GROUP BY node_id"""))
def node_degree_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.cells(spark, sf_dir)
    return graph.degrees(cells, grid_conductance(spark, sf_dir), cells.where("node_id % 2 = 0"))


_CONN = f"""WITH RECURSIVE {views.CTES['cells']}, {views.CTES['conn']}, e AS (SELECT a.node_id AS a, b.node_id AS b FROM conn a JOIN conn b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
    r(n, m) AS (SELECT node_id, node_id FROM conn UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m), lab AS (SELECT n AS node_id, min(m) AS label FROM r GROUP BY n),
    num AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS component_id, count(*) AS c FROM lab GROUP BY label)"""


@query(f"{_CONN} SELECT node_id, CAST(component_id AS BIGINT) AS component_id FROM lab JOIN num USING (label)")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.numbered_components(graph.components(*conn(spark, sf_dir)))


@query()
def connected_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.numbered_components(graph.components(*conn(spark, sf_dir, None)))


@query(f"""{_CONN}, x AS (SELECT component_id, c.* FROM lab JOIN num USING (label) JOIN conn c USING (node_id)),
    pc AS (SELECT component_id, component, count(*) AS n, row_number() OVER (PARTITION BY component_id ORDER BY count(*) DESC, min(node_id)) AS r FROM x GROUP BY 1, 2),
    pm AS (SELECT component_id, material, count(*) AS n, row_number() OVER (PARTITION BY component_id ORDER BY count(*) DESC, min(node_id)) AS r FROM x GROUP BY 1, 2),
    ids AS (SELECT component_id, node_id, row_number() OVER (PARTITION BY component_id ORDER BY node_id) AS r FROM x)
    SELECT CAST(component_id AS BIGINT) AS component_id, CAST(count(*) AS BIGINT) AS node_count, min(cx) AS min_x, min(cy) AS min_y, min(cz) AS min_z, max(cx) AS max_x, max(cy) AS max_y, max(cz) AS max_z,
      CAST(count(*) FILTER (node_id % 11 = 0) AS BIGINT) AS heater_count, CAST(count(*) FILTER (node_id % 13 = 0) AS BIGINT) AS sensor_count,
      (SELECT string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) FROM ids WHERE ids.component_id = x.component_id AND r <= 50) AS node_ids_sample,
      (SELECT string_agg(component || ':' || n, ',' ORDER BY r) FROM pc WHERE pc.component_id = x.component_id AND r <= 10) AS top_components,
      (SELECT string_agg(material || ':' || n, ',' ORDER BY r) FROM pm WHERE pm.component_id = x.component_id AND r <= 10) AS top_materials
    FROM x GROUP BY component_id""")
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(*conn(spark, sf_dir))


@query()
def component_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(*conn(spark, sf_dir, None))


def _summary(cells: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = cells.withColumns({"is_heater": F.col("node_id") % 11 == 0, "is_sensor": F.col("node_id") % 13 == 0})
    return graph.component_summary(nodes, graph.numbered_components(graph.components(cells, edges)))


def _reported(spark: SparkSession, sf_dir: str, largest: int | None = 20) -> DataFrame:
    """Cells as report nodes: warnings, confidence and roles follow from the id."""
    cells, edges = conn(spark, sf_dir, largest)
    labels = graph.components(cells, edges)
    big = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1).select(F.col("label").alias("big"))
    rows = cells.join(graph.degrees(cells, edges).select("node_id", "degree"), "node_id").join(labels, "node_id").join(F.broadcast(big), F.col("label") == F.col("big"), "left")
    n = F.col("node_id")
    text = F.when(n % 6 == 0, "Blocked by max_leaf_cells 10").when(n % 6 == 1, "stopped by max_depth or min_cell_size_mm").when(n % 6 == 2, "marker-only graph node").when(n % 6 == 3, "note")
    return rows.select(
        "node_id", "component", "material", F.col("sx").alias("size_mm"), F.when(n % 17 == 0, -1).otherwise(F.col("level")).alias("level"), F.when(n % 4 == 0, "low").otherwise("high").alias("confidence"),
        F.array_compact(F.array(text)).alias("warnings"), "degree", F.col("big").isNull().alias("disconnected"), (n % 11 == 0).alias("is_heater"), (n % 13 == 0).alias("is_sensor"), (n % 22 == 0).alias("heater_valid"),
        (n % 26 == 0).alias("sensor_valid"), F.when(n % 33 == 0, n).alias("assigned_sensor_id"), F.when(n % 39 == 0, n).alias("assigned_heater_id"),
    )


_REP = _CONN + """, deg AS (SELECT a AS node_id, count(*) AS d FROM e GROUP BY a),
    rep AS (SELECT c.node_id, component, s AS size_mm, CASE WHEN c.node_id % 17 = 0 THEN -1 ELSE level END AS level, CASE WHEN c.node_id % 4 = 0 THEN 'low' ELSE 'high' END AS confidence,
      CASE c.node_id % 6 WHEN 0 THEN 'Blocked by max_leaf_cells 10' WHEN 1 THEN 'stopped by max_depth or min_cell_size_mm' WHEN 2 THEN 'marker-only graph node' WHEN 3 THEN 'note' END AS w, coalesce(d, 0) AS d,
      component_id <> 0 AS dis FROM conn c LEFT JOIN deg USING (node_id) JOIN lab USING (node_id) JOIN num USING (label)),
    tags AS (SELECT node_id, list_filter([CASE WHEN size_mm > 8 THEN 'oversized_cell' END, CASE WHEN confidence <> 'high' THEN 'low_confidence' END, CASE WHEN w IS NOT NULL THEN 'node_warning' END, CASE WHEN d <= 0 THEN 'isolated_node' END,
      CASE WHEN dis THEN 'disconnected_component' END, CASE WHEN node_id % 11 = 0 AND node_id % 22 <> 0 THEN 'invalid_heater' END, CASE WHEN node_id % 11 = 0 AND node_id % 33 <> 0 THEN 'unpaired_heater' END,
      CASE WHEN node_id % 13 = 0 AND node_id % 26 <> 0 THEN 'invalid_sensor' END, CASE WHEN node_id % 13 = 0 AND node_id % 39 <> 0 THEN 'unpaired_sensor' END], lambda x: x IS NOT NULL) AS tags FROM rep)"""


@query(f"{_REP} SELECT node_id, array_to_string(tags, ',') AS tags FROM tags")
def warning_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir).select("node_id", F.array_join(reports.warning_tags(8.0), ",").alias("tags"))


@query()
def warning_tags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir, None).select("node_id", F.array_join(reports.warning_tags(8.0), ",").alias("tags"))


_TAGS = ("oversized_cell", "low_confidence", "isolated_node", "disconnected_component", "unpaired_heater", "unpaired_sensor", "node_warning", "invalid_heater", "invalid_sensor")


@query(f"""{_REP}, t AS (SELECT CAST(count(*) AS BIGINT) AS nodes, {', '.join(f"CAST(count(*) FILTER (list_contains(tags, '{t}')) AS BIGINT) AS {t}" for t in _TAGS)} FROM tags),
    z AS (SELECT *, greatest(0, 100 - 20 - 3 - least(25, oversized_cell * 2) - least(20, low_confidence) - least(15, isolated_node * 2) - least(25, disconnected_component * 2) - least(15, (unpaired_heater + unpaired_sensor) * 2)) AS sc FROM t)
    SELECT * EXCLUDE (sc), CAST(sc AS BIGINT) AS score, CASE WHEN sc >= 90 THEN 'A' WHEN sc >= 75 THEN 'B' WHEN sc >= 60 THEN 'C' ELSE 'D' END AS grade FROM z""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality(_reported(spark, sf_dir).withColumn("tags", reports.warning_tags(8.0)), errors=1, warnings=3)


@query()
def quality_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality(_reported(spark, sf_dir, None).withColumn("tags", reports.warning_tags(8.0)), errors=1, warnings=3)


_BIG = """, big AS (SELECT *, CASE WHEN w LIKE '%Blocked by%' THEN 'blocked_by_max_leaf_cells_old_code' WHEN w LIKE '%max_depth or%' THEN 'blocked_by_max_depth_or_min_cell_size'
    WHEN w LIKE '%marker-only%' OR level < 0 THEN 'marker_node' WHEN w IS NOT NULL THEN 'node_warning' ELSE 'unknown' END AS reason FROM rep WHERE size_mm > 8)"""


@query(f"{_REP}{_BIG} SELECT reason, CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) FILTER (level < 0 OR reason = 'marker_node') AS BIGINT) AS marker_nodes, max(size_mm) AS largest_mm FROM big GROUP BY ROLLUP (reason)")
def oversized_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.oversized_summary(reports.oversized(_reported(spark, sf_dir), 8.0))


@query()
def oversized_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.oversized_summary(reports.oversized(_reported(spark, sf_dir, None), 8.0))


@query(f"{_REP} SELECT node_id, component, size_mm FROM rep ORDER BY size_mm DESC, node_id LIMIT 20")
def largest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest(_reported(spark, sf_dir)).select("node_id", "component", "size_mm")


@query()
def largest_nodes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest(_reported(spark, sf_dir, None)).select("node_id", "component", "size_mm")


@query(sql("cells grid", """, b AS (SELECT DISTINCT node FROM (SELECT node_i AS node, a.component <> c.component AS x FROM grid JOIN cells a ON a.node_id = node_i JOIN cells c ON c.node_id = node_j
      UNION ALL SELECT node_j, a.component <> c.component FROM grid JOIN cells a ON a.node_id = node_i JOIN cells c ON c.node_id = node_j) WHERE x)
    SELECT node_id FROM cells WHERE material = 'SMALL' AND (level BETWEEN 1 AND 3 OR node_id % 11 = 0) AND node_id IN (SELECT node FROM b)"""))
def boundary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one material in a range of levels (role cells of any) that border another component."""
    from caloris.operators.contacts import grid_edges

    c = views.cells(spark, sf_dir)
    part = c.select("node_id", "component")
    e = grid_edges(c).join(part.toDF("node_i", "ci"), "node_i").join(part.toDF("node_j", "cj"), "node_j").where("ci <> cj")
    border = graph.both_ways(e).select(F.col("node").alias("node_id"))
    return c.where((F.col("material") == "SMALL") & (F.col("level").between(1, 3) | (F.col("node_id") % 11 == 0))).join(border, "node_id", "left_semi").select("node_id")


@query("""WITH n AS (SELECT CAST(p_partkey % 1999 AS BIGINT) AS node_id, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS component, p_type AS material, p_size - 2 AS cap FROM part),
    e AS (SELECT CAST(o_orderkey % 2100 AS BIGINT) AS i, CAST(o_custkey AS BIGINT) AS j, o_totalprice - 2000 AS g FROM orders), p AS (SELECT least(i, j) || '-' || greatest(i, j) AS pair, * FROM e)
    SELECT rule, CAST(count(*) AS BIGINT) AS breaches FROM (
      SELECT 'duplicate_node' AS rule FROM n GROUP BY node_id HAVING count(*) > 1
      UNION ALL SELECT 'missing_component' FROM n WHERE component = '' UNION ALL SELECT 'bad_capacity' FROM n WHERE cap <= 0
      UNION ALL SELECT 'dangling_edge' FROM (SELECT DISTINCT pair FROM p WHERE i NOT IN (SELECT node_id FROM n) OR j NOT IN (SELECT node_id FROM n))
      UNION ALL SELECT 'self_edge' FROM p WHERE i = j UNION ALL SELECT 'negative_conductance' FROM p WHERE g < 0 UNION ALL SELECT 'duplicate_edge' FROM p GROUP BY pair HAVING count(*) > 1) GROUP BY rule""")
def graph_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.table(spark, sf_dir, "part").select((F.col("p_partkey") % 1999).cast("long").alias("node_id"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_brand")).alias("component"), F.col("p_type").alias("material"), (F.col("p_size") - 2).alias("capacity_j_k"), F.lit(293.15).alias("temperature_k"))
    edges = views.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2100).cast("long").alias("node_i"), F.col("o_custkey").cast("long").alias("node_j"), (F.col("o_totalprice") - 2000).alias("g_w_k"))
    return reports.violations(nodes, edges).groupBy("rule").agg(F.count("*").alias("breaches"))


@query("""WITH e AS (SELECT least(o_custkey, o_orderkey % 1500) AS i, greatest(o_custkey, o_orderkey % 1500) AS j, o_totalprice AS g, o_orderkey AS n FROM orders)
    SELECT CAST(i AS BIGINT) AS node_i, CAST(j AS BIGINT) AS node_j, max_by(g, n) AS g_w_k FROM e GROUP BY i, j""")
def dense_conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("node_i"), (F.col("o_orderkey") % 1500).cast("long").alias("node_j"), F.col("o_totalprice").alias("g_w_k"), "o_orderkey")
    return graph.dense_conductance(o, "o_orderkey")


@query("""SELECT CAST(l_suppkey AS BIGINT) AS node_i, CAST(l_partkey AS BIGINT) AS node_j, CAST(count(*) AS BIGINT) AS edges FROM lineitem WHERE l_suppkey < l_partkey AND l_discount > 0 AND l_suppkey % 3 = 0 AND l_partkey % 3 = 0
    AND l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT s_suppkey FROM supplier) GROUP BY ALL""")
def edges_from_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among every third supplier, as its SQL says; edges_from_matrix_all takes them all."""
    return _matrix_edges(spark, sf_dir, F.col("node_id") % 3 == 0)


@query()
def edges_from_matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix_edges(spark, sf_dir, F.lit(True))


def _matrix_edges(spark: SparkSession, sf_dir: str, wanted: Column) -> DataFrame:
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("row"), F.col("l_partkey").cast("long").alias("col"), F.col("l_discount").alias("value"))
    nodes = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("node_id")).where(wanted)
    return graph.edges_from_matrix(li, nodes).groupBy("node_i", "node_j").agg(F.count("*").alias("edges"))


_S0 = """, s0 AS (SELECT node_id, cap, 300.0::DOUBLE + node_id % 10 AS t, CASE WHEN node_id % 7 = 0 THEN 0.01::DOUBLE ELSE 0 END AS p, eps * 5.670374419e-8::DOUBLE * (s * s * 1e-6::DOUBLE) AS r FROM props)"""


def _unrolled(n: int, dt: float = 1.0) -> str:
    return _S0 + "".join(f""", s{k} AS (SELECT a.node_id, a.cap, a.p, a.r, a.t + {dt}::DOUBLE * (coalesce(f, 0) + a.p + a.r * (290.0::DOUBLE ** 4 - a.t ** 4)) / a.cap AS t FROM s{k - 1} a
        LEFT JOIN (SELECT node, sum(g * (y.t - x.t)) AS f FROM ends JOIN s{k - 1} x ON x.node_id = node JOIN s{k - 1} y ON y.node_id = other GROUP BY node) ON node = a.node_id)""" for k in range(1, n + 1))


_STEPS = sql("cells mats props grid gedges ends", _unrolled(3))


def _run(spark: SparkSession, sf_dir: str, steps: int = 3, **kw: object) -> DataFrame:
    return simulate.explicit_steps(state(spark, sf_dir), grid_conductance(spark, sf_dir), 1.0, steps, substeps=1, **kw)  # type: ignore[arg-type]


@query(_STEPS + " SELECT node_id, round(t, 6) AS temperature_k FROM s3")
def explicit_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).where("step = 3").select("node_id", rounded("temperature_k"))


_ALL = ", a AS (" + " UNION ALL ".join(f"SELECT {k} AS step, node_id, t FROM s{k}" for k in range(4)) + ")"


@query(_STEPS + _ALL + " SELECT step, round(min(t), 6) AS min_k, round(max(t), 6) AS max_k, round(avg(t), 6) AS mean_k FROM a GROUP BY step")
def trajectory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.trajectory_stats(_run(spark, sf_dir)).select("step", rounded("min_k"), rounded("max_k"), rounded("mean_k"))


@query(_STEPS + _ALL + " SELECT b.step, round(max(abs(b.t - a.t)), 6) AS max_delta_k FROM a JOIN a b ON b.step = a.step + 1 AND a.node_id = b.node_id GROUP BY b.step")
def max_temperature_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.max_change(_run(spark, sf_dir)).select("step", rounded("max_delta_k"))


@query(_STEPS + _ALL + """, x AS (SELECT step, node_id, t AS r, t + (node_id % 5) * 0.01::DOUBLE * step - t AS e FROM a)
    SELECT round(max(abs(e)), 6) AS max_abs_k, CAST(3 AS INTEGER) AS worst_step, (SELECT min(node_id) FROM x WHERE node_id % 5 = 4) AS worst_node, round(avg(abs(e)), 6) AS mean_abs_k, round(sqrt(avg(e * e)), 6) AS rmse_k,
      round(sqrt(sum(e * e)) / sqrt(sum(r * r)), 9) AS relative, round(max(CASE WHEN step = 3 THEN abs(e) END), 6) AS final_abs_k FROM x""")
def trajectory_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    off = run.withColumn("temperature_k", F.round(F.col("temperature_k"), 6) + (F.col("node_id") % 5) * 0.01 * F.col("step"))
    base = run.withColumn("temperature_k", F.round(F.col("temperature_k"), 6))
    # errors are rounded so that the place of the largest does not hang on the last bit
    both = off.join(base.withColumnRenamed("temperature_k", "r"), ["step", "node_id"]).select("step", "node_id", F.round(F.col("temperature_k") - F.col("r"), 6).alias("temperature_k"), "r")
    e = simulate.trajectory_error(both.select("step", "node_id", (F.col("temperature_k")).alias("temperature_k")), both.select("step", "node_id", F.lit(0.0).alias("temperature_k")))
    size = both.agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("size"), F.sqrt(F.sum(F.col("temperature_k") * F.col("temperature_k"))).alias("err"))
    return e.drop("relative").join(F.broadcast(size)).select(rounded("max_abs_k"), "worst_step", "worst_node", rounded("mean_abs_k"), rounded("rmse_k"), F.round(F.col("err") / F.col("size"), 9).alias("relative"), rounded("final_abs_k"))


@query()
def implicit_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.implicit_steps(state(spark, sf_dir), grid_conductance(spark, sf_dir), 10.0, 2)


@query()
def exponential_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.exponential_steps(state(spark, sf_dir), grid_conductance(spark, sf_dir), 10.0, 2)


@query("""SELECT CAST(n_nationkey AS INTEGER) AS id, round(60 - q / 2 + q / 2 * exp(-2 * 10 / r / c) , 6) AS t_hot, round(20 + q / 2 - q / 2 * exp(-2 * 10 / r / c), 6) AS t_cold
    FROM (SELECT n_nationkey, 40.0::DOUBLE AS q, 0.25::DOUBLE * 900 AS c, 0.05::DOUBLE / (205 * 0.01::DOUBLE) * 2 + 0.1::DOUBLE * (n_nationkey + 1) AS r FROM nation)""")
def two_cube_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cubes of one capacity at 60 and 20 degrees after 10 s, for an interface resistance by nation: the exact
    solution of the linear system, a fast mode that dies out around a conserved mean."""
    side = F.lit(0.1)
    r = P.contact_resistance(side, F.lit(205.0), side, F.lit(205.0), F.lit(0.01), 0.1 * (F.col("n_nationkey") + 1.0))
    c = F.lit(0.25 * 900)
    half = F.lit(20.0) * F.exp(-2 * F.lit(10.0) / r / c)
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.round(40 + half, 6).alias("t_hot"), F.round(40 - half, 6).alias("t_cold"))


@query(_STEPS + _ALL + ", b AS (SELECT node_id, step, t FROM a WHERE step <= 2) SELECT node_id, round(max_by(t, step), 6) AS temperature_k FROM b GROUP BY node_id")
def seek_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at the last step at or before 2."""
    run = _run(spark, sf_dir).where("step <= 2")
    return graph.recent(run, ["node_id"], "step", 1).select("node_id", rounded("temperature_k"))


@query(sql("cells mats props", "SELECT CAST(coalesce(max(node_id) + 1, 0) AS BIGINT) AS next_node_id, CAST(count(*) AS BIGINT) AS nodes, CAST(count(DISTINCT component) AS BIGINT) AS components, CAST(count(DISTINCT resolved) AS BIGINT) AS materials, min(cx) AS low_x, max(cx) AS high_x, CAST(count(*) FILTER (fell) AS BIGINT) AS fallbacks FROM (SELECT *, resolved <> material AS fell FROM props)"))
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props(spark, sf_dir).agg(F.coalesce(F.max("node_id") + 1, F.lit(0)).alias("next_node_id"), F.count("*").alias("nodes"), F.count_distinct("component").alias("components"), F.count_distinct("resolved_material").alias("materials"), F.min("cx").alias("low_x"), F.max("cx").alias("high_x"), F.count_if("fell_back").alias("fallbacks"))


@query(sql("cells mats props", """SELECT component, coalesce(CASE WHEN max(kc) / min(kc) >= 30 AND count(*) >= 2 THEN true END, CASE WHEN max(rho * cp) / min(rho * cp) >= 30 AND count(*) >= 2 THEN true END, false) AS contrast FROM props GROUP BY component"""))
def material_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caloris.operators.materials import contrast

    return contrast(props(spark, sf_dir).withColumn("rho_cp", F.col("density_kg_m3") * F.col("cp_j_kgk")), "component", 30.0)


@query(sql("cells", """, u AS (SELECT node_id FROM cells WHERE p_size % 2 = 0 UNION SELECT node_id FROM cells WHERE p_size % 3 = 0) SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM u
    UNION ALL SELECT 'intersect', count(*) FROM cells WHERE p_size % 6 = 0 UNION ALL SELECT 'except', count(*) FROM cells WHERE p_size % 2 = 0 AND p_size % 3 <> 0 UNION ALL SELECT 'symmetric', count(*) FROM cells WHERE (p_size % 2 = 0) <> (p_size % 3 = 0)"""))
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.cells(spark, sf_dir)
    a, b = (c.where(F.col("p_size") % k == 0).select("node_id") for k in (2, 3))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b), "symmetric": a.exceptAll(b).union(b.exceptAll(a))}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(sql("cells", "SELECT node_id, component, rank FROM (SELECT node_id, component, CAST(row_number() OVER (PARTITION BY component ORDER BY node_id DESC) AS INTEGER) AS rank FROM cells) WHERE rank <= 3"))
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = graph.recent(views.cells(spark, sf_dir), ["component"], "node_id", 3)
    return last.select("node_id", "component", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("node_id"))).alias("rank"))
