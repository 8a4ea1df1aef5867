"""Queries over steppers, sessions, identification and their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caloris.functions import physics as P
from caloris.operators import contacts, session, simulate
from caloris.operators.control import allocate_groups
from caloris.plans import views
from caloris.plans.geometry_queries import grid_conductance, props
from caloris.plans.registry import Registry, rounded
from caloris.plans.views import sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

#: Fixed value: the step's split of TR-BDF2.
_GAMMA = f"{simulate.GAMMA!r}::DOUBLE"


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers 2m and 2m + 1 as two bodies with an edge; a supplier without its other is a body alone."""
    i = F.col("s_suppkey").cast("long")
    rows = views.table(spark, sf_dir, "supplier").select(i.alias("node_id"), (10.0 + i % 7).alias("capacity_j_k"), (280.0 + i % 30).alias("temperature_k"), (F.lit(0.1) * (i % 3)).alias("power_w"), F.lit(0.0).alias("radiation_w_k4"), F.lit(290.0).alias("surroundings_k"))
    m = F.floor(F.col("node_id") / 2).cast("long")
    ends = rows.select(m.alias("m"), F.col("node_id").alias("n")).groupBy("m").agg(F.min("n").alias("node_i"), F.max("n").alias("node_j")).where("node_i < node_j")
    return rows, ends.select("node_i", "node_j", (0.5 + (F.col("m") % 5) / 10.0).alias("g_w_k"))


_PAIRS = """n AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey // 2 AS m, 10.0::DOUBLE + s_suppkey % 7 AS c, 280.0::DOUBLE + s_suppkey % 30 AS t, 0.1::DOUBLE * (s_suppkey % 3) AS p FROM supplier),
    q AS (SELECT a.id, a.m, a.c, a.t, a.p, coalesce(b.c, 1.0::DOUBLE) AS c2, coalesce(b.t, 0.0::DOUBLE) AS t2, coalesce(b.p, 0.0::DOUBLE) AS p2, CASE WHEN b.id IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + (a.m % 5) / 10.0::DOUBLE END AS g
          FROM n a LEFT JOIN n b ON b.m = a.m AND b.id <> a.id)"""


def _exact(source: str, name: str, dt: float, p: str = "p", p2: str = "p2") -> str:
    """SQL of two_bodies: the rows of `source` with t and t2 after dt."""
    d = f"{dt!r}::DOUBLE"
    return f"""{name} AS (SELECT * EXCLUDE (t, t2, mean, diff), mean + c2 / (c + c2) * diff AS t, mean - c / (c + c2) * diff AS t2 FROM (SELECT *, (c * t + c2 * t2 + ({p} + {p2}) * {d}) / (c + c2) AS mean,
      (t - t2) * exp(-g * (1 / c + 1 / c2) * {d}) + CASE WHEN g > 0 THEN ({p} / c - {p2} / c2) * (1 - exp(-g * (1 / c + 1 / c2) * {d})) / nullif(g * (1 / c + 1 / c2), 0) ELSE ({p} / c - {p2} / c2) * {d} END AS diff FROM {source}))"""


def _euler(source: str, name: str, dt: float, p: str = "p", p2: str = "p2") -> str:
    return f"{name} AS (SELECT * EXCLUDE (t, t2), t + {dt!r}::DOUBLE * ({p} - g * (t - t2)) / c AS t, t2 + {dt!r}::DOUBLE * ({p2} - g * (t2 - t)) / c2 AS t2 FROM {source})"


def _tr_bdf2(source: str, name: str, h: float) -> str:
    """SQL of one TR-BDF2 step of h, with the two systems of two unknowns solved by hand."""
    hh, a = f"{h!r}::DOUBLE", f"(0.5::DOUBLE * {_GAMMA} * {h!r}::DOUBLE * g)"
    last = f"({hh} * (1 - {_GAMMA}) / (2 - {_GAMMA}))"
    solve = lambda b1, b2, k: (f"(({b1}) * (c2 + {k}) + {k} * ({b2})) / (c * c2 + {k} * (c + c2))", f"(({b2}) * (c + {k}) + {k} * ({b1})) / (c * c2 + {k} * (c + c2))")
    m1, m2 = solve(f"c * t - {a} * (t - t2) + {_GAMMA} * {hh} * p", f"c2 * t2 - {a} * (t2 - t) + {_GAMMA} * {hh} * p2", a)
    w = f"(1 / ({_GAMMA} * (2 - {_GAMMA})))"
    f1, f2 = solve(f"c * {w} * (m1 - (1 - {_GAMMA}) * (1 - {_GAMMA}) * t) + {last} * p", f"c2 * {w} * (m2 - (1 - {_GAMMA}) * (1 - {_GAMMA}) * t2) + {last} * p2", f"({last} * g)")
    return f"{name} AS (SELECT * EXCLUDE (t, t2, m1, m2), {f1} AS t, {f2} AS t2 FROM (SELECT *, {m1} AS m1, {m2} AS m2 FROM {source}))"


@query(f"WITH {_PAIRS}, {_tr_bdf2('q', 'a', 4.0)}, {_tr_bdf2('a', 'b', 4.0)} SELECT id AS node_id, round(t, 6) AS temperature_k FROM b")
def implicit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One TR-BDF2 step of 8 s over pairs of bodies, in the two parts that the predicted change asks for at most."""
    return simulate.implicit_steps(*pairs(spark, sf_dir), 8.0, target_delta_k=0.2, most_substeps=2).select("node_id", rounded("temperature_k"))


@query(f"WITH {_PAIRS}, {_exact('q', 'a', 12.0)} SELECT id AS node_id, round(t, 6) AS temperature_k FROM a")
def exponential_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exact steps of 6 s over pairs of bodies."""
    return simulate.exponential_steps(*pairs(spark, sf_dir), 6.0, 2).select("node_id", rounded("temperature_k"))


@query(f"""WITH b AS (SELECT n_nationkey AS id, 0.25::DOUBLE * 900 AS c, 0.5::DOUBLE * 385 AS c2, 60.0::DOUBLE AS t, 20.0::DOUBLE + n_nationkey AS t2, 1 / (0.05::DOUBLE / (205 * 0.01::DOUBLE) * 2 + 0.1::DOUBLE * (n_nationkey + 1)) AS g FROM nation),
    {_exact('b', 's1', 5.0, '0', '0')}, {_exact('s1', 's2', 20.0, '15', '0')}, {_exact('s2', 's3', 7.0, '0', '0')} SELECT CAST(id AS INTEGER) AS id, round(t, 6) AS t_one, round(t2, 6) AS t_two FROM s3""")
def two_cube_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cubes over 32 s with a heater on the first from 5 s to 25 s: the exact solution of each part of the time."""
    side = F.lit(0.1)
    r = P.contact_resistance(side, F.lit(205.0), side, F.lit(205.0), F.lit(0.01), 0.1 * (F.col("n_nationkey") + 1.0))
    rows = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.lit(60.0).alias("one"), (20.0 + F.col("n_nationkey")).alias("two"), (1.0 / r).alias("g"))
    for seconds, power in ((5.0, 0.0), (20.0, 15.0), (7.0, 0.0)):
        one, two = simulate.two_bodies(F.col("one"), F.col("two"), F.lit(0.25 * 900), F.lit(0.5 * 385), F.col("g"), F.lit(power), F.lit(0.0), F.lit(seconds))
        rows = rows.withColumns({"one": one, "two": two})
    return rows.select("id", F.round("one", 6).alias("t_one"), F.round("two", 6).alias("t_two"))


@query(f"""WITH {_PAIRS}, {_euler('q', 'a', 1.0)}, {_euler('a', 'b', 1.0, 'CASE WHEN id % 5 = 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END', 'CASE WHEN (4 * m + 1 - id) % 5 = 0 AND g > 0 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END')}, {_euler('b', 'd', 1.0)}
    SELECT 1.0::DOUBLE AS time_s, id AS node_id, round(t, 6) AS temperature_k FROM a UNION ALL SELECT 2, id, round(t, 6) FROM b UNION ALL SELECT 3, id, round(t, 6) FROM d""")
def session_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session that steps, is forced, goes back and forth, is restored and runs to its end; the history holds three states."""
    state, edges = pairs(spark, sf_dir)
    s = session.Simulation(state, edges, session.Params(t_final_s=3.0, methods=("explicit",), safety=1.0, history_limit=3))
    s.set_temperatures(300.0)
    s.step()
    s.reset()
    s.step()
    s.forced_step(state.where("node_id % 5 = 0").select("node_id", F.lit(0.75).alias("power_w")))
    held = s.snapshot()
    s.back()
    s.step()
    s.set_temperatures(state.select("node_id", "temperature_k"))
    s.restore(held)
    s.run(10)
    return s.trajectory().select("time_s", "node_id", rounded("temperature_k"))


@query(f"""WITH {_PAIRS}, {_euler('q', 'e1', 2.0)}, {_euler('e1', 'e2', 2.0)}, {_euler('e2', 'e3', 2.0)}, {_exact('q', 'x1', 2.0)}, {_exact('x1', 'x2', 2.0)}, {_exact('x2', 'x3', 2.0)},
    r AS (SELECT 0 AS step, id, t AS a, t AS b FROM q UNION ALL SELECT 1, id, e1.t, x1.t FROM e1 JOIN x1 USING (id) UNION ALL SELECT 2, id, e2.t, x2.t FROM e2 JOIN x2 USING (id) UNION ALL SELECT 3, id, e3.t, x3.t FROM e3 JOIN x3 USING (id))
    SELECT round(max(abs(a - b)), 6) AS max_abs_k, round(avg(abs(a - b)), 6) AS mean_abs_k, round(sqrt(avg((a - b) ** 2)), 6) AS rmse_k, round(sqrt(sum((a - b) ** 2)) / sqrt(sum(b * b)), 9) AS relative, round(max(CASE WHEN step = 3 THEN abs(a - b) END), 6) AS final_abs_k FROM r""")
def solver_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three explicit steps of 2 s against the exact propagator."""
    e = session.compare_methods(*pairs(spark, sf_dir), 2.0, 3, "explicit", "exponential", safety=1.0)
    return e.select(rounded("max_abs_k"), rounded("mean_abs_k"), rounded("rmse_k"), rounded("relative", 9), rounded("final_abs_k"))


def _identified(heater: int) -> str:
    """SQL of one heater's test: two steps without power, three with it, mean readouts of the first two and the last two."""
    heat = f"CASE WHEN id = {heater} THEN least(2.0::DOUBLE, (SELECT 1.0::DOUBLE * (1 + {heater} % 4))) ELSE 0.0::DOUBLE END"
    other = f"CASE WHEN 4 * m + 1 - id = {heater} THEN least(2.0::DOUBLE, (SELECT 1.0::DOUBLE * (1 + {heater} % 4))) ELSE 0.0::DOUBLE END"
    return f"""{_euler('q0', f'b{heater}', 1.0, '0', '0')}, {_euler(f'b{heater}', f'c{heater}', 1.0, '0', '0')}, {_euler(f'c{heater}', f'd{heater}', 1.0, heat, other)}, {_euler(f'd{heater}', f'e{heater}', 1.0, heat, other)}, {_euler(f'e{heater}', f'f{heater}', 1.0, heat, other)}"""


_TESTED = (2, 4, 7)


@query(f"""WITH {_PAIRS}, q0 AS (SELECT * REPLACE (CASE WHEN id % 2 = 1 THEN 300.0::DOUBLE + id % 4 ELSE 295.0::DOUBLE END AS t, CASE WHEN g > 0 AND id % 2 = 0 THEN 300.0::DOUBLE + (id + 1) % 4 WHEN g > 0 THEN 295.0::DOUBLE ELSE 0.0::DOUBLE END AS t2) FROM q), {", ".join(_identified(h) for h in _TESTED)}
    {" UNION ALL ".join(f"SELECT id AS sensor_id, CAST({h} AS BIGINT) AS heater_id, round(((e{h}.t + f{h}.t) / 2 - (q0.t + b{h}.t) / 2) / least(2.0::DOUBLE, 1.0::DOUBLE * (1 + {h} % 4)), 6) AS gain FROM q0 JOIN b{h} USING (id) JOIN e{h} USING (id) JOIN f{h} USING (id) WHERE id % 2 = 1" for h in _TESTED)}""")
def sys_id_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step responses of three heaters, from sensors at their setpoints and the rest at a background temperature."""
    state, edges = pairs(spark, sf_dir)
    i = F.col("node_id")
    sensors = state.where("node_id % 2 = 1").select(i.alias("sensor_id"), (300.0 + i % 4).alias("setpoint_k"))
    start = state.drop("temperature_k").join(session.baseline_temperatures(state, sensors, 295.0), "node_id")
    heaters = state.where(i.isin(*_TESTED)).select(i.alias("heater_id"), (1.0 + i % 4).alias("max_w"))
    weights = heaters.select("heater_id", F.col("heater_id").alias("node_id"), F.lit(1.0).alias("weight"))
    links = sensors.select("sensor_id", F.col("sensor_id").alias("node_id"), F.lit(1.0).alias("weight"))
    out = session.identify_gains(start, edges, heaters, weights, links, session.Params(methods=("explicit",), safety=1.0), delta_w=2.0, baseline_steps=2, steps=3, final_steps=2)
    return out.select("sensor_id", "heater_id", rounded("gain"))


_SEEDED = sql("cells mats props grid gedges", """, n AS (SELECT node_id, CASE WHEN node_id % 101 = 0 THEN -1.0::DOUBLE ELSE cap END AS c, CASE WHEN node_id % 103 = 0 THEN NULL ELSE 300.0::DOUBLE END AS t, CASE WHEN node_id % 97 = 0 THEN -1e-9 ELSE 1e-9 END AS r FROM props),
    e AS (SELECT node_i, node_j, CASE WHEN (node_i + node_j) % 50 = 3 THEN -g ELSE g END AS g FROM gedges),
    b AS (SELECT node_i AS id, g FROM e WHERE g > 0 UNION ALL SELECT node_j, g FROM e WHERE g > 0),
    tau AS (SELECT min(c / s) AS tau FROM (SELECT id, sum(g) AS s FROM b GROUP BY id) JOIN n ON node_id = id WHERE c > 0)""")


@query(_SEEDED + """ SELECT 'bad_capacity' AS rule, CAST(node_id AS VARCHAR) AS subject FROM n WHERE c <= 0 UNION ALL SELECT 'bad_temperature', CAST(node_id AS VARCHAR) FROM n WHERE t IS NULL
    UNION ALL SELECT 'negative_radiation', CAST(node_id AS VARCHAR) FROM n WHERE r < 0 AND node_id < 0 UNION ALL SELECT 'positive_off_diagonal', node_i || '-' || node_j FROM e WHERE g < -1e-12 UNION ALL SELECT 'coarse_step', 'yes' FROM tau WHERE 1000 > 0.2::DOUBLE * tau""")
def simulation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a simulation's inputs, with seeded defects; a coefficient above -1e-12 passes for rounding."""
    p, i = props(spark, sf_dir), F.col("node_id")
    state = p.select("node_id", F.when(i % 101 == 0, -1.0).otherwise(F.col("capacity_j_k")).alias("capacity_j_k"), F.when(i % 103 == 0, float("nan")).otherwise(300.0).alias("temperature_k"), F.when(i % 97 == 0, -1e-13).otherwise(1e-9).alias("radiation_w_k4"), F.lit(290.0).alias("surroundings_k"))
    edges = grid_conductance(spark, sf_dir).withColumn("g_w_k", F.when((F.col("node_i") + F.col("node_j")) % 50 == 3, -F.col("g_w_k")).otherwise(F.col("g_w_k")))
    found = simulate.validate_inputs(state, edges, 1000.0)
    return found.withColumn("subject", F.when(F.col("rule") == "coarse_step", F.lit("yes")).otherwise(F.col("subject")))


_RADIATING = sql("cells mats props grid gedges ends", ", r AS (SELECT node_id, cap, eps, CASE WHEN p_size % 4 = 0 THEN 0.0::DOUBLE ELSE s * s * 1e-6 END AS area, 4 * eps * 5.670374419e-8::DOUBLE * (s * s * 1e-6) * pow(293.15::DOUBLE, 3) AS grad FROM props)")


@query(_RADIATING + " SELECT round(min(cap / (s + grad)), 6) AS tau_s FROM (SELECT node, sum(g) AS s FROM ends GROUP BY node) JOIN r ON node = node_id")
def least_time_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least time constant with radiation among the conductances."""
    p = props(spark, sf_dir)
    state = p.select("node_id", "capacity_j_k", P.radiation_linear(F.col("emissivity"), F.col("sx") * F.col("sx") * 1e-6).alias("g_rad_w_k"))
    return simulate.time_constants(state, grid_conductance(spark, sf_dir)).agg(F.round(F.min("tau_s"), 6).alias("tau_s"))


@query(_RADIATING + " SELECT node_id, round(1e12 * CASE WHEN eps * area > 0 THEN eps * 5.670374419e-8::DOUBLE * area ELSE grad / (4 * pow(290.0::DOUBLE, 3)) END, 6) AS coefficient FROM r")
def radiation_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T^4 coefficients; where the radiating area is not known, from the linear conductance."""
    p = props(spark, sf_dir)
    face = F.col("sx") * F.col("sx") * 1e-6
    known = F.when(F.col("p_size") % 4 == 0, 0.0).otherwise(face)
    return p.select("node_id", F.round(1e12 * P.radiation_coefficient(F.col("emissivity"), known, P.radiation_linear(F.col("emissivity"), face), F.lit(290.0)), 6).alias("coefficient"))


@query(sql("cells mats props", """SELECT node_id, round(rho * s * s * s * 1e-9 * o, 9) AS mass_kg, round(rho * s * s * s * 1e-9 * o * cp, 6) AS capacity_j_k, round(4 * eps * 5.670374419e-8::DOUBLE * (6 * s * s * 1e-6) * pow(293.15::DOUBLE, 3), 9) AS g_rad_w_k,
    CASE WHEN eps > 0 THEN round(1 / (4 * eps * 5.670374419e-8::DOUBLE * (6 * s * s * 1e-6) * pow(293.15::DOUBLE, 3)), 3) END AS r_rad_k_w FROM (SELECT *, greatest(p_size / 50.0::DOUBLE, 1 - p_size / 50.0::DOUBLE) AS o FROM props) WHERE component <> 'Brand#2'"""))
def cell_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid cells as nodes: mass and capacity by the largest occupancy, radiative conductance and resistance of the surface."""
    part = F.col("p_size") / 50.0
    rows = props(spark, sf_dir).withColumn("occupancy", F.create_map(F.lit("own"), part, F.lit("rest"), 1.0 - part)).withColumn("exposed_mm2", 6.0 * F.col("sx") * F.col("sx"))
    rows = rows.withColumn("dominant_component", F.when(F.col("component") != "Brand#2", F.col("component")))
    return contacts.cell_nodes(rows).select("node_id", rounded("mass_kg", 9), rounded("capacity_j_k"), rounded("g_rad_w_k", 9), rounded("r_rad_k_w", 3))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS group_id, CAST(s_suppkey AS BIGINT) AS heater_id, round(least(greatest(0.5::DOUBLE * b * y / (0.5::DOUBLE * b * b + 1e-6 + 1e-12), 0), 2.0::DOUBLE + s_suppkey % 5), 6) AS power_w
    FROM (SELECT *, 0.1::DOUBLE * (1 + s_suppkey % 4) AS b, s_acctbal / 5000 AS y FROM supplier)""")
def qp_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded allocation of groups of one sensor and one heater, which has a closed form."""
    i = F.col("s_suppkey").cast("long")
    rows = views.table(spark, sf_dir, "supplier")
    gains = rows.select(i.alias("group_id"), i.alias("sensor_id"), i.alias("heater_id"), (F.lit(0.1) * (1 + i % 4)).alias("gain"))
    targets = rows.select(i.alias("group_id"), i.alias("sensor_id"), (F.col("s_acctbal") / 5000).alias("target"), F.lit(0.5).alias("weight"))
    return allocate_groups(gains, targets, rows.select(i.alias("group_id"), i.alias("heater_id"), (2.0 + i % 5).alias("max_w"))).select("group_id", "heater_id", rounded("power_w"))
