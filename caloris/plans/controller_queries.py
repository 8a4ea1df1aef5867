"""Queries over the controller: settings, who takes part, whole steps, power readouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caloris.operators import control, controller
from caloris.plans import views
from caloris.plans.registry import Registry, rounded
from caloris.plans.views import sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _settings(i: Column, some: Column) -> list[Column]:
    """Settings of a node: numbers from its id where `some`, else none."""
    out = [F.when(some & (i % 4 == 0), "MIMO").otherwise("manual").alias("sensor_control_mode")]
    return out + [F.when(some, (i % (n + 3)).cast("double")).otherwise(F.lit(float(controller.SETTINGS[k]))).alias(k) for n, k in enumerate(controller.NUMBERS)]


def heaters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as heaters: every third has settings of its own, every fifth no sensor."""
    i = F.col("c_custkey").cast("long")
    return views.table(spark, sf_dir, "customer").select(i.alias("heater_id"), F.when(i % 5 != 0, i % 40).alias("sensor_id"), *_settings(i, i % 3 == 0), (F.col("c_acctbal") / 100).alias("heater_max_power_w"))


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty sensors, every other one with settings."""
    i = F.col("sensor_id")
    rows = views.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).cast("long").alias("sensor_id")).distinct()
    return rows.select(i, *_settings(i, i % 2 == 0))


def _sql(i: str, some: str) -> str:
    numbers = ", ".join(f"CASE WHEN {some} THEN CAST({i} % {n + 3} AS DOUBLE) ELSE {controller.SETTINGS[k]}::DOUBLE END AS {k}" for n, k in enumerate(controller.NUMBERS))
    return f"CASE WHEN {some} AND {i} % 4 = 0 THEN 'mimo' ELSE 'manual' END AS mode, {numbers}"


_DEFAULT = " AND ".join(f"{{0}}.{k} = {controller.SETTINGS[k]}" for k in controller.NUMBERS) + " AND {0}.mode = 'manual'"
_HS = f"""h AS (SELECT heater_id, CASE WHEN heater_id % 5 <> 0 THEN heater_id % 40 END AS sensor_id, {_sql('heater_id', 'heater_id % 3 = 0')} FROM (SELECT CAST(c_custkey AS BIGINT) AS heater_id FROM customer)),
    s AS (SELECT sensor_id, {_sql('sensor_id', 'sensor_id % 2 = 0')} FROM (SELECT DISTINCT CAST(c_custkey % 40 AS BIGINT) AS sensor_id FROM customer)),
    j AS (SELECT h.*, s.sensor_id IS NOT NULL AND {_DEFAULT.format('h')} AS inherited, {", ".join(f"s.{k} AS s_{k}" for k in ("mode", *controller.NUMBERS))} FROM h LEFT JOIN s ON h.sensor_id = s.sensor_id)"""


@query(f"""WITH {_HS} SELECT heater_id, inherited, CASE WHEN mode = 'mimo' OR (inherited AND s_mode = 'mimo') THEN 'mimo' ELSE 'manual' END AS mode,
    {", ".join(f"CASE WHEN inherited THEN s_{k} ELSE {k} END AS {k}" for k in controller.NUMBERS)} FROM j""")
def controller_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings that hold for every heater."""
    return controller.inherit(heaters(spark, sf_dir), sensors(spark, sf_dir)).select("heater_id", "inherited", F.col("sensor_control_mode").alias("mode"), *controller.NUMBERS)


@query(f"""WITH {_HS}, t AS (SELECT j.*, {_DEFAULT.format('j')} AND NOT (s_mode = 'manual' AND {" AND ".join(f"s_{k} = {controller.SETTINGS[k]}" for k in controller.NUMBERS)}) AS takes FROM j)
    SELECT heater_id, CASE WHEN takes THEN s_mode ELSE mode END AS mode, {", ".join(f"CASE WHEN takes THEN s_{k} ELSE {k} END AS {k}" for k in controller.NUMBERS)} FROM t""")
def controller_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of an older layout moved from sensors to heaters."""
    s = sensors(spark, sf_dir).withColumns({"assigned_heater_id": F.lit(None).cast("long"), "assigned_heater_ids": F.lit(None).cast("array<bigint>")})
    return controller.migrate(heaters(spark, sf_dir), s).select("heater_id", F.lower("sensor_control_mode").alias("mode"), *controller.NUMBERS)


@query(f"""WITH {_HS}, o AS (SELECT sensor_id, CASE WHEN inherited THEN s_controller_weight ELSE controller_weight END AS w, CASE WHEN inherited THEN s_sensor_settling_time_s ELSE sensor_settling_time_s END AS t FROM j WHERE sensor_id IS NOT NULL)
    SELECT sensor_id, round(CASE WHEN avg(w) > 0 THEN avg(w) ELSE 0.5 END, 9) AS controller_weight, round(avg(t), 9) AS sensor_settling_time_s FROM o GROUP BY sensor_id""")
def controller_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and settling times of sensors as means over their heaters."""
    h = controller.inherit(heaters(spark, sf_dir), sensors(spark, sf_dir))
    w, t = (controller.heater_average(h, k, 0.0) for k in ("controller_weight", "sensor_settling_time_s"))
    return w.join(t, "sensor_id").select("sensor_id", rounded("controller_weight", 9), rounded("sensor_settling_time_s", 9))


@query("""SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 4 = 0 THEN 'mimo' ELSE 'manual' END AS mode, CASE WHEN c_custkey % 7 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS kp, CASE WHEN c_custkey % 7 = 0 THEN 1.0::DOUBLE WHEN c_custkey % 3 = 0 THEN greatest(0, c_acctbal) WHEN c_custkey % 3 = 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS lambda_order,
    CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 2 = 0 THEN 250.0::DOUBLE ELSE 293.15::DOUBLE END AS setpoint FROM customer""")
def control_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control settings from JSON of several ages."""
    i, b = F.col("c_custkey"), F.col("c_acctbal").cast("string")
    order = F.when(i % 3 == 0, F.concat(F.lit('"lambda_order": '), b, F.lit(', "lambda": 9,'))).when(i % 3 == 1, F.lit('"lambdaOrder": 0.25,')).otherwise("")
    pid = F.concat(F.lit('{"mode": "'), F.when(i % 4 == 0, "mimo").when(i % 4 == 1, "auto").otherwise("manual"), F.lit('", "pid": {'), order, F.when(i % 2 == 0, F.lit('"setpoint": 250,')).otherwise(""), F.lit('"kp": '), b, F.lit("}}"))
    text = F.when(i % 7 == 0, F.concat(F.lit('{"mode": "'), F.when(i % 4 == 0, "mimo").otherwise("x"), F.lit('"}'))).otherwise(pid)
    return views.table(spark, sf_dir, "customer").select(i.cast("long").alias("id"), controller.read_control(text).alias("c")).select("id", "c.mode", "c.kp", "c.lambda_order", "c.setpoint")


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Heaters and sensors with what decides whether they take part."""
    i = F.col("heater_id")
    h = controller.inherit(heaters(spark, sf_dir), sensors(spark, sf_dir)).withColumn("assigned_sensor_id", F.col("sensor_id")).withColumns(
        {"is_heater": i % 11 != 0, "heater_valid": F.when(i % 13 != 0, i % 17 != 0), "power_deposition_node_ids": F.when(i % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i, i + 1)), "heater_efficiency": F.lit(0.5)}
    )
    j = F.col("sensor_id")
    s = sensors(spark, sf_dir).withColumns({"is_sensor": j % 9 != 0, "sensor_valid": j % 10 != 3, "sensor_monitor_only": j % 8 == 5, "readout_node_ids": F.when(j % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(j)), "is_heater": j % 12 == 0})
    return h, s


_TAKES = f"""{_HS}, m AS (SELECT j.*, CASE WHEN mode = 'mimo' OR (inherited AND s_mode = 'mimo') THEN 'mimo' ELSE 'manual' END AS md, CASE WHEN inherited THEN s_sensor_manual_power_w ELSE sensor_manual_power_w END AS manual FROM j),
    ok AS (SELECT m.*, heater_id % 11 <> 0 AND (heater_id % 13 = 0 OR heater_id % 17 <> 0) AND heater_id % 7 <> 0 AS usable FROM m)"""


@query(f"""WITH {_TAKES} SELECT heater_id, sensor_id FROM ok WHERE usable AND md = 'mimo' AND sensor_id % 9 <> 0 AND sensor_id % 10 <> 3 AND sensor_id % 8 <> 5 AND (sensor_id % 6 <> 0 OR sensor_id % 12 = 0) AND sensor_id IN (SELECT sensor_id FROM s)
    AND sensor_id IN (0, 4, 6, 8, 10, 12, 14, 16, 20, 22, 24, 26, 28, 30, 32, 34, 38)""")
def controller_active_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that the controller drives, where some sensors are enabled."""
    h, s = _roles(spark, sf_dir)
    return controller.active_pairs(h, s, None, [0, 4, 6, 8, 10, 12, 14, 16, 20, 22, 24, 26, 28, 30, 32, 34, 38])


@query(f"""WITH {_TAKES}, c AS (SELECT heater_id, CASE WHEN usable AND sensor_id % 9 <> 0 THEN CASE WHEN md = 'mimo' THEN heater_id % 19 / 2.0::DOUBLE
      ELSE least(greatest(manual, 0), greatest(0, (SELECT c_acctbal FROM customer WHERE c_custkey = heater_id) / 100 * 0.5::DOUBLE)) END ELSE 0 END AS p FROM ok),
    d AS (SELECT unnest([heater_id, heater_id + 1]) AS node_id, unnest([0.25::DOUBLE, 0.75::DOUBLE]) * p AS w FROM c),
    n AS (SELECT CAST(c_custkey AS BIGINT) AS node_id, CASE WHEN c_custkey % 3 = 1 THEN least(greatest(0.5::DOUBLE * (260 + c_custkey % 50 - 270), 0), 8) ELSE 0 END AS cool FROM customer)
    SELECT node_id, round(coalesce(heat, 0), 9) AS heater_w, round(cool, 9) AS cooler_w, round(coalesce(heat, 0) - cool, 9) AS actuator_w FROM n LEFT JOIN (SELECT node_id, sum(w) AS heat FROM d GROUP BY node_id) USING (node_id)""")
def power_readouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heater, cooler and actuator power of every node."""
    h, s = _roles(spark, sf_dir)
    i = F.col("heater_id")
    commands = controller.heater_commands(h, s, h.select("heater_id", ((i % 19) / 2.0).alias("power_w")))
    weights = h.select("heater_id", F.explode(F.array(F.struct(i.alias("node_id"), F.lit(0.25).alias("weight")), F.struct((i + 1).alias("node_id"), F.lit(0.75).alias("weight")))).alias("w")).select("heater_id", "w.*")
    nodes = h.select(i.alias("node_id"), (260.0 + i % 50).alias("temperature_k"), (i % 3 == 1).alias("has_cryocooler"))
    out = controller.power_by_node(commands, weights, nodes, setpoint_k=270.0, gain=0.5, most_w=8.0)
    return out.select("node_id", *[rounded(c, 9) for c in ("heater_w", "cooler_w", "actuator_w")])


_MEMORY, _ORDER_I, _ORDER_D = 8, 0.5, 0.8


def _last_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sensor's latest reading, the one before, and the errors before the latest, newest last."""
    w = Window.partitionBy("sensor_id").orderBy(F.desc("time_s"))
    recent = views.readings(spark, sf_dir).withColumn("r", F.row_number().over(w)).where(F.col("r") <= _MEMORY)
    past = F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct("r", "value"))))), lambda x: 300.0 - x["value"])
    return recent.groupBy("sensor_id").agg(F.max(F.when(F.col("r") == 1, F.col("value"))).alias("y"), F.max(F.when(F.col("r") == 2, F.col("value"))).alias("y_prev"), past.alias("history"))


def _values(weights: list[float]) -> str:
    return ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(weights))


@query(sql("readings", f""", r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time_s DESC) AS r FROM readings),
    e AS (SELECT sensor_id, max(CASE WHEN r = 1 THEN value END) AS y, max(CASE WHEN r = 2 THEN value END) AS p FROM r GROUP BY sensor_id),
    t AS (SELECT *, 300 - CASE WHEN p IS NULL THEN y ELSE (y - exp(-1.0::DOUBLE) * p) / (1 - exp(-1.0::DOUBLE)) END AS err FROM e),
    m AS (SELECT *, CASE WHEN abs(err) <= 6 THEN 'hold' ELSE 'coarse' END AS mode, sensor_id % 4 AS g, 0.01::DOUBLE * (1 + sensor_id % 5) AS b, -0.02::DOUBLE * (sensor_id % 7) AS passive, 5.0::DOUBLE + sensor_id % 6 AS high, CAST(sensor_id % 3 AS DOUBLE) AS last FROM t),
    wi(k, w) AS (VALUES {_values(control.integral_weights(_ORDER_I, _MEMORY))}), wd(k, w) AS (VALUES {_values(control.derivative_weights(_ORDER_D, _MEMORY))}),
    past AS (SELECT m.sensor_id, sum(wi.w * (300 - r.value)) AS si, sum(wd.w * (300 - r.value)) AS sd, sum(w0.w * (300 - r.value)) AS s0 FROM m JOIN r USING (sensor_id) JOIN wi ON wi.k = r.r - 1 JOIN wd ON wd.k = r.r - 1 JOIN wi w0 ON w0.k = r.r - 2
             WHERE r.r BETWEEN 2 AND {_MEMORY} AND mode = 'coarse' GROUP BY m.sensor_id),
    x AS (SELECT m.*, err + coalesce(si, 0) AS eta, err + coalesce(sd, 0) AS slope, coalesce(s0, 0) AS eta0 FROM m LEFT JOIN past USING (sensor_id)),
    v AS (SELECT *, CASE mode WHEN 'hold' THEN 0.02::DOUBLE * err + 0.001::DOUBLE * eta + 0.03::DOUBLE * slope ELSE 0.01::DOUBLE * err + 0.002::DOUBLE * eta + 0.005::DOUBLE * slope END AS raw FROM x),
    f AS (SELECT *, least(greatest(raw, -0.25), 0.25) AS rate, least(greatest(-passive / b, 0), high) AS ff FROM v),
    u AS (SELECT *, least(greatest((0.7::DOUBLE * b * (rate - passive) + 0.001::DOUBLE * least(greatest(ff + rate / b, 0), high) + 0.0005::DOUBLE * last) / (0.7::DOUBLE * b * b + 0.0015::DOUBLE + 1e-12), greatest(last - 3, 0)), least(high, last + 3)) AS power FROM f)
    SELECT sensor_id AS id, mode, round(err, 6) AS error_k, round(power, 6) AS power_w, round(CASE WHEN (err < 0 AND power <= 1e-9) OR (err > 0 AND power >= high - 1e-9) THEN eta0 ELSE eta END, 6) AS integral FROM u"""))
def controller_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole step of one controller for each sensor and its heater: lead, mode, fractional terms, feed-forward, slew, anti-windup."""
    i = F.col("sensor_id")
    last = _last_readings(spark, sf_dir)
    s = last.select(
        i.alias("group_id"), i, F.lit(300.0).alias("setpoint_k"), F.col("y").alias("readout_k"), "y_prev", F.lit(5.0).alias("settling_s"), F.lit(0.7).alias("weight"), F.lit(_ORDER_I).alias("order_i"), F.lit(_ORDER_D).alias("order_d"),
        ((i % 7) * -0.02).alias("passive_k_s"), F.lit("coarse").alias("mode"), "history",
    )
    gains = {"kp_coarse": 0.01, "ki_coarse": 0.002, "kd_coarse": 0.005, "kp_hold": 0.02, "ki_hold": 0.001, "kd_hold": 0.03}
    h = last.select(i.alias("group_id"), i.alias("heater_id"), i, F.lit(False).alias("inherited"), (5.0 + i % 6).alias("max_w"), (i % 3).cast("double").alias("u_prev"), *[F.lit(v).alias(k) for k, v in gains.items()])
    g = last.select(i.alias("group_id"), i, i.alias("heater_id"), ((1 + i % 5) * 0.01).alias("gain"))
    out = controller.step(s, h, g, controller.Params(hold_k=6.0, coarse_k=12.0, rho_du=5e-4, slew_w_s=3.0))
    power = out.where("kind = 'heater'").select("id", "power_w")
    return out.where("kind = 'sensor'").select("id", "mode", "error_k", "integral").join(power, "id").select("id", "mode", rounded("error_k"), rounded("power_w"), rounded("integral"))
