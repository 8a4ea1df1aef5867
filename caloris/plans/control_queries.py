"""Queries over sensor series and gain matrices: filters, fractional calculus, modes, readouts, identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from caloris.functions import physics as P
from caloris.operators import control, roles, sysid
from caloris.plans import views
from caloris.plans.geometry_queries import props
from caloris.plans.registry import Registry, rounded
from caloris.plans.views import sql
from caloris.session import scratch, staged
from caloris.streaming import controller

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(sql("readings", "SELECT sensor_id, time_s, round((value - lag(value) OVER w) / (time_s - lag(time_s) OVER w), 6) AS rate FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY time_s)"))
def drift_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.derivative(views.readings(spark, sf_dir)).select("sensor_id", "time_s", rounded("rate"))


@query(f"""WITH RECURSIVE {views.CTES['readings']}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time_s) AS r FROM readings),
    f(sensor_id, r, time_s, y) AS (SELECT sensor_id, r, time_s, value FROM n WHERE r = 1 UNION ALL
      SELECT n.sensor_id, n.r, n.time_s, (1 - (n.time_s - f.time_s) / (50.0::DOUBLE + (n.time_s - f.time_s))) * y + (n.time_s - f.time_s) / (50.0::DOUBLE + (n.time_s - f.time_s)) * n.value FROM f JOIN n ON n.sensor_id = f.sensor_id AND n.r = f.r + 1)
    SELECT sensor_id, time_s, round(y, 6) AS filtered FROM f""")
def drift_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.low_pass(views.readings(spark, sf_dir), 50.0).select("sensor_id", "time_s", rounded("filtered"))


@query(f"""WITH RECURSIVE {views.CTES['readings']}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time_s) AS r FROM readings),
    f(sensor_id, r, time_s, v, raw, hat) AS (SELECT sensor_id, r, time_s, value, 0.0::DOUBLE, 0.0::DOUBLE FROM n WHERE r = 1 UNION ALL
      SELECT n.sensor_id, n.r, n.time_s, n.value, (n.value - v) / (n.time_s - f.time_s), (1 - (n.time_s - f.time_s) / (2.0::DOUBLE + (n.time_s - f.time_s))) * hat + (n.time_s - f.time_s) / (2.0::DOUBLE + (n.time_s - f.time_s)) * ((n.value - v) / (n.time_s - f.time_s))
      FROM f JOIN n ON n.sensor_id = f.sensor_id AND n.r = f.r + 1)
    SELECT sensor_id, time_s, round(raw, 6) AS raw, round(hat, 6) AS hat FROM f""")
def drift_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller's drift estimate of every reading."""
    return control.drift_estimate(views.readings(spark, sf_dir), 2.0).select("sensor_id", "time_s", rounded("raw"), rounded("hat"))


@query(sql("readings", """SELECT sensor_id, time_s, round(coalesce((value - exp(-(time_s - lag(time_s) OVER w) / 10.0::DOUBLE) * lag(value) OVER w) / (1 - exp(-(time_s - lag(time_s) OVER w) / 10.0::DOUBLE)), value), 6) AS lead
    FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY time_s)"""))
def lead_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.lead(views.readings(spark, sf_dir), 50.0).select("sensor_id", "time_s", rounded("lead"))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("sensor_id").orderBy("time_s")) - 1
    return views.readings(spark, sf_dir).withColumn("n", n)


def _fractional_sql(weights: list[float], scale: float, first: str = "") -> str:
    values = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    return sql("readings", f""", n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time_s) - 1 AS n FROM readings), w(k, w) AS (VALUES {values})
        SELECT a.sensor_id, CAST(a.n AS INTEGER) AS n, round({first} sum(w * b.value) * {scale!r}::DOUBLE, 9) AS result FROM n a JOIN w ON true JOIN n b ON b.sensor_id = a.sensor_id AND b.n = a.n - k GROUP BY a.sensor_id, a.n""")


@query(_fractional_sql(control.integral_weights(0.5, 8), 4.0**0.5))
def fractional_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fractional(_numbered(spark, sf_dir), 0.5, 4.0, memory=8).select("sensor_id", "n", F.round("result", 9).alias("result"))


@query(_fractional_sql(control.derivative_weights(0.5, 8), 4.0**-0.5))
def fractional_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.fractional(_numbered(spark, sf_dir), 0.5, 4.0, memory=8, derive=True).select("sensor_id", "n", F.round("result", 9).alias("result"))


@query(sql("readings", """SELECT sensor_id, time_s, coalesce(last_value(CASE WHEN abs(300 - value) <= 5 THEN 'hold' WHEN abs(300 - value) >= 15 THEN 'coarse' END IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY time_s ROWS UNBOUNDED PRECEDING), 'coarse') AS mode FROM readings"""))
def mode_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.readings(spark, sf_dir).withColumn("error", 300.0 - F.col("value"))
    return control.modes(e, 5.0, 15.0).select("sensor_id", "time_s", "mode")


@query(sql("readings", "SELECT sensor_id, round(sqrt(sum((1 + time_s % 3) * (300 - value) ** 2) / sum(1 + time_s % 3)), 6) AS rms FROM readings GROUP BY sensor_id"))
def weighted_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.readings(spark, sf_dir).select("sensor_id", (300.0 - F.col("value")).alias("error"), (1.0 + F.col("time_s") % 3).alias("weight"))
    return control.weighted_rms(e, "sensor_id").select("sensor_id", rounded("rms"))


@query(sql("readings", """SELECT sensor_id, round(sum((value + p) / 2 * (time_s - t)), 4) AS energy FROM (SELECT *, lag(value) OVER w AS p, lag(time_s) OVER w AS t FROM readings WINDOW w AS (PARTITION BY sensor_id ORDER BY time_s)) GROUP BY sensor_id"""))
def energy_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoid integral of each series."""
    w = Window.partitionBy("sensor_id").orderBy("time_s")
    piece = (F.col("value") + F.lag("value").over(w)) / 2 * (F.col("time_s") - F.lag("time_s").over(w))
    return views.readings(spark, sf_dir).withColumn("piece", piece).groupBy("sensor_id").agg(F.round(F.sum("piece"), 4).alias("energy"))


@query("SELECT event_type AS phase, round(sum(value), 4) AS total, CAST(max_by(event_id, value * 1000000 - event_id) AS BIGINT) AS worst FROM events GROUP BY event_type")
def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(F.round(F.sum("value"), 4).alias("total"), F.max_by("event_id", F.col("value") * 1000000 - F.col("event_id")).alias("worst"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor_id, node_id, weight: every supplier's box reads the cells near it."""
    c = roles.contacts(views.roles(spark, sf_dir), views.cells(spark, sf_dir), 6.0)
    return roles.deposit_weights(c).withColumnRenamed("role_id", "sensor_id")


_LINKS = ", links AS (SELECT role_id AS sensor_id, node_id, greatest(area, 1) AS w FROM (SELECT *, min(gap) OVER (PARTITION BY role_id) AS m FROM near) WHERE gap <= m + 1e-9)"


@query(sql("cells roles near", _LINKS + " SELECT sensor_id, round(sum(CASE WHEN node_id % 9 <> 0 THEN w * (290 + node_id % 20) END) / sum(CASE WHEN node_id % 9 <> 0 THEN w END), 6) AS readout_k FROM links GROUP BY sensor_id"))
def sensor_readout_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted readouts; every ninth cell's temperature is NaN and does not count."""
    t = views.cells(spark, sf_dir).select("node_id", F.when(F.col("node_id") % 9 == 0, float("nan")).otherwise(290.0 + F.col("node_id") % 20).alias("temperature_k"))
    return roles.readout(_links(spark, sf_dir), t).select("sensor_id", rounded("readout_k"))


@query(sql("cells mats props roles near", _LINKS + " SELECT sensor_id, round(avg(1 / cap), 9) AS inverse_c FROM links JOIN props USING (node_id) GROUP BY sensor_id"))
def mean_inverse_capacitance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.inverse_capacity(_links(spark, sf_dir), props(spark, sf_dir)).select("sensor_id", F.round("inverse_c", 9).alias("inverse_c"))


@query(sql("cells roles near", _LINKS + ", ws AS (SELECT *, w / sum(w) OVER (PARTITION BY sensor_id) AS f FROM links) SELECT node_id, round(sum(f * (1 + sensor_id % 4)), 6) AS power_w FROM ws WHERE sensor_id % 2 = 0 GROUP BY node_id"))
def heater_deposit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _links(spark, sf_dir).withColumnRenamed("sensor_id", "heater_id")
    commands = views.roles(spark, sf_dir).where("kind = 'heater'").select(F.col("role_id").alias("heater_id"), (1.0 + F.col("role_id") % 4).alias("power_w"))
    return roles.deposit(commands, w).select("node_id", rounded("power_w"))


@query(sql("cells", "SELECT node_id, round(least(greatest(0.5::DOUBLE * (250 + node_id % 40 - 270), 0), 8), 6) AS power_w FROM cells"))
def cryocooler_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.cryocooler_power(250.0 + F.col("node_id") % 40, F.lit(270.0), F.lit(0.5), F.lit(8.0))
    return views.cells(spark, sf_dir).select("node_id", F.round(p, 6).alias("power_w"))


@query(sql("cells", "SELECT component, node_id, round(CASE WHEN bad THEN 1.0::DOUBLE / n ELSE w / t END, 9) AS weight FROM (SELECT *, bool_or(w < 0) OVER p OR sum(w) OVER p <= 0 AS bad, sum(w) OVER p AS t, count(*) OVER p AS n FROM (SELECT component, node_id, CAST(p_size AS DOUBLE) - CASE WHEN component = 'Brand#3' THEN 20 ELSE 0 END AS w FROM cells) WINDOW p AS (PARTITION BY component))"))
def normalised_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.cells(spark, sf_dir).select("component", "node_id", (F.col("p_size") - F.when(F.col("component") == "Brand#3", 20).otherwise(0)).cast("double").alias("weight"))
    return roles.normalise_weights(w, "component").select("component", "node_id", F.round("weight", 9).alias("weight"))


@query("""WITH p AS (SELECT CAST(s_suppkey % 40 AS BIGINT) AS node, CAST(l_partkey % 40 AS BIGINT) AS other FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1),
    b AS (SELECT node, other FROM p UNION ALL SELECT other, node FROM p) SELECT DISTINCT node AS role_node, other FROM b WHERE node % 5 = 0 AND other % 5 <> 0""")
def body_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the first line of each order, as its SQL says; body_neighbours_all takes every line."""
    return _neighbours(views.table(spark, sf_dir, "lineitem").where("l_linenumber = 1"))


@query()
def body_neighbours_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(views.table(spark, sf_dir, "lineitem"))


def _neighbours(lines: DataFrame) -> DataFrame:
    li = lines.select((F.col("l_suppkey") % 40).cast("long").alias("node_i"), (F.col("l_partkey") % 40).cast("long").alias("node_j"))
    ids = li.select(F.explode(F.array("node_i", "node_j")).alias("node_id")).where("node_id % 5 = 0")
    return roles.body_neighbours(li, ids)


_GAINS = "gain_a gain_r"


@query(sql(_GAINS, """, ids AS (SELECT DISTINCT sensor_id FROM (SELECT sensor_id FROM gain_a UNION SELECT sensor_id FROM gain_r)), hs AS (SELECT DISTINCT heater_id FROM (SELECT heater_id FROM gain_a UNION SELECT heater_id FROM gain_r)),
    x AS (SELECT coalesce(a.gain, 0) AS a, coalesce(b.gain, 0) AS b FROM ids CROSS JOIN hs LEFT JOIN gain_a a USING (sensor_id, heater_id) LEFT JOIN gain_r b USING (sensor_id, heater_id))
    SELECT CAST(count(*) AS BIGINT) AS cells, round(max(abs(b - a)), 6) AS max_abs, round(avg(abs(b - a)), 6) AS mean_abs, round(sqrt(sum((b - a) ** 2)) / sqrt(sum(a * a)), 6) AS relative, round(corr(a, b), 6) AS correlation FROM x"""))
def gain_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sysid.compare(views.gains(spark, sf_dir, "A"), views.gains(spark, sf_dir, "R"))
    return c.select("cells", rounded("max_abs"), rounded("mean_abs"), rounded("relative"), rounded("correlation"))


@query(sql(_GAINS, "SELECT sensor_id, heater_id, round(gain, 6) AS gain FROM gain_a WHERE gain <> 0 AND sensor_id % 2 = 0 AND heater_id % 3 = 0"))
def gain_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.gains(spark, sf_dir, "A")
    s, h = g.select("sensor_id").where("sensor_id % 2 = 0"), g.select("heater_id").where("heater_id % 3 = 0")
    return sysid.prune(g, s, h).select("sensor_id", "heater_id", rounded("gain"))


@query("""WITH r AS (SELECT CAST(l_suppkey % 10 AS BIGINT) AS sensor_id, CAST(l_partkey % 7 AS BIGINT) AS heater_id, l_linestatus = 'F' AS base, l_quantity AS v, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 3.5::DOUBLE END AS p FROM lineitem)
    SELECT sensor_id, heater_id, round((avg(CASE WHEN NOT base THEN v END) - avg(CASE WHEN base THEN v END)) / (avg(CASE WHEN NOT base THEN p END) - avg(CASE WHEN base THEN p END)), 6) AS gain FROM r GROUP BY ALL""")
def gain_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("l_linestatus") == "F"
    r = views.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("long").alias("sensor_id"), (F.col("l_partkey") % 7).cast("long").alias("heater_id"), F.when(base, "baseline").otherwise("experiment").alias("phase"), F.col("l_quantity").alias("value"), F.when(base, 1.0).otherwise(3.5).alias("power_w"))
    return sysid.identify(r).select("sensor_id", "heater_id", rounded("gain"))


@query(sql(_GAINS, "SELECT sensor_id, heater_id, round(gain, 6) AS gain FROM gain_r WHERE gain <> 0"))
def gain_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long gains to one map for each sensor and back."""
    return sysid.from_maps(sysid.to_maps(views.gains(spark, sf_dir, "R"))).select("sensor_id", "heater_id", rounded("gain"))


@query(sql(_GAINS, "SELECT p.sensor_id, p.heater_id, round(coalesce(CASE WHEN p.heater_id % 2 = 0 THEN p.gain END, 2 * 0.1::DOUBLE, 0), 6) AS gain FROM gain_a p"))
def dynamic_gain_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.gains(spark, sf_dir, "A")
    inverse = g.select("sensor_id").distinct().withColumn("inverse_c", F.lit(0.1))
    return control.dynamic_gains(g.select("sensor_id", "heater_id"), g.where("heater_id % 2 = 0"), inverse, 2.0).select("sensor_id", "heater_id", rounded("gain"))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Controller groups of four sensors and all heaters they share."""
    g = views.gains(spark, sf_dir, "A").withColumn("group_id", F.floor(F.col("sensor_id") / 4).cast("long"))
    e = g.select("group_id", "sensor_id").distinct().select("group_id", "sensor_id", (F.col("sensor_id") % 5 - 1.0).alias("error"), F.lit(1.0).alias("weight"))
    h = g.select("group_id", "heater_id").distinct().withColumn("max_w", F.lit(4.0))
    return g, e, h


@query()
def qp_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e, h = _groups(spark, sf_dir)
    return control.allocate_groups(g, e.withColumnRenamed("error", "target"), h)


@query()
def mimo_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e, h = _groups(spark, sf_dir)
    return control.mimo_step(e, g, h, kp=0.5, clip_k_s=0.25)


@query(f"""WITH RECURSIVE {views.CTES['readings']}, n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY time_s) AS r FROM readings),
    f(sensor_id, r, time_s, y, mode) AS (SELECT sensor_id, r, time_s, value, CASE WHEN abs(300 - value) <= 5 THEN 'hold' ELSE 'coarse' END FROM n WHERE r = 1 UNION ALL
      SELECT n.sensor_id, n.r, n.time_s, (1 - (n.time_s - f.time_s) / (50.0::DOUBLE + (n.time_s - f.time_s))) * y + (n.time_s - f.time_s) / (50.0::DOUBLE + (n.time_s - f.time_s)) * n.value,
        CASE WHEN abs(300 - n.value) <= 5 THEN 'hold' WHEN abs(300 - n.value) >= 15 THEN 'coarse' ELSE f.mode END FROM f JOIN n ON n.sensor_id = f.sensor_id AND n.r = f.r + 1)
    SELECT sensor_id, time_s, round(y, 6) AS filtered, mode FROM f""")
def stream_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller as a stream over the readings, with state for each sensor and an exactly-once sink."""
    with scratch(spark, "stream") as base:
        views.readings(spark, sf_dir).write.parquet(f"{base}/in")
        out = controller.run_once(spark, f"{base}/in", f"{base}/out", f"{base}/log", tau_s=50.0, setpoint=300.0, hold=5.0, coarse=15.0)
        return staged(out.select("sensor_id", "time_s", rounded("filtered"), "mode"))


@query("SELECT CAST(o_custkey AS BIGINT) AS sensor_id, CAST(min(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END) AS INTEGER) AS level FROM orders GROUP BY o_custkey")
def readout_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three ordered sources (explicit, direct, inherited) each sensor's nodes come from."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("sensor_id"), F.col("o_orderkey").cast("long").alias("node_id"), "o_orderstatus")
    sets = [o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    chosen = roles.sensor_nodes(*sets).join(o, ["sensor_id", "node_id"])
    level = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return chosen.groupBy("sensor_id").agg(F.min(level).alias("level"))


@query("SELECT CAST(c_custkey AS BIGINT) AS heater_id, round(CASE WHEN c_nationkey % 3 <> 0 THEN least(greatest(c_acctbal, 0), 5000) ELSE 0 END, 6) AS power_w FROM customer")
def manual_heater_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("heater_id"), F.round(control.manual_power(F.col("c_acctbal"), F.lit(5000.0), F.col("c_nationkey") % 3 != 0), 6).alias("power_w"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS time_s, CASE WHEN n_nationkey >= 5 AND n_nationkey < 12 THEN 7.5::DOUBLE ELSE 0 END AS power_w FROM nation")
def pulsed_heater(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("int")
    return views.table(spark, sf_dir, "nation").select(n.alias("time_s"), P.pulse(n, F.lit(7.5), F.lit(5), F.lit(12)).alias("power_w"))


