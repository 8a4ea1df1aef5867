"""The multi-input controller: who takes part, inherited settings, one whole step with its state, and power readouts.

Heaters and sensors are long tables. Settings are columns named as in SETTINGS. What one controller (a group) needs in a step
is small; all groups step at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from caloris.functions.physics import clip, cryocooler_power
from caloris.operators import roles
from caloris.operators.control import allocate, derivative_weights, integral_weights
from caloris.session import ship_package

#: A controller's settings and the values that count as not set.
SETTINGS = {
    "sensor_control_mode": "manual", "sensor_manual_power_w": 0.0, "controller_weight": 0.0, "sensor_settling_time_s": 0.0, "controller_kp_coarse": 0.0, "controller_ki_coarse": 0.0, "controller_kd_coarse": 0.0,
    "controller_kp_hold": 0.0, "controller_ki_hold": 0.0, "controller_kd_hold": 0.0, "controller_lambda_order": 1.0, "controller_mu_order": 1.0,
}
NUMBERS = [k for k in SETTINGS if k != "sensor_control_mode"]


def control_mode(c: Column) -> Column:
    """'mimo' for mimo, mimo_pid and pid whatever the case, else 'manual'."""
    return F.when(F.lower(F.trim(F.coalesce(c, F.lit("manual")))).isin("mimo", "mimo_pid", "pid"), "mimo").otherwise("manual")


def is_default(prefix: str = "") -> Column:
    """Whether all settings are at the values that count as not set; numbers that cannot be read do not count."""
    number = lambda k: F.coalesce(F.abs(F.col(f"{prefix}{k}").cast("double") - F.lit(float(SETTINGS[k]))) <= 1e-12, F.lit(True))
    out = F.lower(F.trim(F.coalesce(F.col(f"{prefix}sensor_control_mode"), F.lit("manual")))) != "mimo"
    for k in NUMBERS:
        out = out & number(k)
    return out


def inherit(heaters: DataFrame, sensors: DataFrame) -> DataFrame:
    """heaters with the settings that hold: those of the assigned sensor where the heater has none of its own.

    Adds `inherited`. heaters: heater_id, sensor_id (assigned, may be null) and SETTINGS; sensors: sensor_id and SETTINGS.
    """
    s = sensors.select("sensor_id", *[F.col(k).alias(f"of_{k}") for k in SETTINGS], F.lit(True).alias("known"))
    rows = heaters.join(s, "sensor_id", "left").withColumn("inherited", is_default() & F.coalesce("known", F.lit(False)))
    own = {k: F.when(F.col("inherited"), F.col(f"of_{k}")).otherwise(F.col(k)) for k in NUMBERS}
    own["sensor_control_mode"] = F.when(F.lower(F.trim("sensor_control_mode")) == "mimo", "mimo").when(F.col("inherited") & (F.lower(F.trim("of_sensor_control_mode")) == "mimo"), "mimo").otherwise("manual")
    return rows.withColumns(own).drop(*[f"of_{k}" for k in SETTINGS], "known")


def migrate(heaters: DataFrame, sensors: DataFrame) -> DataFrame:
    """Heaters of an older layout, in which settings stood on sensors: a heater without settings of its own takes those of
    its sensor, if the sensor has any. Of several sensors that name a heater the one with the least id counts."""
    named = sensors.select(F.explode(F.array_distinct(F.filter(F.concat(F.coalesce("assigned_heater_ids", F.array().cast("array<bigint>")), F.array("assigned_heater_id")), lambda x: x.isNotNull()))).alias("heater_id"), "sensor_id")
    links = named.unionByName(heaters.where("sensor_id IS NOT NULL").select("heater_id", "sensor_id"))
    wanted = sensors.where(~is_default()).join(links, "sensor_id").groupBy("heater_id").agg(F.min_by(F.struct(*SETTINGS), "sensor_id").alias("of"))
    rows = heaters.join(wanted, "heater_id", "left").withColumn("takes", is_default() & F.col("of").isNotNull())
    return rows.withColumns({k: F.when(F.col("takes"), F.col(f"of.{k}")).otherwise(F.col(k)) for k in SETTINGS}).drop("of", "takes")


_CONTROL = "mode string, pid struct<kp: double, ki: double, kd: double, lambda_order: double, lambda: double, lambdaOrder: double, mu_order: double, mu: double, muOrder: double, integral_leak_per_s: double, integralLeakPerS: double, setpoint: double>, manual struct<power: double>, pid_state struct<integral: double, previous_error: double, previousError: double>"


def read_control(text: Column, setpoint_k: float = 293.15, power_w: float = 0.0) -> Column:
    """A heater's control settings from JSON, with older names of fields and defaults: mode, gains, orders and leak (none below
    0), setpoint, manual power, and the state of its integral."""
    c = F.from_json(text, _CONTROL)
    first = lambda default, *names: F.coalesce(*[c[a][b] for a, b in (n.split(".") for n in names)], F.lit(default))
    least = lambda default, *names: F.greatest(F.lit(0.0), first(default, *names))
    return F.struct(
        F.when(c["mode"].isin("pid", "mimo", "manual"), c["mode"]).otherwise("manual").alias("mode"), *[first(0.0, f"pid.{k}").alias(k) for k in ("kp", "ki", "kd")],
        least(1.0, "pid.lambda_order", "pid.lambda", "pid.lambdaOrder").alias("lambda_order"), least(1.0, "pid.mu_order", "pid.mu", "pid.muOrder").alias("mu_order"), least(0.0, "pid.integral_leak_per_s", "pid.integralLeakPerS").alias("leak_per_s"),
        first(setpoint_k, "pid.setpoint").alias("setpoint"), first(power_w, "manual.power").alias("power_w"), first(0.0, "pid_state.integral").alias("integral"), F.coalesce(c["pid_state"]["previous_error"], c["pid_state"]["previousError"]).alias("previous_error"),
    )


def heater_average(heaters: DataFrame, setting: str, default: float) -> DataFrame:
    """sensor_id and the mean of a setting over the sensor's heaters, none below 0; a weight that is not positive is 0.5."""
    value = F.coalesce(F.avg(F.greatest(F.col(setting).cast("double"), F.lit(0.0))), F.lit(max(0.0, default)))
    return heaters.where("sensor_id IS NOT NULL").groupBy("sensor_id").agg((F.when(value > 0, value).otherwise(F.lit(0.5)) if setting == "controller_weight" else value).alias(setting))


def enabled(rows: DataFrame, ids: list[int] | None, column: str) -> DataFrame:
    """The rows whose id is enabled; None enables all."""
    return rows if ids is None else rows.where(F.col(column).isin([int(i) for i in ids]))


def mimo_sensor() -> Column:
    """Whether a sensor can control: valid, not for monitoring only, and with nodes to read or a heater of its own."""
    return F.col("is_sensor") & F.coalesce("sensor_valid", F.lit(True)) & ~F.coalesce("sensor_monitor_only", F.lit(False)) & ((F.size("readout_node_ids") > 0) | F.col("is_heater"))


def mimo_heater() -> Column:
    return F.col("is_heater") & F.coalesce("heater_valid", F.lit(True)) & (F.size("power_deposition_node_ids") > 0) & (F.col("sensor_control_mode") == "mimo") & F.col("assigned_sensor_id").isNotNull()


def active_pairs(heaters: DataFrame, sensors: DataFrame, heater_ids: list[int] | None = None, sensor_ids: list[int] | None = None) -> DataFrame:
    """heater_id, sensor_id of the enabled heaters that a controller drives. Settings are the inherited ones."""
    h = enabled(heaters.where(mimo_heater()), heater_ids, "heater_id")
    s = enabled(sensors.where(mimo_sensor()), sensor_ids, "sensor_id").select("sensor_id")
    return h.select("heater_id", F.col("assigned_sensor_id").alias("sensor_id")).join(s, "sensor_id", "left_semi").select("heater_id", "sensor_id")


def passive_drift(links: DataFrame, rates: DataFrame) -> DataFrame:
    """sensor_id, passive_k_s: what each sensor's readout would change by without its heaters; 0 where nothing is finite.

    rates: node_id, rate_k_s, the right-hand side at the present temperatures."""
    out = roles.readout(links, rates.select("node_id", F.col("rate_k_s").alias("temperature_k")))
    return out.select("sensor_id", F.coalesce("readout_k", F.lit(0.0)).alias("passive_k_s"))


@dataclass(frozen=True)
class Params:
    """Settings of the controller as a whole."""

    dt_s: float = 1.0
    hold_k: float = 1.0
    coarse_k: float = 5.0
    rate_most_k_s: float = 0.25
    lambda_u: float = 1e-3
    rho_du: float = 0.0
    slew_w_s: float = 0.0
    integral_most: float = 1e6
    freeze_saturated: bool = True


def _fractional(history: list[float], dt: float, order: float, derive: bool) -> float:
    if not history:
        return 0.0
    order = max(0.0, order)
    if derive and len(history) == 1 and abs(order - 1.0) <= 1e-12:
        return 0.0
    if order <= 1e-12:
        return history[-1]
    weights = (derivative_weights if derive else integral_weights)(order, len(history))
    return float(np.dot(weights, history[::-1])) * dt ** (-order if derive else order)


def step_group(sensors: pd.DataFrame, heaters: pd.DataFrame, gains: np.ndarray, p: Params) -> tuple[np.ndarray, list[dict]]:
    """Heater commands and the sensors' new state of one controller; rows are in order of ids, gains sensors by heaters.

    Lead estimate, errors, mode, fractional terms, clipped rate commands, feed-forward, allocation, anti-windup.
    """
    dt = max(p.dt_s, 1e-12)
    y, before = sensors.readout_k.to_numpy(float), sensors.y_prev.to_numpy(float)
    tau = sensors.settling_s.to_numpy(float) / 5.0
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.exp(-dt / np.maximum(tau, 1e-12))
        ahead = (y - a * before) / (1 - a)
    estimate = np.where(np.isnan(before) | (tau <= 0) | (1 - a <= 1e-9), y, ahead)
    errors, q = sensors.setpoint_k.to_numpy(float) - estimate, sensors.weight.to_numpy(float)
    share = q if q.sum() > 0 else np.ones(len(q))
    rms = float(np.sqrt((share * errors**2).sum() / share.sum()))
    old = sensors["mode"].iloc[0]
    mode = "hold" if rms <= p.hold_k else "coarse" if rms >= p.coarse_k else old
    if old == "coarse" and rms > p.hold_k or old == "hold" and rms < p.coarse_k:
        mode = old
    histories = [[] if mode != old or h is None else [float(x) for x in h] for h in sensors.history]
    orders_i, orders_d = sensors.order_i.to_numpy(float), sensors.order_d.to_numpy(float)
    most = p.integral_most if p.integral_most > 0 else np.inf
    integral = np.clip([_fractional([*h, e], dt, o, False) for h, e, o in zip(histories, errors.tolist(), orders_i, strict=True)], -most, most)
    slope = np.array([_fractional([*h, e], dt, o, True) for h, e, o in zip(histories, errors.tolist(), orders_d, strict=True)])
    row = np.array([sensors.index[sensors.sensor_id == s][0] for s in heaters.sensor_id])
    shared = np.where(heaters.inherited, np.bincount(row, minlength=len(sensors))[row], 1)
    kp, ki, kd = (np.maximum(heaters[f"{k}_{mode}"].to_numpy(float), 0.0) / shared for k in ("kp", "ki", "kd"))
    command = kp * errors[row] + ki * integral[row] + kd * slope[row]
    rate = np.bincount(row, command, len(sensors))
    clipped = np.clip(rate, -p.rate_most_k_s, p.rate_most_k_s) if p.rate_most_k_s > 0 else rate
    scale = np.where((np.abs(rate) > p.rate_most_k_s) & (np.abs(rate) > 1e-15) & (p.rate_most_k_s > 0), clipped / np.where(rate == 0, 1, rate), 1.0)
    command = command * scale[row]
    high, last = heaters.max_w.to_numpy(float), np.clip(heaters.u_prev.to_numpy(float), 0.0, heaters.max_w.to_numpy(float))
    passive = sensors.passive_k_s.to_numpy(float)
    some = (high > 0) & (np.abs(gains) > 0).any()

    def solve(target: np.ndarray, **more) -> np.ndarray:  # noqa: ANN003
        u = np.zeros(len(heaters))
        if some.any():
            u[some] = allocate(gains[:, some], target, weight=q, low=np.zeros(some.sum()), high=high[some], **{k: v[some] if isinstance(v, np.ndarray) else v for k, v in more.items()})
        return np.clip(u, 0.0, high)

    forward = solve(-passive)
    own = gains[row, np.arange(len(heaters))]
    wanted = np.clip(forward + np.where(np.abs(own) > 1e-15, command / np.where(own == 0, 1, own), 0.0), 0.0, high)
    slew = {"slew": np.full(len(heaters), p.slew_w_s * dt)} if p.slew_w_s > 0 else {}
    u = solve(clipped - passive, reference=wanted, ridge=p.lambda_u, previous=last, smooth=p.rho_du, **slew)
    state = []
    for k, (h, e) in enumerate(zip(histories, errors.tolist(), strict=True)):
        relevant = np.abs(gains[k]) > 1e-12
        stuck = relevant.any() and (e < 0 and (u[relevant] <= 1e-9).all() or e > 0 and (u[relevant] >= np.maximum(high[relevant] - 1e-9, 0)).all())
        kept = h if p.freeze_saturated and stuck else [*h, e]
        state.append({"mode": mode, "error_k": e, "history": kept, "integral": float(np.clip(_fractional(kept, dt, orders_i[k], False), -most, most)), "y_prev": float(y[k])})
    return u, state


def step(sensors: DataFrame, heaters: DataFrame, gains: DataFrame, params: Params) -> DataFrame:
    """One step of every controller: kind ('heater' or 'sensor'), group_id, id, and a heater's power_w or a sensor's new state.

    sensors: group_id, sensor_id, setpoint_k, readout_k, y_prev, settling_s, weight, order_i, order_d, passive_k_s, mode, history.
    heaters: group_id, heater_id, sensor_id, inherited, max_w, u_prev, kp_coarse, ... kd_hold. gains: group_id, sensor_id,
    heater_id, gain. Sensors without a finite readout and their heaters take no part.
    """
    ship_package(sensors.sparkSession)
    fine = sensors.where(F.col("readout_k").isNotNull() & ~F.isnan("readout_k"))
    h = heaters.join(fine.select("group_id", "sensor_id"), ["group_id", "sensor_id"], "left_semi")
    h = h.join(gains.groupBy("group_id", "heater_id").agg(F.map_from_entries(F.collect_list(F.struct("sensor_id", "gain"))).alias("gains")), ["group_id", "heater_id"], "left")
    schema = "kind string, group_id long, id long, power_w double, mode string, error_k double, integral double, y_prev double, history array<double>"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["kind", "group_id", "id", "power_w", "mode", "error_k", "integral", "y_prev", "history"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        s, r = left.sort_values("sensor_id").reset_index(drop=True), right.sort_values("heater_id").reset_index(drop=True)
        b = np.array([[float((g or {}).get(i, 0.0)) for g in r.gains] for i in s.sensor_id])
        u, state = step_group(s, r, b, params)
        out = [("heater", s.group_id[0], i, x, None, None, None, None, None) for i, x in zip(r.heater_id, u, strict=True)]
        out += [("sensor", s.group_id[0], i, None, z["mode"], z["error_k"], z["integral"], z["y_prev"], z["history"]) for i, z in zip(s.sensor_id, state, strict=True)]
        return pd.DataFrame(out, columns=names)

    fine, h = (x.toDF(*x.columns) for x in (fine, h))  # columns of their own, as both may come from one table
    return fine.groupBy("group_id").cogroup(h.groupBy("group_id")).applyInPandas(run, schema)


def heater_commands(heaters: DataFrame, sensors: DataFrame, controlled: DataFrame, *, heater_ids: list[int] | None = None, sensor_ids: list[int] | None = None) -> DataFrame:
    """heater_id, power_w: a manual heater's clamped command, a controlled one's allocation (heater_id, power_w), else 0.

    A manual heater needs an enabled sensor, and nodes to heat. Settings are the inherited ones."""
    s = enabled(sensors.where("is_sensor"), sensor_ids, "sensor_id").select(F.col("sensor_id").alias("assigned_sensor_id"), F.lit(True).alias("has_sensor"))
    usable = F.col("is_heater") & F.coalesce("heater_valid", F.lit(True)) & (F.size("power_deposition_node_ids") > 0) & F.coalesce("has_sensor", F.lit(False))
    if heater_ids is not None:
        usable = usable & F.col("heater_id").isin([int(i) for i in heater_ids])
    most = F.greatest(F.col("heater_max_power_w") * F.col("heater_efficiency"), F.lit(0.0))
    manual = F.when(usable & (F.col("sensor_control_mode") != "mimo"), clip(F.col("sensor_manual_power_w"), 0.0, most)).otherwise(F.lit(0.0))
    rows = heaters.join(s, "assigned_sensor_id", "left").join(controlled.select("heater_id", F.col("power_w").alias("allocated")), "heater_id", "left")
    return rows.select("heater_id", F.coalesce(F.when(usable & (F.col("sensor_control_mode") == "mimo"), F.col("allocated")), manual).alias("power_w"))


def power_by_node(commands: DataFrame, weights: DataFrame, nodes: DataFrame, *, setpoint_k: float, gain: float, most_w: float) -> DataFrame:
    """node_id, heater_w, cooler_w, actuator_w: heat deposited on each node, heat that its cooler takes, and their difference.

    nodes: node_id, temperature_k, has_cryocooler."""
    heat = roles.deposit(commands, weights).withColumnRenamed("power_w", "heater_w")
    cool = F.when(F.col("has_cryocooler"), cryocooler_power(F.col("temperature_k"), F.lit(setpoint_k), F.lit(gain), F.lit(max(0.0, most_w)))).otherwise(F.lit(0.0))
    rows = nodes.join(heat, "node_id", "left").select("node_id", F.coalesce("heater_w", F.lit(0.0)).alias("heater_w"), cool.alias("cooler_w"))
    return rows.withColumn("actuator_w", F.col("heater_w") - F.col("cooler_w"))
