"""Controller operators over per-sensor series: filters, fractional calculus, modes, allocation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caloris.functions.physics import clip
from caloris.session import ship_package, staged


def derivative(readings: DataFrame, key: str = "sensor_id", time: str = "time_s", value: str = "value", floor_s: float = 1e-9) -> DataFrame:
    """readings with rate: change per second since the previous one; null for the first and where time stands still."""
    w = Window.partitionBy(key).orderBy(time)
    dt, dv = F.col(time) - F.lag(time).over(w), F.col(value) - F.lag(value).over(w)
    return readings.withColumn("rate", F.when(dt > floor_s, dv / dt))


#: Rows of a key that one task folds at once.
SCAN_ROWS = 4096


def affine_scan(rows: DataFrame, key: str, order: str, start: float = 0.0) -> DataFrame:
    """rows with y, where y = a * y' + b along each key in `order` and y' = start before the first row.

    Each block of SCAN_ROWS rows is one affine map of the value before it; the maps of a key's blocks are folded in order,
    and then every block on its own. So a long history is work for many tasks, and one task holds a block, or one row a
    block.
    """
    ship_package(rows.sparkSession)
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    numbered = staged(rows.withColumns({"scan_at": at}).withColumn("scan_block", F.floor(F.col("scan_at") / SCAN_ROWS).cast("int")))

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("scan_at")
        a, b = 1.0, 0.0
        for x, y in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            a, b = x * a, x * b + y
        return pa.table({key: table[key].slice(0, 1), "scan_block": table["scan_block"].slice(0, 1), "a": [a], "b": [b]})

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("scan_block")
        before, y = [], start
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            before.append(y)
            y = a * y + b
        return pa.table({key: table[key], "scan_block": table["scan_block"], "before": before})

    kind = dict(rows.dtypes)[key]
    maps = numbered.select(key, "scan_block", "scan_at", "a", "b").groupBy(key, "scan_block").applyInArrow(whole, f"{key} {kind}, scan_block int, a double, b double")
    begins = maps.groupBy(key).applyInArrow(fold, f"{key} {kind}, scan_block int, before double")

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by("scan_at")
        out, y = [], table["before"][0].as_py()
        for a, b in zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True):
            y = a * y + b
            out.append(y)
        return table.drop_columns(["a", "b", "before", "scan_at", "scan_block"]).append_column("y", pa.array(out, pa.float64()))

    kept = [c for c in numbered.columns if c not in ("a", "b", "scan_at", "scan_block")]
    schema = ", ".join(f"{c} {dict(numbered.dtypes)[c]}" for c in kept) + ", y double"
    return numbered.join(begins, [key, "scan_block"]).select(*kept, "a", "b", "before", "scan_at", "scan_block").groupBy(key, "scan_block").applyInArrow(apply, schema)


def low_pass(readings: DataFrame, tau_s: float, key: str = "sensor_id", time: str = "time_s", value: str = "value") -> DataFrame:
    """readings (key, time, value) with filtered: y = (1 - a) y' + a x, a = dt / (tau + dt); the first is its value, and where
    time stands still it stays."""
    dt = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time))
    share = F.when(dt.isNull(), F.lit(1.0)).when(dt > 0, dt / (tau_s + dt)).otherwise(F.lit(0.0))
    rows = readings.select(key, F.col(time).cast("double"), F.col(value).cast("double")).withColumn("b", share)
    rows = rows.withColumns({"a": 1.0 - F.col("b"), "b": F.col("b") * F.col(value)})
    return affine_scan(rows, key, time).select(key, time, value, F.col("y").alias("filtered"))


def drift_estimate(readings: DataFrame, tau_s: float, floor_s: float = 1e-9, key: str = "sensor_id", time: str = "time_s", value: str = "value") -> DataFrame:
    """readings with raw (change per second) and hat, its low pass from 0: hat = (1 - a) hat' + a raw, a = dt / (tau + dt).

    Where there is no reading before, time stands still or the change is not finite, raw is the filtered value before, so
    the estimate stays.
    """
    w = Window.partitionBy(key).orderBy(time)
    dt, change = F.col(time) - F.lag(time).over(w), F.col(value) - F.lag(value).over(w)
    rate = F.when(dt > floor_s, change / dt)
    rate = F.when(F.isnan(rate) | (F.abs(rate) == float("inf")), None).otherwise(rate)
    rows = readings.select(key, F.col(time).cast("double"), F.col(value).cast("double"), rate.alias("rate"), F.when(rate.isNotNull(), dt / (tau_s + dt)).otherwise(F.lit(0.0)).alias("share"))
    rows = rows.withColumns({"a": 1.0 - F.col("share"), "b": F.col("share") * F.coalesce("rate", F.lit(0.0))})
    out = affine_scan(rows, key, time)
    before = F.coalesce(F.lag("y").over(w), F.lit(0.0))
    return out.withColumn("raw", F.coalesce("rate", before)).select(key, time, value, "raw", F.col("y").alias("hat"))


def lead(readings: DataFrame, settle_s: float, key: str = "sensor_id", time: str = "time_s", value: str = "value") -> DataFrame:
    """readings with lead: the value a first-order sensor of a fifth of the settling time is heading for."""
    w = Window.partitionBy(key).orderBy(time)
    a = F.exp(-(F.col(time) - F.lag(time).over(w)) / (settle_s / 5.0))
    return readings.withColumn("lead", F.coalesce((F.col(value) - a * F.lag(value).over(w)) / (F.lit(1.0) - a), F.col(value)))


def integral_weights(order: float, n: int) -> list[float]:
    """Grunwald-Letnikov weights of a fractional integral, newest first."""
    w = [1.0]
    for k in range(1, n):
        w.append(w[-1] * (k - 1 + order) / k)
    return w


def derivative_weights(order: float, n: int) -> list[float]:
    w = [1.0]
    for k in range(1, n):
        w.append(w[-1] * (1 - (order + 1) / k))
    return w


def fractional(readings: DataFrame, order: float, dt: float, *, memory: int, derive: bool = False, key: str = "sensor_id", index: str = "n", value: str = "value") -> DataFrame:
    """readings with result: the fractional integral (or derivative) over the last `memory` values.

    index numbers each key's readings from 0. Order 0 gives the value itself; a derivative of order 1 starts at 0.
    """
    weights = (derivative_weights if derive else integral_weights)(order, memory)
    w = Window.partitionBy(key).orderBy(index).rowsBetween(-(memory - 1), 0)
    # values arrive in order of index; the newest is last
    recent = F.reverse(F.transform(F.array_sort(F.collect_list(F.struct(index, value)).over(w)), lambda x: x[value]))
    summed = F.aggregate(F.zip_with(recent, F.array(*[F.lit(x) for x in weights]), lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(0.0), lambda a, b: a + b)
    result = F.col(value) if order <= 1e-12 else summed * (dt ** (-order if derive else order))
    if derive and order == 1.0:
        result = F.when(F.row_number().over(Window.partitionBy(key).orderBy(index)) == 1, F.lit(0.0)).otherwise(result)
    return readings.withColumn("result", result)


def modes(readings: DataFrame, hold: float, coarse: float, key: str = "sensor_id", time: str = "time_s", error: str = "error") -> DataFrame:
    """readings with mode: 'hold' once the error is at most hold, 'coarse' once it is at least coarse, else as before;
    coarse at first."""
    size = F.abs(F.col(error))
    crossed = F.when(size <= hold, "hold").when(size >= coarse, "coarse")
    w = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return readings.withColumn("mode", F.coalesce(F.last(crossed, ignorenulls=True).over(w), F.lit("coarse")))


def weighted_rms(errors: DataFrame, key: str, error: str = "error", weight: str = "weight") -> DataFrame:
    """key, rms: sqrt(sum w e^2 / sum w); all weights count the same if their sum is not positive."""
    e2, total = F.pow(F.col(error), F.lit(2)), F.sum(weight)
    return errors.groupBy(key).agg(F.sqrt(F.when(total > 0, F.sum(F.col(weight) * e2) / total).otherwise(F.avg(e2))).alias("rms"))


def allocate(b: np.ndarray, target: np.ndarray, *, weight: np.ndarray | None = None, reference: np.ndarray | None = None, ridge: float = 0.0, previous: np.ndarray | None = None, smooth: float = 0.0, low: np.ndarray, high: np.ndarray, slew: np.ndarray | None = None, most: int = 500) -> np.ndarray:
    """Bounded least squares: min |sqrt(q)(B u - y)|^2 + ridge |u - ref|^2 + smooth |u - prev|^2 within box and slew.

    Coordinate descent on the normal equations with clipping: exact at convergence, as the problem is convex.
    """
    n = b.shape[1]
    q = np.ones(len(target)) if weight is None else weight
    h = (b.T * q) @ b + (ridge + smooth + 1e-12) * np.eye(n)
    f = (b.T * q) @ target + ridge * (np.zeros(n) if reference is None else reference) + smooth * (np.zeros(n) if previous is None else previous)
    if slew is not None and previous is not None:
        low, high = np.maximum(low, previous - slew), np.minimum(high, previous + slew)
    u = np.clip(np.linalg.solve(h, f), low, high)
    for _ in range(most):
        old = u.copy()
        for k in range(n):
            u[k] = min(max((f[k] - h[k] @ u + h[k, k] * u[k]) / h[k, k], low[k]), high[k])
        if np.abs(u - old).max() <= 1e-12 * (1 + np.abs(u).max()):
            break
    return u


def allocate_groups(gains: DataFrame, targets: DataFrame, heaters: DataFrame, *, ridge: float = 1e-6) -> DataFrame:
    """group_id, heater_id, power_w: allocation in each controller group.

    gains: group_id, sensor_id, heater_id, gain; targets: group_id, sensor_id, target, weight; heaters: group_id,
    heater_id, max_w. A group is one controller and small.
    """
    rows = gains.join(targets, ["group_id", "sensor_id"]).join(heaters, ["group_id", "heater_id"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sensors, heaters = sorted(pdf.sensor_id.unique()), sorted(pdf.heater_id.unique())
        b = pdf.pivot_table(index="sensor_id", columns="heater_id", values="gain", aggfunc="sum", fill_value=0.0).loc[sensors, heaters].to_numpy()
        one = pdf.groupby("sensor_id").first().loc[sensors]
        high = pdf.groupby("heater_id").max_w.first().loc[heaters].to_numpy()
        u = allocate(b, one.target.to_numpy(), weight=one.weight.to_numpy(), ridge=ridge, low=np.zeros(len(heaters)), high=high)
        return pd.DataFrame({"group_id": pdf.group_id.iloc[0], "heater_id": heaters, "power_w": u})

    return rows.groupBy("group_id").applyInPandas(solve, "group_id long, heater_id long, power_w double")


def mimo_step(errors: DataFrame, gains: DataFrame, heaters: DataFrame, *, kp: float, clip_k_s: float, ridge: float = 1e-6) -> DataFrame:
    """One controller step: clipped proportional rate targets, then allocation over the heaters."""
    targets = errors.select("group_id", "sensor_id", clip(F.col("error") * kp, -clip_k_s, clip_k_s).alias("target"), F.coalesce("weight", F.lit(0.5)).alias("weight"))
    return allocate_groups(gains, targets, heaters, ridge=ridge)


def dynamic_gains(pairs: DataFrame, explicit: DataFrame, inverse_c: DataFrame, alpha: float = 1.0) -> DataFrame:
    """sensor_id, heater_id, gain: the explicit gain, else alpha times the sensor's mean inverse capacity."""
    base = pairs.join(explicit.withColumnRenamed("gain", "own"), ["sensor_id", "heater_id"], "left").join(inverse_c, "sensor_id", "left")
    return base.select("sensor_id", "heater_id", F.coalesce("own", alpha * F.col("inverse_c"), F.lit(0.0)).alias("gain"))


def manual_power(command_w: Column, most_w: Column, paired: Column) -> Column:
    """A manual heater's power: clamped, and none without a paired sensor."""
    return F.when(paired, clip(command_w, 0.0, most_w)).otherwise(F.lit(0.0))
