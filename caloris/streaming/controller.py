"""The keyed controller as a stream: filtered readings and mode for each sensor, with state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caloris.session import ship_package

_OUT = "sensor_id long, time_s double, value double, filtered double, mode string"
_STATE = "time_s double, filtered double, mode string"


def fold(rows: pd.DataFrame, time_s: float | None, filtered: float, mode: str, *, tau_s: float, setpoint: float, hold: float, coarse: float) -> tuple[list[tuple], tuple]:
    """Readings in order of time through the low pass and the mode's hysteresis. Readings not newer than the state's last one
    are late: they come out with the filtered value and mode as they stand, and change nothing."""
    out = []
    for t, v in zip(rows.time_s, rows.value, strict=True):
        if time_s is None:
            filtered = v
        elif t > time_s:
            a = (t - time_s) / (tau_s + t - time_s)
            filtered = (1 - a) * filtered + a * v
        else:
            out.append((t, v, filtered, mode))
            continue
        time_s, error = t, abs(setpoint - v)
        mode = "hold" if error <= hold else "coarse" if error >= coarse else mode
        out.append((t, v, filtered, mode))
    return out, (time_s, filtered, mode)


def controller_stream(readings: DataFrame, *, tau_s: float, setpoint: float, hold: float, coarse: float) -> DataFrame:
    """A streaming DataFrame of sensor_id, time_s, value with filtered and mode."""
    ship_package(readings.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("time_s", kind="stable")
        old = state.get if state.exists else (None, 0.0, "coarse")
        out, new = fold(rows, *old, tau_s=tau_s, setpoint=setpoint, hold=hold, coarse=coarse)
        if new[0] is not None:
            state.update(new)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["sensor_id", "time_s", "value", "filtered", "mode"])

    return readings.groupBy("sensor_id").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, readings_path: str, out_path: str, checkpoint: str, **options: float) -> DataFrame:
    """All readings in a folder through the stream into a Parquet sink, exactly once, and the result as a table."""
    source = spark.readStream.schema("sensor_id long, time_s double, value double").parquet(readings_path)
    query = controller_stream(source, **options).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out_path)
