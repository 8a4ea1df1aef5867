"""A simulation as a session: choice of the stepper, steps with a history, forced powers, runs, and gain identification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from caloris.operators import roles, simulate
from caloris.session import staged


@dataclass(frozen=True)
class Params:
    dt_s: float = 1.0
    t_final_s: float = 60.0
    #: Steppers in the order in which they are tried; one that fails is left out from then on.
    methods: tuple[str, ...] = ("implicit", "explicit", "exponential")
    implicit_method: str = "tr_bdf2"
    target_delta_k: float = 1.0
    most_implicit_substeps: int = 4
    safety: float = 0.2
    most_explicit_substeps: int = 128
    history_limit: int = 256
    radiation: bool = True


class Simulation:
    """Steps of C dT/dt = -L T + P + radiation from a state, with a bounded history that can be gone back to.

    state: node_id, capacity_j_k, temperature_k, power_w, radiation_w_k4, surroundings_k. Every state of the history is a
    checkpointed table, so going back and forth computes nothing anew.
    """

    def __init__(self, state: DataFrame, edges: DataFrame, params: Params = Params()) -> None:
        self.params, self.edges, self.initial = params, staged(edges), staged(state)
        self.warnings = [f"{r['rule']}: {r['subject']}" for r in simulate.validate_inputs(self.initial, self.edges, params.dt_s, radiation=params.radiation).groupBy("rule").agg(F.min("subject").alias("subject")).orderBy("rule").collect()]
        self.failed: set[str] = set()
        self.reset()

    @property
    def time_s(self) -> float:
        return self.history[self.index][0]

    @property
    def state(self) -> DataFrame:
        return self.history[self.index][1]

    def reset(self) -> None:
        self.history, self.index = [(0.0, self.initial)], 0

    def set_temperatures(self, given: DataFrame | float) -> None:
        """Start anew from these temperatures: a number for all nodes, or a table (node_id, temperature_k) for some."""
        if isinstance(given, DataFrame):
            rows = self.initial.join(given.select("node_id", F.col("temperature_k").alias("given")), "node_id", "left").withColumn("temperature_k", F.coalesce("given", "temperature_k")).drop("given")
        else:
            rows = self.initial.withColumn("temperature_k", F.lit(float(given)))
        self.history, self.index = [(0.0, staged(rows))], 0

    def snapshot(self) -> tuple[list[tuple[float, DataFrame]], int]:
        return [*self.history], self.index

    def restore(self, snapshot: tuple[list[tuple[float, DataFrame]], int]) -> None:
        self.history, self.index = [*snapshot[0]], snapshot[1]

    def seek(self, index: int) -> DataFrame:
        """The state of the history at an index, held within it."""
        self.index = max(0, min(int(index), len(self.history) - 1))
        return self.state

    def back(self) -> DataFrame:
        return self.seek(self.index - 1)

    def _by(self, method: str, state: DataFrame) -> DataFrame:
        p = self.params
        if not p.radiation:
            state = state.withColumn("radiation_w_k4", F.lit(0.0))
        if method == "implicit":
            return simulate.implicit_steps(state, self.edges, p.dt_s, method=p.implicit_method, target_delta_k=p.target_delta_k, most_substeps=p.most_implicit_substeps)
        if method == "exponential":
            return simulate.exponential_steps(state, self.edges, p.dt_s, 1)
        return simulate.explicit_steps(state, self.edges, p.dt_s, 1, substeps=None, safety=p.safety, most=p.most_explicit_substeps).where("step = 1").select("node_id", "temperature_k")

    def _advance(self, state: DataFrame) -> DataFrame:
        """The state after a step by the first stepper that manages it; power_w is what acts in this step."""
        for method in self.params.methods:
            if method not in self.failed:
                try:
                    return staged(state.drop("temperature_k").join(self._by(method, state), "node_id"))
                except (RuntimeError, ValueError) as e:
                    self.warnings.append(f"{method}: {e}")
                    self.failed.add(method)
        raise RuntimeError("; ".join(self.warnings))

    def _append(self, state: DataFrame) -> DataFrame:
        time = self.time_s + self.params.dt_s
        self.history = [*self.history[: self.index + 1], (time, state)][-max(self.params.history_limit, 1) :]
        self.index = len(self.history) - 1
        return state

    def step(self) -> DataFrame:
        """The next state: that of the history where one has gone back, else a new one."""
        if self.index < len(self.history) - 1:
            return self.seek(self.index + 1)
        return self._append(self._advance(self.state))

    def forced_step(self, powers: DataFrame) -> DataFrame:
        """A step in which the given powers (node_id, power_w) act and nothing else; a node without one has none."""
        given = powers.groupBy("node_id").agg(F.sum("power_w").alias("given"))
        forced = self.state.join(given, "node_id", "left").withColumn("power_w", F.coalesce("given", F.lit(0.0))).drop("given")
        after = self._advance(forced).drop("power_w").join(self.state.select("node_id", "power_w"), "node_id")
        return self._append(staged(after))

    def run(self, steps: int, *, loop: bool = False, cancelled: Callable[[], bool] = lambda: False) -> dict[str, object]:
        """Up to `steps` steps, until the end time (then from the start again if `loop`) or until cancelled."""
        done, before = 0, self.state
        while done < max(1, steps) and not cancelled():
            if self.time_s >= self.params.t_final_s:
                if not loop:
                    break
                self.reset()
            self.step()
            done += 1
        change = self.state.join(before.select("node_id", F.col("temperature_k").alias("old")), "node_id").agg(F.max(F.abs(F.col("temperature_k") - F.col("old")))).first()[0]
        return {"steps": done, "max_delta_k": change or 0.0, "done": self.time_s >= self.params.t_final_s and not loop, "cancelled": cancelled()}

    def trajectory(self) -> DataFrame:
        """time_s, node_id, temperature_k of the whole history."""
        out = None
        for time, state in self.history:
            rows = state.select(F.lit(time).alias("time_s"), "node_id", "temperature_k")
            out = rows if out is None else out.unionByName(rows)
        return out


def compare_methods(state: DataFrame, edges: DataFrame, dt_s: float, steps: int, method: str, reference: str, **options: object) -> DataFrame:
    """One row of errors (see simulate.trajectory_error) of one stepper's run against another's."""
    runs = []
    for m in (method, reference):
        s = Simulation(state, edges, Params(dt_s=dt_s, t_final_s=dt_s * steps, methods=(m,), **options))  # type: ignore[arg-type]
        s.run(steps)
        runs.append(s.trajectory().select(F.round(F.col("time_s") / dt_s).cast("int").alias("step"), "node_id", "temperature_k"))
    return simulate.trajectory_error(*runs)


def save_comparison(errors: DataFrame, trajectories: dict[str, DataFrame], folder: str) -> None:
    """A comparison: its row of errors as JSON, and the runs as tables."""
    errors.write.mode("overwrite").json(f"{folder}/errors")
    for name, run in trajectories.items():
        run.write.mode("overwrite").parquet(f"{folder}/{name}")


def baseline_temperatures(state: DataFrame, sensors: DataFrame, background_k: float) -> DataFrame:
    """node_id, temperature_k: the background, and each sensor's own node at its setpoint (sensor_id, setpoint_k)."""
    s = sensors.select(F.col("sensor_id").alias("node_id"), "setpoint_k")
    return state.select("node_id").join(s, "node_id", "left").select("node_id", F.coalesce("setpoint_k", F.lit(background_k)).alias("temperature_k"))


def identify_gains(state: DataFrame, edges: DataFrame, heaters: DataFrame, weights: DataFrame, links: DataFrame, params: Params, *, delta_w: float, baseline_steps: int, steps: int, final_steps: int) -> DataFrame:
    """sensor_id, heater_id, gain: each heater's step response, from the state on, as change of the mean readout over change of power.

    Every heater's test starts from the same state, so the tests do not depend on each other: they run as copies of the graph
    side by side, one for each heater, in the same steps. heaters: heater_id, max_w; weights: heater_id, node_id, weight;
    links: sensor_id, node_id, weight. A heater that cannot take the step has gain 0.
    """
    width = (state.agg(F.max("node_id")).first()[0] or 0) + 1
    tests = heaters.orderBy("heater_id").collect()  # a controller's heaters
    number = state.sparkSession.createDataFrame([(k, r["heater_id"], min(max(delta_w, 0.0), r["max_w"])) for k, r in enumerate(tests)], "copy long, heater_id long, applied_w double")
    copies = F.explode(F.array(*[F.lit(k).cast("long") for k in range(len(tests))]))
    spread = lambda df, *ids: df.withColumn("copy", copies).withColumns({i: F.col("copy") * width + F.col(i) for i in ids}).drop("copy")
    run = Simulation(spread(state, "node_id"), spread(edges, "node_i", "node_j"), params)
    readers = spread(links, "node_id", "sensor_id")
    own = number.join(weights, "heater_id").select("heater_id", (F.col("copy") * width + F.col("node_id")).alias("node_id"), "weight")
    powers = staged(roles.deposit(number.select("heater_id", F.col("applied_w").alias("power_w")), own))
    idle = powers.withColumn("power_w", F.lit(0.0))
    read = lambda: roles.readout(readers, run.state.select("node_id", "temperature_k"))
    start, final = [], []
    for _ in range(baseline_steps):
        start.append(staged(read()))
        run.forced_step(idle)
    start = start or [staged(read())]
    for k in range(1, steps + 1):
        run.forced_step(powers)
        if k > steps - max(final_steps, 1):
            final.append(staged(read()))

    def mean(samples: list[DataFrame], name: str) -> DataFrame:
        rows = samples[0]
        for s in samples[1:]:
            rows = rows.unionByName(s)
        return rows.groupBy("sensor_id").agg(F.avg("readout_k").alias(name))

    both = mean(start, "t0").join(mean(final, "t1"), "sensor_id").withColumn("copy", F.floor(F.col("sensor_id") / width).cast("long")).join(F.broadcast(number), "copy")
    gain = F.when(F.col("applied_w") > 1e-12, (F.col("t1") - F.col("t0")) / F.col("applied_w"))
    return both.select((F.col("sensor_id") % width).alias("sensor_id"), "heater_id", F.coalesce(gain, F.lit(0.0)).alias("gain"))
