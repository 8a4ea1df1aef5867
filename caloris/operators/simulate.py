"""Time stepping of C dT/dt = -L T + P + radiation.

Nodes: node_id, capacity_j_k, temperature_k, power_w, radiation_w_k4 (e s A) and surroundings_k. Explicit steps are joins
and sums. Implicit steps solve each connected component in a task of its own, as components do not influence each other;
components beyond TASK_NODES take the same steps to the same tolerance by conjugate gradients whose products are joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caloris.operators.graph import both_ways, components
from caloris.session import ship_package, staged

TASK_NODES = 200_000
GAMMA = 2 - math.sqrt(2)
#: Residual of a solve relative to its right side, and the rounds after which it has failed.
RTOL, MOST_ROUNDS = 1e-10, 1000


def rates(state: DataFrame, edges: DataFrame, radiation: bool = True) -> DataFrame:
    """state with rate_k_s, the right-hand side at the present temperatures."""
    t = state.select("node_id", "temperature_k")
    flow = both_ways(edges, "g_w_k").join(t.toDF("node", "t_here"), "node").join(t.toDF("other", "t_there"), "other")
    flow = flow.groupBy("node").agg(F.sum(F.col("g_w_k") * (F.col("t_there") - F.col("t_here"))).alias("flow")).withColumnRenamed("node", "node_id")
    heat = F.coalesce("flow", F.lit(0.0)) + F.col("power_w")
    if radiation:
        heat = heat + F.col("radiation_w_k4") * (F.pow("surroundings_k", F.lit(4)) - F.pow("temperature_k", F.lit(4)))
    return state.join(flow, "node_id", "left").withColumn("rate_k_s", F.when(F.col("capacity_j_k") > 0, heat / F.col("capacity_j_k")).otherwise(F.lit(0.0))).drop("flow")


def explicit_steps(state: DataFrame, edges: DataFrame, dt: float, steps: int, *, substeps: int | None = None, safety: float = 0.2, most: int = 128, radiation: bool = True) -> DataFrame:
    """Forward Euler: step, node_id, temperature_k for the steps 0 to `steps`.

    Without `substeps` as many are taken as keep each below `safety` of the least time constant; if that takes more than
    `most`, the steps are refused.
    """
    out = state.select(F.lit(0).alias("step"), "node_id", "temperature_k")
    edges = staged(edges.select("node_i", "node_j", "g_w_k"))
    if substeps is None:
        least = time_constants(state, edges).agg(F.min("tau_s")).first()[0]
        substeps = substep_count(least, dt, safety) if least else 1
        if substeps > most:
            raise ValueError(f"{substeps} substeps are needed, {most} are allowed")
    for n in range(1, steps + 1):
        for _ in range(substeps):
            # a step reads its state three times, so every step is cut off from the one before
            state = staged(rates(state, edges, radiation).withColumn("temperature_k", F.col("temperature_k") + F.col("rate_k_s") * (dt / substeps)).drop("rate_k_s"))
        out = out.unionByName(state.select(F.lit(n).alias("step"), "node_id", "temperature_k"))
    return out


def validate_inputs(state: DataFrame, edges: DataFrame, dt: float, *, radiation: bool = True) -> DataFrame:
    """rule, subject: what is wrong with a simulation's inputs, or risky.

    Rules: bad_capacity (zero or less), positive_off_diagonal (an edge of negative conductance), negative_radiation,
    bad_surroundings (not finite, with radiation), bad_temperature (not finite), coarse_step (dt above a fifth of the least
    time constant; its subject is that constant).
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    rule = lambda df, name, subject: df.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))
    node = F.col("node_id")
    parts = [
        rule(state.where("NOT coalesce(capacity_j_k > 0, false)"), "bad_capacity", node),
        rule(edges.where("g_w_k < -1e-12"), "positive_off_diagonal", F.concat_ws("-", F.least("node_i", "node_j"), F.greatest("node_i", "node_j"))),
        rule(state.where("radiation_w_k4 < -1e-12"), "negative_radiation", node),
        rule(state.where(~finite("temperature_k")), "bad_temperature", node),
    ]
    if radiation:
        parts.append(rule(state.where(~finite("surroundings_k")), "bad_surroundings", node))
    least = time_constants(state.where("capacity_j_k > 0"), edges.where("g_w_k > 0")).agg(F.min("tau_s").alias("tau_s"))
    parts.append(rule(least.where(F.lit(dt) > 0.2 * F.col("tau_s")), "coarse_step", F.round("tau_s", 6)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_constants(state: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, total_g_w_k, tau_s = C / sum of conductances (null for isolated nodes); a column g_rad_w_k of the state, the
    linear radiative conductance, counts among them."""
    total = both_ways(edges, "g_w_k").groupBy("node").agg(F.sum("g_w_k").alias("g")).withColumnRenamed("node", "node_id")
    g = F.coalesce("g", F.lit(0.0))
    if "g_rad_w_k" in state.columns:
        g = g + F.coalesce("g_rad_w_k", F.lit(0.0))
    return state.join(total, "node_id", "left").select("node_id", g.alias("total_g_w_k"), F.when(g > 0, F.col("capacity_j_k") / g).alias("tau_s"))


def substep_count(least_tau_s: float, dt: float, safety: float = 0.2) -> int:
    """Explicit substeps that keep a step below `safety` of the least time constant."""
    return max(1, math.ceil(dt / max(least_tau_s * min(1.0, max(1e-6, safety)), 1e-12)))


def conjugate_gradient(matvec, b: np.ndarray, diagonal: np.ndarray, x: np.ndarray, rtol: float = RTOL, most: int = MOST_ROUNDS) -> np.ndarray:  # noqa: ANN001
    """Jacobi-preconditioned conjugate gradients for a symmetric positive definite system."""
    r = b - matvec(x)
    z = r / diagonal
    p, rz, goal = z.copy(), float(r @ z), rtol * max(float(np.linalg.norm(b)), 1e-300)
    for _ in range(most):
        if np.linalg.norm(r) <= goal or rz == 0:
            break
        q = matvec(p)
        a = rz / float(p @ q)
        x, r = x + a * p, r - a * q
        z = r / diagonal
        new = float(r @ z)
        p, rz = z + (new / rz) * p, new
    if rz != 0 and not np.linalg.norm(r) <= goal:
        raise RuntimeError(f"conjugate gradients did not converge in {most} rounds")
    return x


def advance_block(c: np.ndarray, t: np.ndarray, source: np.ndarray, i: np.ndarray, j: np.ndarray, g: np.ndarray, dt: float, steps: int, method: str) -> np.ndarray:
    """Implicit steps of one block (edges by position); source in watts is constant over the steps."""
    n = len(c)

    def pull(x: np.ndarray) -> np.ndarray:
        flow = g * (x[j] - x[i])
        return np.bincount(i, flow, n) - np.bincount(j, flow, n)

    loss = np.bincount(i, g, n) + np.bincount(j, g, n)

    def solve(h: float, right: np.ndarray, guess: np.ndarray) -> np.ndarray:
        return conjugate_gradient(lambda x: c * x - h * pull(x), right, c + h * loss, guess)

    for _ in range(steps):
        if method == "backward_euler":
            t = solve(dt, c * t + dt * source, t)
        else:  # a trapezoid over gamma dt, then a second-order backward difference
            h = GAMMA * dt / 2
            middle = solve(h, c * t + h * (pull(t) + 2 * source), t)
            a = 1 / (GAMMA * (2 - GAMMA))
            t = solve(dt * (1 - GAMMA) / (2 - GAMMA), c * (a * middle - (1 - GAMMA) ** 2 * a * t) + dt * (1 - GAMMA) / (2 - GAMMA) * source, middle)
    return t


def implicit_substeps(state: DataFrame, edges: DataFrame, dt: float, target_delta_k: float, most: int) -> int:
    """Parts of a step, at most `most`, in which no node is predicted to change by more than the target."""
    if most <= 1:
        return 1
    predicted = rates(state, edges).agg(F.max(F.abs("rate_k_s"))).first()[0] or 0.0
    return max(1, min(most, math.ceil(dt * predicted / max(target_delta_k, 1e-12))))


def implicit_steps(state: DataFrame, edges: DataFrame, dt: float, steps: int = 1, *, method: str = "tr_bdf2", target_delta_k: float = 1.0, most_substeps: int = 1) -> DataFrame:
    """node_id, temperature_k after the steps. Radiation is frozen at the present temperatures over the call.

    tr_bdf2 takes each step in up to most_substeps parts (see implicit_substeps). Every solve ends within RTOL of its right
    side, or raises.
    """
    if method not in ("tr_bdf2", "backward_euler"):
        raise ValueError(method)
    ship_package(state.sparkSession)
    edges = staged(edges.select("node_i", "node_j", "g_w_k"))
    parts = implicit_substeps(state, edges, dt, target_delta_k, most_substeps) if method == "tr_bdf2" else 1
    dt, steps = dt / parts, steps * parts
    labels = staged(components(state, edges))
    big = labels.groupBy("label").count().where(F.col("count") > TASK_NODES).select("label")
    source = F.col("power_w") + F.col("radiation_w_k4") * (F.pow("surroundings_k", F.lit(4)) - F.pow("temperature_k", F.lit(4)))
    nodes = state.join(labels, "node_id").select("label", "node_id", F.greatest("capacity_j_k", F.lit(1e-12)).alias("c"), F.col("temperature_k").alias("t"), source.alias("s"))
    links = edges.join(labels.withColumnRenamed("node_id", "node_i"), "node_i")

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        from caloris.operators.simulate import advance_block

        ids = left["node_id"].to_numpy()
        order = np.argsort(ids)
        c, t, s = (left[x].to_numpy()[order] for x in ("c", "t", "s"))
        i, j = (np.searchsorted(ids[order], right[x].to_numpy()) for x in ("node_i", "node_j"))
        out = advance_block(c, t, s, i, j, right["g_w_k"].to_numpy(), dt, steps, method) if len(ids) else t
        return pa.table({"node_id": ids[order], "temperature_k": out})

    small = nodes.join(big, "label", "left_anti").groupBy("label").cogroup(links.join(big, "label", "left_anti").groupBy("label"))
    out = small.applyInArrow(solve, "node_id long, temperature_k double")
    if big.isEmpty():
        return out
    return out.unionByName(_distributed(nodes.join(big, "label", "left_semi").drop("label"), links.join(big, "label", "left_semi").drop("label"), dt, steps, method))


def _distributed(nodes: DataFrame, edges: DataFrame, dt: float, steps: int, method: str = "backward_euler", rtol: float = RTOL, most: int = MOST_ROUNDS) -> DataFrame:
    """The steps of advance_block on tables: conjugate gradients whose sums alone reach the driver."""
    edges = staged(both_ways(edges, "g_w_k"))
    total = edges.groupBy("node").agg(F.sum("g_w_k").alias("loss")).withColumnRenamed("node", "node_id")
    base = staged(nodes.join(total, "node_id", "left").withColumn("loss", F.coalesce("loss", F.lit(0.0))).select("node_id", "c", "t", "s", "loss"))

    def pulled(v: DataFrame, name: str) -> DataFrame:
        """v with pull, the flow into each node at the temperatures `name`."""
        there = edges.join(v.select(F.col("node_id").alias("other"), F.col(name).alias("_x")), "other").groupBy("node").agg(F.sum(F.col("g_w_k") * F.col("_x")).alias("_n")).withColumnRenamed("node", "node_id")
        return v.join(there, "node_id", "left").withColumn("pull", F.coalesce("_n", F.lit(0.0)) - F.col("loss") * F.col(name)).drop("_n")

    def solve(v: DataFrame, h: float, right: Column, guess: str, out: str) -> DataFrame:
        """v with `out`, where (c - h pull) out = right."""
        kept = v.columns
        d = F.col("c") + h * F.col("loss")
        v = pulled(v.withColumn("b", right).withColumn("x", F.col(guess)), "x")
        v = staged(v.withColumn("r", F.col("b") - F.col("c") * F.col("x") + h * F.col("pull")).withColumn("p", F.col("r") / d).drop("pull"))
        sums = (F.sum(F.col("r") * F.col("r") / d), F.sqrt(F.sum(F.col("r") * F.col("r"))))
        size = v.agg(F.sqrt(F.sum(F.col("b") * F.col("b")))).first()[0]
        rz, rest = v.agg(*sums).first()
        goal = rtol * max(size or 0.0, 1e-300)
        for _ in range(most):
            if not rz or rest <= goal:
                break
            v = staged(pulled(v, "p").withColumn("q", F.col("c") * F.col("p") - h * F.col("pull")).drop("pull"))
            a = rz / v.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
            v = v.withColumn("x", F.col("x") + a * F.col("p")).withColumn("r", F.col("r") - a * F.col("q")).drop("q")
            new, rest = v.agg(*sums).first()
            v, rz = v.withColumn("p", F.col("r") / d + (new / rz) * F.col("p")), new
        if rz and not rest <= goal:
            raise RuntimeError(f"conjugate gradients did not converge in {most} rounds")
        return staged(v.select(*kept, F.col("x").alias(out)))

    for _ in range(steps):
        if method == "backward_euler":
            base = solve(base, dt, F.col("c") * F.col("t") + dt * F.col("s"), "t", "new")
        else:  # as in advance_block
            h, a, last = GAMMA * dt / 2, 1 / (GAMMA * (2 - GAMMA)), dt * (1 - GAMMA) / (2 - GAMMA)
            start = pulled(base, "t").withColumn("b0", F.col("c") * F.col("t") + h * (F.col("pull") + 2 * F.col("s"))).drop("pull")
            middle = solve(start, h, F.col("b0"), "t", "middle")
            base = solve(middle, last, F.col("c") * (a * F.col("middle") - (1 - GAMMA) ** 2 * a * F.col("t")) + last * F.col("s"), "middle", "new")
        base = base.select("node_id", "c", F.col("new").alias("t"), "s", "loss")
    return base.select("node_id", F.col("t").alias("temperature_k"))


def chebyshev(f: Callable[[np.ndarray], np.ndarray], z: float) -> np.ndarray:
    """Coefficients of f(z (1 + x)) over -1..1 down to rounding, for f = exp(-y) and what falls no faster."""
    n = 64 + 10 * math.ceil(math.sqrt(z))
    values = f(z * (1 + np.cos(np.pi * (np.arange(2 * n) + 0.5) / (2 * n))))
    turned = np.fft.fft(np.concatenate([values, values[::-1]]))[:n] * np.exp(-0.5j * np.pi * np.arange(n) / (2 * n))
    out = turned.real / (2 * n)
    out[0] /= 2
    return out[: max(np.flatnonzero(np.abs(out) > 1e-17 * np.abs(out).max())[-1] + 1, 2)]


def propagate_block(c: np.ndarray, t: np.ndarray, source: np.ndarray, i: np.ndarray, j: np.ndarray, g: np.ndarray, dt: float, steps: int, terms: int = 24) -> np.ndarray:
    """Exponential steps of one block (edges by position); source in watts is constant over the steps.

    With conductances of zero or more the rates lie between 0 and twice the largest loss, so Chebyshev series of exp(-y) and
    (1 - exp(-y)) / y do, whose terms grow with the root of the stiffness; else a scaled Taylor series.
    """
    n = len(c)

    def pull(x: np.ndarray) -> np.ndarray:
        flow = g * (x[j] - x[i])
        return (np.bincount(i, flow, n) - np.bincount(j, flow, n)) / c

    most = float(((np.bincount(i, np.abs(g), n) + np.bincount(j, np.abs(g), n)) / c).max(initial=0.0)) if n else 0.0
    add = source / c
    if most == 0:
        return t + steps * dt * add
    if (g >= 0).all():
        z = dt * most

        def series(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
            k = chebyshev(f, z)
            turn = lambda x: -pull(x) / most - x
            last, now = x, turn(x)
            out = k[0] * last + k[1] * now
            for a in k[2:]:
                last, now = now, 2 * turn(now) - last
                out += a * now
            return out

        gained = dt * series(lambda y: -np.expm1(-y) / y, add)
        for _ in range(steps):
            t = series(lambda y: np.exp(-y), t) + gained
        return t
    parts = max(1, math.ceil(2 * dt * most))
    h = dt / parts
    for _ in range(steps * parts):
        term = total = t
        for k in range(1, terms):
            term = (pull(term) + (add if k == 1 else 0)) * (h / k)
            total = total + term
        t = total
    return t


def exponential_steps(state: DataFrame, edges: DataFrame, dt: float, steps: int, terms: int = 24) -> DataFrame:
    """node_id, temperature_k by the exact propagator exp(A dt) applied through a series (see propagate_block), per component.

    Radiation is frozen at the present temperatures over the call. A component is one task's work."""
    ship_package(state.sparkSession)
    edges = staged(edges.select("node_i", "node_j", "g_w_k"))
    source = F.col("power_w") + F.col("radiation_w_k4") * (F.pow("surroundings_k", F.lit(4)) - F.pow("temperature_k", F.lit(4)))
    labels = staged(components(state, edges))
    nodes = state.join(labels, "node_id").select("label", "node_id", F.greatest("capacity_j_k", F.lit(1e-12)).alias("c"), F.col("temperature_k").alias("t"), source.alias("s"))
    links = edges.join(labels.withColumnRenamed("node_id", "node_i"), "node_i")

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        from caloris.operators.simulate import propagate_block

        ids = left["node_id"].to_numpy()
        order = np.argsort(ids)
        c, t, s = (left[x].to_numpy()[order] for x in ("c", "t", "s"))
        i, j = (np.searchsorted(ids[order], right[x].to_numpy()) for x in ("node_i", "node_j"))
        return pa.table({"node_id": ids[order], "temperature_k": propagate_block(c, t, s, i, j, right["g_w_k"].to_numpy(), dt, steps, terms)})

    return nodes.groupBy("label").cogroup(links.groupBy("label")).applyInArrow(solve, "node_id long, temperature_k double")


def two_bodies(t1: Column, t2: Column, c1: Column, c2: Column, g: Column, p1: Column, p2: Column, dt: Column) -> tuple[Column, Column]:
    """Temperatures of two bodies after dt of constant powers: the exact solution, a mean that drifts and a difference that dies out."""
    mean = (c1 * t1 + c2 * t2 + (p1 + p2) * dt) / (c1 + c2)
    k = g * (1.0 / c1 + 1.0 / c2)
    push = p1 / c1 - p2 / c2
    left = (t1 - t2) * F.exp(-k * dt) + F.when(k > 0, push * (1.0 - F.exp(-k * dt)) / k).otherwise(push * dt)
    return mean + c2 / (c1 + c2) * left, mean - c1 / (c1 + c2) * left


def trajectory_stats(trajectory: DataFrame) -> DataFrame:
    return trajectory.groupBy("step").agg(F.min("temperature_k").alias("min_k"), F.max("temperature_k").alias("max_k"), F.avg("temperature_k").alias("mean_k"))


def trajectory_error(run: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: max, mean and RMS error, relative Frobenius error, error of the last step, place of the largest."""
    both = run.join(reference.withColumnRenamed("temperature_k", "reference_k"), ["step", "node_id"]).withColumn("e", F.col("temperature_k") - F.col("reference_k"))
    last = both.agg(F.max("step")).first()[0]
    worst = F.max(F.struct(F.abs("e").alias("a"), (-F.col("step")).alias("s"), (-F.col("node_id")).alias("n")))
    out = both.agg(worst.alias("w"), F.avg(F.abs("e")).alias("mean_abs_k"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_k"), (F.sqrt(F.sum(F.col("e") * F.col("e"))) / F.sqrt(F.sum(F.col("reference_k") * F.col("reference_k")))).alias("relative"), F.max(F.when(F.col("step") == F.lit(last), F.abs("e"))).alias("final_abs_k"))
    return out.select(F.col("w.a").alias("max_abs_k"), (-F.col("w.s")).alias("worst_step"), (-F.col("w.n")).alias("worst_node"), "mean_abs_k", "rmse_k", "relative", "final_abs_k")


def max_change(trajectory: DataFrame) -> DataFrame:
    """step, max_delta_k: the largest change of any node since the step before."""
    before = trajectory.select((F.col("step") + 1).alias("step"), "node_id", F.col("temperature_k").alias("old"))
    return trajectory.join(before, ["step", "node_id"]).groupBy("step").agg(F.max(F.abs(F.col("temperature_k") - F.col("old"))).alias("max_delta_k"))
