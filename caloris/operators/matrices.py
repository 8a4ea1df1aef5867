"""Matrices of a graph as tables: checks of vectors, conductance and Laplacian, the loaded mode, and repair of empty graphs.

vectors: node_id, i, j, k, capacity_j_k, g_rad_w_k (a row a node); G and L as rows (row, col, value) of node ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caloris.functions.physics import cubic_conductance
from caloris.operators import contacts
from caloris.operators.graph import VISUAL_SOURCE, VISUAL_TYPE, conducting

#: Absolute and relative difference that counts as equal.
ATOL, RTOL = 1e-12, 1e-7


def _rule(df: DataFrame, name: str, subject: Column) -> DataFrame:
    return df.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cell() -> Column:
    return F.concat_ws("-", "row", "col")


def asymmetric(coo: DataFrame) -> DataFrame:
    """row, col (row < col) of the cells that differ from their mirror by more than ATOL and RTOL of it."""
    cells = coo.groupBy("row", "col").agg(F.sum("value").alias("v")).where("row <> col")
    side = F.when(F.col("row") < F.col("col"), F.col("v"))
    both = cells.groupBy(F.least("row", "col").alias("lo"), F.greatest("row", "col").alias("hi")).agg(F.coalesce(F.sum(side), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(side.isNull(), F.col("v"))), F.lit(0.0)).alias("b"))
    return both.where(F.abs(F.col("a") - F.col("b")) > ATOL + RTOL * F.greatest(F.abs("a"), F.abs("b"))).select(F.col("lo").alias("row"), F.col("hi").alias("col"))


def _ids(found: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    ids = nodes.select("node_id").distinct()
    return [
        _rule(ids.join(found.select("node_id").distinct(), "node_id", "left_anti"), "missing_id", F.col("node_id")),
        _rule(found.select("node_id").distinct().join(ids, "node_id", "left_anti"), "unknown_id", F.col("node_id")),
        _rule(found.groupBy("node_id").count().where("count > 1"), "repeated_id", F.col("node_id")),
    ]


def _outside(coo: DataFrame, found: DataFrame, name: str) -> DataFrame:
    ids = found.select("node_id").distinct()
    ends = coo.select("row", "col", F.explode(F.array("row", "col")).alias("node_id"))
    return _rule(ends.join(ids, "node_id", "left_anti").select("row", "col").distinct(), name, _cell())


def check_matrices(vectors: DataFrame, g: DataFrame | None, laplacian: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """rule, subject: every breach of the rules for a graph's matrices.

    Rules: missing_id, unknown_id, repeated_id, bad_coordinate, negative_capacity, negative_radiation; for G and L where they
    are given: g_outside and l_outside (cells of other ids), g_asymmetric, l_asymmetric, negative_conductance, l_not_finite;
    missing_matrix where neither is given.
    """
    node, value = F.col("node_id"), F.col("value")
    parts = _ids(vectors, nodes)
    parts += [
        _rule(vectors.where("i IS NULL OR j IS NULL OR k IS NULL"), "bad_coordinate", node),
        _rule(vectors.where("capacity_j_k < -1e-12"), "negative_capacity", node),
        _rule(vectors.where("g_rad_w_k < -1e-12"), "negative_radiation", node),
    ]
    if g is not None:
        parts += [_outside(g, vectors, "g_outside"), _rule(asymmetric(g), "g_asymmetric", _cell()), _rule(g.where("value < -1e-12"), "negative_conductance", _cell())]
    if laplacian is not None:
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
        parts += [_outside(laplacian, vectors, "l_outside"), _rule(laplacian.where(bad), "l_not_finite", _cell()), _rule(asymmetric(laplacian.where(~bad)), "l_asymmetric", _cell())]
    if g is None and laplacian is None:
        parts.append(_rule(nodes.limit(1), "missing_matrix", F.lit("G, L")))
    return _union(parts)


def check_conductance(ids: DataFrame, g: DataFrame, nodes: DataFrame) -> DataFrame:
    """rule, subject: breaches of what the loaded mode asks for: the graph's ids, and a symmetric G without negative cells."""
    return _union([*_ids(ids, nodes), _outside(g, ids, "g_outside"), _rule(asymmetric(g), "g_asymmetric", _cell()), _rule(g.where("value < -1e-12"), "negative_conductance", _cell())])


def raise_if_any(found: DataFrame, heading: str) -> None:
    """An error that names up to 20 breaches, if there are any."""
    rows = found.orderBy("rule", "subject").limit(20).collect()
    if rows:
        raise ValueError(heading + ": " + "; ".join(f"{r['rule']} {r['subject']}" for r in rows))


def has_conduction(coo: DataFrame) -> bool:
    return not coo.where("abs(value) > 1e-15").isEmpty()


def auto_edges(nodes: DataFrame) -> DataFrame:
    """Edges between grid neighbours with the conductance of two half cubes; nodes: node_id, i, j, k, side_m, k_w_mk."""
    e = contacts.grid_edges(nodes)
    p = nodes.select("node_id", "side_m", "k_w_mk")
    rows = e.join(p.toDF("node_i", "a", "ka"), "node_i").join(p.toDF("node_j", "b", "kb"), "node_j")
    rows = rows.select("node_i", "node_j", cubic_conductance(F.col("ka"), F.col("kb"), F.col("a"), F.col("b")).alias("g_w_k"))
    return rows.where("g_w_k > 0").withColumns({"edge_type": F.lit("grid"), "source": F.lit("auto")})


def repair(nodes: DataFrame, edges: DataFrame, mode: str, matrix: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The edges to go on with, and warnings: in auto mode, where no edge and no matrix conducts, edges anew from the grid; edges
    that only show what roles touch are kept."""
    if mode != "auto" or not conducting(edges).isEmpty() or (matrix is not None and has_conduction(matrix)):
        return edges, []
    shown = edges.where((F.col("edge_type") == VISUAL_TYPE) | (F.col("source") == VISUAL_SOURCE))
    made = auto_edges(nodes).select(*edges.columns)
    if made.isEmpty():
        return edges, []
    return shown.unionByName(made), ["no edge conducted; edges were made anew from the grid"]


def after_topology_change(nodes: DataFrame, edges: DataFrame, mode: str) -> tuple[str, DataFrame, list[str]]:
    """Mode, edges and warnings after nodes were added or removed: a loaded matrix no longer fits, so edges come from the grid."""
    warnings = ["the loaded matrix does not fit the changed graph; edges come from the grid"] if mode == "loaded_G" else []
    shown = edges.where((F.col("edge_type") == VISUAL_TYPE) | (F.col("source") == VISUAL_SOURCE))
    return "auto", auto_edges(nodes).select(*edges.columns).unionByName(shown), warnings
