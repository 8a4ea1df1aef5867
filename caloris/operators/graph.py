"""Graph operators over edges (node_i, node_j[, g_w_k]): Laplacian, degrees, components, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caloris.session import staged

VISUAL_TYPE, VISUAL_SOURCE = "role_node_contact", "cad_role_node_contact"


def conducting(edges: DataFrame) -> DataFrame:
    """Edges that enter the matrices: without visual role contacts and without conductance zero or less."""
    return edges.where(~((F.coalesce("edge_type", F.lit("")) == VISUAL_TYPE) | (F.coalesce("source", F.lit("")) == VISUAL_SOURCE)) & (F.col("g_w_k") > 0))


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """Each edge from either end: node, other, and the named columns."""
    ends = F.explode(F.array(F.struct(F.col("node_i").alias("node"), F.col("node_j").alias("other")), F.struct(F.col("node_j").alias("node"), F.col("node_i").alias("other"))))
    return edges.select(ends.alias("e"), *more).select("e.node", "e.other", *more)


def laplacian(edges: DataFrame) -> DataFrame:
    """COO rows (row, col, value): minus the summed conductance off the diagonal, a node's total on it."""
    both = both_ways(edges, "g_w_k")
    off = both.groupBy(F.col("node").alias("row"), F.col("other").alias("col")).agg((-F.sum("g_w_k")).alias("value"))
    diagonal = both.groupBy(F.col("node").alias("row")).agg(F.sum("g_w_k").alias("value")).select("row", F.col("row").alias("col"), "value")
    return off.unionByName(diagonal)


def dense_conductance(edges: DataFrame, order: str) -> DataFrame:
    """(node_i, node_j, g_w_k) with i < j: of edges of one pair the last in `order` counts."""
    pair = edges.select(F.least("node_i", "node_j").alias("node_i"), F.greatest("node_i", "node_j").alias("node_j"), "g_w_k", order)
    return pair.groupBy("node_i", "node_j").agg(F.max_by("g_w_k", order).alias("g_w_k"))


def edges_from_matrix(coo: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a conductance matrix's positive upper triangle whose nodes exist."""
    up = coo.where((F.col("row") < F.col("col")) & (F.col("value") > 0))
    ids = nodes.select("node_id").distinct()
    up = up.join(ids.withColumnRenamed("node_id", "row"), "row", "left_semi").join(ids.withColumnRenamed("node_id", "col"), "col", "left_semi")
    return up.select(F.col("row").alias("node_i"), F.col("col").alias("node_j"), F.col("value").alias("g_w_k"))


def asymmetry(coo: DataFrame) -> DataFrame:
    """One row: max_delta, the largest difference from the transpose, and symmetric (at most 1e-12)."""
    cells = coo.groupBy("row", "col").agg(F.sum("value").alias("v"))
    signed = cells.select("row", "col", "v").unionByName(cells.select(F.col("col").alias("row"), F.col("row").alias("col"), (-F.col("v")).alias("v")))
    worst = signed.groupBy("row", "col").agg(F.abs(F.sum("v")).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("max_delta"))
    return worst.withColumn("symmetric", F.col("max_delta") <= 1e-12)


def degrees(nodes: DataFrame, edges: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """node_id, degree (edges), neighbours (distinct), visible_neighbours (distinct and in `visible`)."""
    both = both_ways(edges)
    seen = both.join(visible.select(F.col("node_id").alias("other"), F.lit(1).alias("seen")), "other", "left") if visible is not None else both.withColumn("seen", F.lit(1))
    counted = seen.groupBy("node").agg(F.count("*").alias("degree"), F.count_distinct("other").alias("neighbours"), F.count_distinct(F.when(F.col("seen") == 1, F.col("other"))).alias("visible_neighbours"))
    zero = F.lit(0).cast("long")
    return nodes.select("node_id").join(counted.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", *[F.coalesce(c, zero).alias(c) for c in ("degree", "neighbours", "visible_neighbours")])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, label: the least node of each node's connected component.

    Large-star and small-star rounds contract the edges into stars; each round is a few joins on edges and at most halves
    the depth, so rounds grow with the logarithm of the graph. Rounds are checkpointed; nothing is collected.
    """
    stars = staged(edges.select(F.greatest("node_i", "node_j").alias("a"), F.least("node_i", "node_j").alias("b")).where("a <> b").distinct())
    state = None
    while (now := stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()) != state and now["n"]:
        state = now
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        stars = staged(small.where("a <> b").distinct())
    return nodes.select("node_id").join(stars.withColumnRenamed("a", "node_id"), "node_id", "left").select("node_id", F.coalesce("b", "node_id").alias("label"))


def numbered_components(labels: DataFrame) -> DataFrame:
    """node_id, component_id: 0 is the largest component, ties by least node."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    ranked = sizes.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).cast("long").alias("component_id"))
    return labels.join(ranked, "label").select("node_id", "component_id")


def component_summary(nodes: DataFrame, members: DataFrame, top: int = 10, sample: int = 50) -> DataFrame:
    """For each component: size, bounds of centres, roles, the most frequent part and material, first node ids."""
    rows = members.join(nodes, "node_id")
    base = rows.groupBy("component_id").agg(
        F.count("*").alias("node_count"), *[f(f"c{a}").alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"],
        F.count_if("is_heater").alias("heater_count"), F.count_if("is_sensor").alias("sensor_count"),
    )
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("component_id").orderBy("node_id"))).where(F.col("r") <= sample)
    ids = first.groupBy("component_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("node_id")), lambda x: x.cast("string")), ",").alias("node_ids_sample"))
    out = base.join(ids, "component_id")
    for column in ("component", "material"):
        counts = rows.groupBy("component_id", column).agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
        order = Window.partitionBy("component_id").orderBy(F.desc("n"), "first")
        ranked = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", column, "n"))), lambda x: F.concat(x[column], F.lit(":"), x["n"].cast("string"))), ",")
        out = out.join(ranked.groupBy("component_id").agg(text.alias(f"top_{column}s")), "component_id")
    return out


def recent(history: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key."""
    return history.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")
