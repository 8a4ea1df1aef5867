"""Reports over a graph's nodes: warning tags, oversized nodes, quality score, histograms, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Penalties of the quality score: tags, points for each, most points.
PENALTIES = ((("oversized_cell",), 2, 25), (("low_confidence",), 1, 20), (("isolated_node",), 2, 15), (("disconnected_component",), 2, 25), (("unpaired_heater", "unpaired_sensor"), 2, 15))


def warning_tags(max_size_mm: float) -> Column:
    """Ordered tags of a node from size_mm, confidence, warnings, degree, disconnected, and its role columns."""
    heater, sensor = F.col("is_heater"), F.col("is_sensor")
    tags = F.array(
        F.when(F.col("size_mm") > max_size_mm, "oversized_cell"),
        F.when(F.lower(F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.lit("high"))) != "high", "low_confidence"),
        F.when(F.size("warnings") > 0, "node_warning"),
        F.when(F.col("degree") <= 0, "isolated_node"),
        F.when(F.col("disconnected"), "disconnected_component"),
        F.when(heater & ~F.col("heater_valid"), "invalid_heater"),
        F.when(heater & F.col("assigned_sensor_id").isNull(), "unpaired_heater"),
        F.when(sensor & ~F.col("sensor_valid"), "invalid_sensor"),
        F.when(sensor & F.col("assigned_heater_id").isNull(), "unpaired_sensor"),
    )
    return F.array_distinct(F.array_compact(tags))


def oversized(nodes: DataFrame, limit_mm: float) -> DataFrame:
    """Nodes larger than the limit with the reason, the first that applies of their warnings and level."""
    text = F.array_join("warnings", " ")
    reason = (
        F.when(text.contains("Blocked by max_leaf_cells"), "blocked_by_max_leaf_cells_old_code")
        .when(text.contains("max_leaf_cells was exceeded to enforce max_cell_size_mm"), "max_leaf_cells_overridden")
        .when(text.contains("max_depth or min_cell_size_mm"), "blocked_by_max_depth_or_min_cell_size")
        .when(text.contains("marker-only graph node") | (F.col("level") < 0), "marker_node")
        .when(F.size("warnings") > 0, "node_warning")
        .otherwise("unknown")
    )
    return nodes.where((F.lit(limit_mm) > 0) & (F.col("size_mm") > limit_mm)).select("node_id", "component", "level", "size_mm", reason.alias("reason"))


def oversized_summary(big: DataFrame) -> DataFrame:
    """reason (null: all), nodes, marker_nodes, largest_mm."""
    marker = F.count_if((F.col("level") < 0) | (F.col("reason") == "marker_node"))
    return big.rollup("reason").agg(F.count("*").alias("nodes"), marker.alias("marker_nodes"), F.max("size_mm").alias("largest_mm"))


def largest(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The n largest nodes, ties in the order of their ids."""
    return nodes.orderBy(F.desc("size_mm"), "node_id").limit(n)


def quality(tagged: DataFrame, errors: int = 0, warnings: int = 0) -> DataFrame:
    """One row: score (100 less capped penalties), grade, and counts of each tag."""
    names = sorted({t for tags, _, _ in PENALTIES for t in tags} | {"node_warning", "invalid_heater", "invalid_sensor"})
    counts = tagged.agg(F.count("*").alias("nodes"), *[F.count_if(F.array_contains("tags", t)).alias(t) for t in names])
    score = F.lit(100 - min(40, errors * 20) - min(10, warnings))
    for tags, points, most in PENALTIES:
        score = score - F.least(F.lit(most), sum((F.col(t) for t in tags[1:]), F.col(tags[0])) * points)
    score = F.greatest(F.lit(0), score).cast("long")
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D")
    return counts.select("nodes", *names, score.alias("score"), grade.alias("grade"))


def require_nodes(nodes: DataFrame, leaves: DataFrame, max_leaves: int | None = None) -> None:
    """An error with advice if a build has no nodes."""
    if not nodes.isEmpty():
        return
    n = leaves.count()
    if not n:
        raise ValueError("the octree has no leaves; check that the scene's meshes have bounds")
    advice = f"none of the octree's {n} leaves is solid: no triangle meets a cell and no closed mesh holds one"
    raise ValueError(advice + (f"; the limit of {max_leaves} leaves holds back refinement" if max_leaves else ""))


def leaf_diagnostics(leaves: DataFrame) -> DataFrame:
    """One row: leaves in all, solid and empty ones, and the deepest level."""
    return leaves.agg(F.count("*").alias("leaves"), F.count("component").alias("solid"), F.count_if(F.col("component").isNull()).alias("empty"), F.max("level").alias("deepest"))


def refinement_histogram(leaves: DataFrame) -> DataFrame:
    """reason, cells: how often each reason to refine held."""
    return leaves.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("cells"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rule, subject: every breach of the graph's rules.

    Rules: duplicate_node, missing_component, missing_material, bad_capacity (zero or less), bad_temperature (not
    finite), dangling_edge, self_edge, negative_conductance, duplicate_edge (one pair twice).
    """
    rule = lambda df, name, subject: df.select(F.lit(name).alias("rule"), subject.cast("string").alias("subject"))
    node, pair = F.col("node_id"), F.concat_ws("-", F.least("node_i", "node_j"), F.greatest("node_i", "node_j"))
    ids = nodes.select("node_id").distinct()
    ends = edges.select(pair.alias("pair"), F.explode(F.array("node_i", "node_j")).alias("node_id"))
    parts = [
        rule(nodes.groupBy("node_id").count().where("count > 1"), "duplicate_node", node),
        rule(nodes.where("coalesce(component, '') = ''"), "missing_component", node),
        rule(nodes.where("coalesce(material, '') = ''"), "missing_material", node),
        rule(nodes.where("NOT coalesce(capacity_j_k > 0, false)"), "bad_capacity", node),
        rule(nodes.where("temperature_k IS NULL OR isnan(temperature_k) OR abs(temperature_k) = double('infinity')"), "bad_temperature", node),
        rule(ends.join(ids, "node_id", "left_anti").select("pair").distinct(), "dangling_edge", F.col("pair")),
        rule(edges.where("node_i = node_j"), "self_edge", pair),
        rule(edges.where("g_w_k < 0"), "negative_conductance", pair),
        rule(edges.groupBy(pair.alias("pair")).count().where("count > 1"), "duplicate_edge", F.col("pair")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_text(found: DataFrame) -> DataFrame:
    """One line for each rule, in order: 'rule: count'."""
    lines = found.groupBy("rule").agg(F.count("*").alias("n"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "n"))), lambda x: F.concat(x["rule"], F.lit(": "), x["n"].cast("string"))), "\n").alias("report"))
