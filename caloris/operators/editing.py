"""Editing a graph: matching and assigning roles, filters, updates, mutations, and what an editor shows of a node.

Tables are never changed; every function gives the table after the change.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from caloris.functions.text import match_key
from caloris.operators.graph import both_ways

#: Colours of connected components beyond the largest, of the largest, and of nodes outside any.
COMPONENT_COLOURS = ("#3b82f6", "#ef4444", "#22c55e", "#f97316", "#a855f7", "#06b6d4", "#eab308", "#ec4899", "#14b8a6", "#8b5cf6", "#84cc16", "#f43f5e")
LARGEST_COLOUR, NO_COMPONENT_COLOUR = "#64748b", "#94a3b8"


def search_text(name: Column, scene_path: Column, hierarchy: Column) -> Column:
    """Name, scene path and hierarchy of a component as one text to look for substrings in."""
    parts = F.filter(F.concat(F.array(name, scene_path), F.coalesce(hierarchy, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    return match_key(F.array_join(parts, " "))


def ignore_components(components: DataFrame, substrings: Sequence[str]) -> DataFrame:
    """components (name, scene_path, hierarchy) whose text holds none of the substrings, whatever case, dashes and blanks.

    Blank substrings do not count. It fails if nothing would be left.
    """
    wanted = [s.replace("\\", "/").replace("-", "_").replace(" ", "_").lower() for s in substrings if s.strip()]
    if not wanted:
        return components
    text = search_text(F.col("name"), F.col("scene_path"), F.col("hierarchy"))
    hit = F.lit(False)
    for s in wanted:
        hit = hit | text.contains(s)
    kept = components.where(~hit)
    if kept.isEmpty() and not components.isEmpty():
        raise ValueError("all components would be ignored; use narrower substrings")
    return kept


def role_texts() -> Column:
    """The texts of a node in which a role's substring is looked for."""
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("source_components", "role_source_components")]
    return F.filter(F.concat(F.array(F.col("node_id").cast("string"), "cell_id", "component", "node_type"), *lists), lambda x: x.isNotNull() & (F.trim(x) != ""))


def matches_role(substring: str) -> Column:
    """Whether any of a node's texts holds the substring, whatever case, dashes and blanks."""
    wanted = substring.replace("\\", "/").replace("-", "_").replace(" ", "_").lower()
    if not wanted:
        raise ValueError("the substring is empty")
    return F.exists(role_texts(), lambda x: match_key(x).contains(wanted))


def assign_role(nodes: DataFrame, where: Column, role: str) -> DataFrame:
    """nodes of which those that meet `where` have become heaters or sensors, with what the other role had reset."""
    if role not in ("heater", "sensor"):
        raise ValueError(role)
    none = F.lit(None).cast("long")
    new = {"is_heater": F.lit(role == "heater"), "is_sensor": F.lit(role == "sensor"), "assigned_heater_id": none, "sensor_monitor_only": F.lit(role == "sensor")}
    new |= {"sensor_valid": F.lit(True)} if role == "heater" else {"assigned_sensor_id": none, "sensor_control_mode": F.lit("manual")}
    hit = F.coalesce(where, F.lit(False))
    return nodes.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def is_role_node() -> Column:
    """Whether a node stands for a heater or sensor of the drawing."""
    return F.col("node_type").isin("heater", "sensor") & (F.size(F.coalesce("source_components", F.array().cast("array<string>"))) > 0)


def editor_filter(*, heaters: bool = False, sensors: bool = False, levels: tuple[int, int] | None = None, component: str | None = None, material: str | None = None) -> Column:
    """An editor's filter: heaters or sensors where either is asked for, a range of levels that role nodes pass, names."""
    out = F.lit(True)
    if heaters or sensors:
        out = (F.col("is_heater") & F.lit(heaters)) | (F.col("is_sensor") & F.lit(sensors))
    if levels:
        out = out & (is_role_node() | F.col("level").between(*levels))
    for column, wanted in (("component", component), ("material", material)):
        if wanted is not None:
            out = out & (F.col(column) == wanted)
    return out


def search(nodes: DataFrame, wanted: str) -> DataFrame:
    """The node that a text asks for: the one at a coordinate 'i, j, k', else the one with that id, else the first by id in
    one of whose texts it occurs. nodes have i, j, k and what role_texts needs."""
    numbers = re.findall(r"-?\d+", wanted) if re.fullmatch(r"\s*\(?\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*\)?\s*", wanted) else []
    level = F.lit(None).cast("int")
    if wanted.strip():
        level = F.when(matches_role(wanted.strip()), 2)
    if re.fullmatch(r"\s*-?\d{1,18}\s*", wanted):
        level = F.when(F.col("node_id") == int(wanted), 1).otherwise(level)
    if numbers:
        level = F.when((F.col("i") == int(numbers[0])) & (F.col("j") == int(numbers[1])) & (F.col("k") == int(numbers[2])), 0).otherwise(level)
    return nodes.withColumn("found_by", level).where("found_by IS NOT NULL").orderBy("found_by", "node_id").limit(1).select("node_id", "found_by")


def sound_vector(c: Column, positive: bool = False) -> Column:
    """An array of three finite (and positive) numbers, null if it is anything else."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x > 0 if positive else F.lit(True))
    return F.when((F.size(c) == 3) & F.forall(c, fine), c)


def warm_component(nodes: DataFrame, component: str, temperature_k: float) -> DataFrame:
    """nodes with the initial temperature of one component set."""
    return nodes.withColumn("temperature_k", F.when(F.col("component") == component, F.lit(float(temperature_k))).otherwise(F.col("temperature_k")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """name of every parameter (name, value as text) that differs between the two tables, also where one lacks it."""
    b, a = before.select("name", F.struct("value").alias("b")), after.select("name", F.struct("value").alias("a"))
    return b.join(a, "name", "full").where(~F.col("b").eqNullSafe(F.col("a"))).select("name")


def template_update(nodes: DataFrame, chosen: DataFrame, template: Mapping[str, object]) -> DataFrame:
    """nodes of which the chosen ones (node_id) have taken a template's role and settings; fields of a role that the
    template does not have are reset to null, and ids of their own stay."""
    picked = nodes.join(chosen.select("node_id", F.lit(True).alias("picked")), "node_id", "left")
    off = [] if template.get("is_heater") else [c for c in nodes.columns if c.startswith("heater_")]
    off += [] if template.get("is_sensor") else [c for c in nodes.columns if c.startswith("sensor_") and c != "sensor_control_mode"]
    new = {k: F.lit(v) for k, v in template.items() if k != "node_id"} | {c: F.lit(None).cast(dict(nodes.dtypes)[c]) for c in off}
    return picked.withColumns({c: F.when(F.col("picked"), v).otherwise(F.col(c)) for c, v in new.items() if c in nodes.columns}).select(*nodes.columns)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes with rows added, or replaced where the id is known."""
    return nodes.join(new.select("node_id"), "node_id", "left_anti").unionByName(new.select(*nodes.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gains: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the nodes and without edges and gains that hang on them."""
    ids = gone.select("node_id").distinct()
    for c in ("node_i", "node_j"):
        edges = edges.join(ids.withColumnRenamed("node_id", c), c, "left_anti")
    for c in ("sensor_id", "heater_id"):
        gains = gains.join(ids.withColumnRenamed("node_id", c), c, "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), edges, gains


def set_edges(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """edges (node_i, node_j, g_w_k) with pairs set: ends in order, later wins, none to itself or to a missing node."""
    pair = new.where("node_i <> node_j").select(F.least("node_i", "node_j").alias("node_i"), F.greatest("node_i", "node_j").alias("node_j"), "g_w_k", "ordinal")
    pair = pair.groupBy("node_i", "node_j").agg(F.max_by("g_w_k", "ordinal").alias("g_w_k"))
    for c in ("node_i", "node_j"):
        pair = pair.join(nodes.select(F.col("node_id").alias(c)).distinct(), c, "left_semi")
    pair = pair.select("node_i", "node_j", "g_w_k")
    return edges.select("node_i", "node_j", "g_w_k").join(pair, ["node_i", "node_j"], "left_anti").unionByName(pair)


def component_colour(component_id: Column) -> Column:
    """Grey for the largest component and for none, else a colour of the palette in turn."""
    palette = F.array(*[F.lit(c) for c in COMPONENT_COLOURS])
    turn = F.element_at(palette, (F.pmod(component_id - 1, F.lit(len(COMPONENT_COLOURS))) + 1).cast("int"))
    return F.when(component_id.isNull(), NO_COMPONENT_COLOUR).when(component_id == 0, LARGEST_COLOUR).otherwise(turn)


def role_warnings() -> Column:
    """Why a heater or sensor is not sound, in order."""
    lost = F.when(~F.coalesce("heater_valid", F.lit(True)) | ~F.coalesce("heater_attached", F.lit(True)), F.coalesce(F.nullif(F.trim("heater_warning"), F.lit("")), F.lit("heater has no connected body deposition nodes")))
    bare = ~F.coalesce("sensor_valid", F.lit(True)) | (F.size(F.coalesce("readout_node_ids", F.array().cast("array<bigint>"))) == 0)
    return F.array_compact(
        F.array(
            F.when(F.col("is_heater"), lost),
            F.when(F.col("is_heater") & F.col("assigned_sensor_id").isNull(), "heater has no assigned sensor"),
            F.when(F.col("is_sensor") & bare, "sensor has no connected body readout nodes"),
        )
    )


def role_text() -> Column:
    return F.when(F.col("is_heater") & F.col("is_sensor"), "heater + sensor").when(F.col("is_heater"), "heater").when(F.col("is_sensor"), "sensor").otherwise("body")


def node_details(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """node_id, incident_edges, role, component_id, component_nodes, colour and role warnings of every node."""
    degree = both_ways(edges).groupBy("node").agg(F.count("*").alias("incident_edges")).withColumnRenamed("node", "node_id")
    sizes = members.groupBy("component_id").agg(F.count("*").alias("component_nodes"))
    rows = nodes.join(degree, "node_id", "left").join(members, "node_id", "left").join(sizes, "component_id", "left")
    return rows.select("node_id", F.coalesce("incident_edges", F.lit(0).cast("long")).alias("incident_edges"), role_text().alias("role"), "component_id", "component_nodes", component_colour(F.col("component_id")).alias("colour"), role_warnings().alias("warnings"))


def temperature_limits(temperatures: DataFrame) -> DataFrame:
    """low_k, high_k of the finite temperatures; a range of nothing is one degree wide."""
    t = F.col("temperature_k")
    out = temperatures.where(t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))).agg(F.min(t).alias("low_k"), F.max(t).alias("high_k"))
    return out.withColumn("high_k", F.when(F.col("high_k") <= F.col("low_k"), F.col("low_k") + 1.0).otherwise(F.col("high_k")))
