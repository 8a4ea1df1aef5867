"""From cells to a thermal graph in one go: properties, exact and near contacts, radiation, role contacts, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from caloris.functions import physics as P
from caloris.operators import contacts, materials, reports, roles
from caloris.session import staged


@dataclass
class Built:
    nodes: DataFrame
    edges: DataFrame
    violations: DataFrame


def contact_edges(cells: DataFrame, gap_mm: float) -> DataFrame:
    """Typed edges of touching cells, and of those within the gap that do not touch, from one pass over the pairs of cells."""
    pairs = staged(contacts.candidate_pairs(cells, gap_mm))
    exact = staged(contacts.typed_edges(contacts.shared_faces(pairs)))
    if gap_mm <= 0:
        return exact
    near = contacts.typed_edges(contacts.near_faces(pairs, gap_mm), near=True)
    return exact.unionByName(contacts.without_pairs(near, exact))


def thermal_graph(cells: DataFrame, library: DataFrame, *, gap_mm: float = 0.0, default: str = materials.DEFAULT_NAME, role_boxes: DataFrame | None = None, tolerance_mm: float = 1e-6, reference_k: float = 293.15) -> Built:
    """Nodes and edges of solid cells (node_id, centre, size, component, material), with the breaches of the graph's rules.

    Nodes carry capacity and the radiative conductance of what no neighbour covers. Roles (role_id, kind and box) become edges
    that only show what they touch, to nodes numbered after the cells.
    """
    cells = cells.where("coalesce(component, '') <> ''")
    reports.require_nodes(cells, cells)
    rows = staged(materials.resolve(cells, library, default=default).withColumn("k", F.col("k_w_mk")))
    solid = rows.select("node_id", *[f"{v}{a}" for v in "cs" for a in contacts.AXES], "component", F.col("resolved_material").alias("material"), "k")
    edges = staged(contact_edges(solid, gap_mm))
    touching = edges.where("source = 'geometry'").select(F.col("node_i").alias("a_node_id"), F.col("node_j").alias("b_node_id"), (F.col("shared_area_m2") * 1e6).alias("area_mm2"))
    volume = F.col("sx") * F.col("sy") * F.col("sz") * 1e-9
    nodes = rows.join(contacts.exposed_area(rows, touching), "node_id").withColumns(
        {"mass_kg": F.col("density_kg_m3") * volume, "capacity_j_k": F.col("density_kg_m3") * volume * F.col("cp_j_kgk"), "g_rad_w_k": P.radiation_linear(F.col("emissivity"), F.col("exposed_mm2") * 1e-6, reference_k), "temperature_k": F.lit(reference_k)}
    )
    nodes = staged(nodes.select("node_id", "component", F.col("resolved_material").alias("material"), "mass_kg", "capacity_j_k", "g_rad_w_k", "exposed_mm2", "temperature_k"))
    if role_boxes is not None:
        marks = staged(roles.append_role_nodes(nodes, role_boxes))
        shown = roles.role_contact_edges(role_boxes, solid, edges.limit(0), tolerance_mm).join(marks.select(F.col("role_id").alias("node_i"), F.col("node_id").alias("mark")), "node_i").withColumn("node_i", F.col("mark"))
        edges = edges.unionByName(shown.select(*[c for c in edges.columns]))
    found = reports.violations(nodes, edges.where("edge_type <> 'role_node_contact'"))
    return Built(nodes, edges, found)
