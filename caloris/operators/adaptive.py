"""Adaptive octrees: cells are classified by what they hold, refined for reasons, within a budget of leaves, and balanced.

Tables: triangles (component, tri: nine doubles), components (component, ordinal: its place in the scene, material, k_w_mk,
rho_cp). A cell's id is its parent's and a digit from 0 to 7.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caloris.functions import physics as P
from caloris.operators import octree
from caloris.operators.contacts import AXES, coarse_neighbours
from caloris.operators.roles import triangle_hits
from caloris.session import staged


@dataclass(frozen=True)
class Params:
    min_size_mm: float = 5.0
    max_size_mm: float = 50.0
    max_depth: int = 8
    accept: float = 0.95
    minority: float = 0.02
    contrast: float = 5.0
    near_mm: float = 10.0
    boundary: bool = True
    max_leaves: int | None = None
    samples: int = 9
    min_solid: float = 0.12
    crowded: int = 0
    crowded_mm: float = 0.0
    crowded_cells: float = 1.0
    multi_surface: int = 2
    complexity: int = 64
    role_components: tuple[str, ...] = ()
    role_mm: float = 0.0
    role_depth: int | None = None
    by_priority: bool = True
    balance_ratio: float = 4.0
    balance_passes: int = 2


class Scene:
    """Triangles and components, with what every classification needs of them."""

    def __init__(self, triangles: DataFrame, components: DataFrame) -> None:
        from caloris.sources.glb import component_bounds

        self.triangles, self.components = staged(triangles), staged(components)
        self.solids = staged(self.triangles.join(octree.closed(self.triangles), "component", "left_semi").select("component", "tri"))
        self.solid_bounds = staged(component_bounds(self.solids).drop("triangles"))
        self.bounds = staged(component_bounds(self.triangles).drop("triangles"))


def _size() -> Column:
    return F.greatest(*[F.col(f"s{a}") for a in AXES])


def _near_tests(cells: DataFrame, triangles: DataFrame, p: Params) -> DataFrame:
    """cell_id, component, near (triangles whose bounds meet the cell grown by the margin), tests, surface (one meets the cell).

    Cells of a level share a size, so each level is an equi-join of its grid with the grid cells that triangles cover.
    """
    out = None
    for level in cells.groupBy("level").agg(F.max(_size()).alias("size")).collect():  # one row a level
        size = float(level["size"])
        margin = max(0.0, min(p.near_mm, size * 0.5))
        keyed, rows = cells.where(F.col("level") == level["level"]), triangles
        inside = F.lit(True)
        for n, a in enumerate(AXES):
            low, high = (f(*[F.col("tri")[3 * v + n] for v in range(3)]) for f in (F.least, F.greatest))
            keyed = keyed.withColumn(f"k{a}", F.floor(F.col(f"c{a}") / size).cast("long"))
            rows = rows.withColumns({f"l{a}": low, f"h{a}": high}).withColumn(f"k{a}", F.explode(F.sequence(F.floor((F.col(f"l{a}") - margin - 1e-9) / size - 0.5).cast("long"), F.floor((F.col(f"h{a}") + margin + 1e-9) / size + 0.5).cast("long"))))
            inside = inside & (F.col(f"l{a}") <= F.col(f"c{a}") + size / 2 + F.lit(0.0)) & (F.col(f"h{a}") >= F.col(f"c{a}") - size / 2)
        met = octree.met(keyed, rows)
        for a in AXES:
            met = met.where((F.col(f"l{a}") <= F.col(f"c{a}") + size / 2 + margin) & (F.col(f"h{a}") >= F.col(f"c{a}") - size / 2 - margin))
        met = met.select("cell_id", "component", "tri", *[f"{v}{a}" for v in "cs" for a in AXES], inside.alias("inside"))
        counts = met.groupBy("cell_id", "component").agg(F.count("*").alias("near"), (F.count("*") + F.count_if("inside")).alias("tests"))
        hit = triangle_hits(met.where("inside")).select("cell_id", "component").distinct().withColumn("surface", F.lit(True))
        part = counts.join(hit, ["cell_id", "component"], "left").select("cell_id", "component", "near", "tests", F.coalesce("surface", F.lit(False)).alias("surface"))
        out = part if out is None else out.unionByName(part)
    return out


def _boxed(cells: DataFrame, bounds: DataFrame, margin: Column) -> DataFrame:
    """cell_id, component of the components whose bounds meet the cell grown by the margin. Components are a scene's parts."""
    meets = F.lit(True)
    for a in AXES:
        meets = meets & (F.col(f"low_{a}") <= F.col(f"c{a}") + F.col(f"s{a}") / 2 + margin) & (F.col(f"high_{a}") >= F.col(f"c{a}") - F.col(f"s{a}") / 2 - margin)
    return cells.join(F.broadcast(bounds) if bounds.count() <= 10_000 else bounds, meets).select("cell_id", "component")


def _held(cells: DataFrame, scene: Scene, p: Params) -> DataFrame:
    """cell_id, component, hits: sample points of each cell by the first closed mesh of the scene that contains them."""
    offsets = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(float(o)).alias(a) for a, o in zip(AXES, q, strict=True)]) for n, q in enumerate(octree.sample_points(p.samples))])
    points = cells.select("cell_id", *[f"{v}{a}" for v in "cs" for a in AXES], F.explode(offsets).alias("o"))
    points = points.select(F.struct("cell_id", "o.n").alias("point_id"), *[(F.col(f"c{a}") + F.col(f"o.{a}") * F.col(f"s{a}") / 2).alias(a) for a in AXES])
    found = octree.inside(points, scene.solids, scene.solid_bounds).join(scene.components.select("component", "ordinal"), "component")
    first = found.groupBy("point_id").agg(F.min_by("component", "ordinal").alias("component"))
    return first.groupBy(F.col("point_id.cell_id").alias("cell_id"), "component").agg(F.count("*").alias("hits"))


def _shares(hits: DataFrame, key: str, total: int) -> DataFrame:
    """cell_id, key, fraction: hits over the samples, at most 1, and scaled down where a cell's sum is above 1."""
    return octree.occupancy(hits.groupBy("cell_id", key).agg(F.least(F.sum("hits"), F.lit(total)).alias("hits")).withColumnRenamed(key, "component"), total).withColumnRenamed("component", key)


def classify(cells: DataFrame, scene: Scene, p: Params) -> DataFrame:
    """cells with what they hold: component (of the largest share, ties in order of the scene), fraction, parts and materials
    above the minority, contrast, the kinds of hits, counts of near and crowded components and of triangle tests, and
    occupancy as a map."""
    near = staged(_near_tests(cells, scene.triangles, p))
    held = _held(cells, scene, p)
    surface = near.where("surface").select("cell_id", "component", F.lit(max(1, math.ceil(p.samples * p.min_solid))).cast("long").alias("hits"))
    hits = staged(surface.unionByName(held).join(scene.components, "component"))
    parts = _shares(hits, "component", p.samples).join(scene.components.select("component", "ordinal"), "component")
    best = parts.groupBy("cell_id").agg(
        F.max(F.struct("fraction", (-F.col("ordinal")).alias("o"), "component")).alias("b"), F.count_if(F.col("fraction") > p.minority).alias("parts"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "fraction")))).alias("occupancy"),
    )
    mats = _shares(hits, "material", p.samples).where(F.col("fraction") > p.minority).join(scene.components.groupBy("material").agg(F.first("k_w_mk").alias("k"), F.first("rho_cp").alias("r")), "material")
    ratio = lambda c: F.when(F.count_if(F.col(c) > 0) >= 2, F.max(F.when(F.col(c) > 0, F.col(c))) / F.min(F.when(F.col(c) > 0, F.col(c))))
    mixed = mats.groupBy("cell_id").agg(F.count("*").alias("materials"), F.coalesce((ratio("k") >= p.contrast) | (ratio("r") >= p.contrast), F.lit(False)).alias("contrast"))
    seen = near.groupBy("cell_id").agg(F.count("*").alias("near_count"), F.sum("tests").alias("tests"), F.bool_or("surface").alias("surface_hit"), F.bool_or(~F.col("surface")).alias("near_hit"))
    inside = held.select("cell_id").distinct().withColumn("inside_hit", F.lit(True))
    margin = F.greatest(F.lit(0.0), F.least(F.lit(p.near_mm), _size() * 0.5))
    boxed = _boxed(cells, scene.bounds, margin).select("cell_id").distinct().withColumn("candidate", F.lit(True))
    rows = cells.join(best, "cell_id", "left").join(mixed, "cell_id", "left").join(seen, "cell_id", "left").join(inside, "cell_id", "left").join(boxed, "cell_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    for name, on, names, reach in (("crowded_count", p.crowded > 0, None, F.lit(p.crowded_mm) if p.crowded_mm > 0 else p.crowded_cells * _size()), ("role_count", bool(p.role_components), p.role_components, F.lit(max(0.0, p.role_mm)))):
        if on:
            bounds = scene.bounds if names is None else scene.bounds.where(F.col("component").isin(*names))
            rows = rows.join(_boxed(cells, bounds, reach).groupBy("cell_id").agg(F.count("*").alias(name)), "cell_id", "left")
        else:
            rows = rows.withColumn(name, F.lit(0))
    flag = {c: F.coalesce(c, F.lit(False)) for c in ("surface_hit", "inside_hit", "near_hit", "candidate", "contrast")}
    rows = rows.withColumns(flag | {c: count(c) for c in ("parts", "materials", "near_count", "tests", "crowded_count", "role_count")})
    rows = rows.withColumns({"component": F.col("b.component"), "fraction": F.col("b.fraction"), "occupied": F.col("surface_hit") | F.col("inside_hit")}).drop("b")
    return rows.withColumn("bbox_only", F.col("candidate") & ~F.col("occupied") & ~F.col("near_hit"))


def reasons(p: Params) -> dict[str, Column]:
    """Why a classified cell should be refined."""
    low_fill = F.coalesce("fraction", F.lit(0.0)) <= max(p.min_solid, p.minority)
    gap = F.lit(p.boundary) & (F.col("near_count") >= 2) & (F.col("surface_hit") | F.col("near_hit") | F.col("bbox_only")) & (~F.col("inside_hit") | low_fill)
    return {
        "role_region": (F.col("role_count") > 0) & (F.lit(True) if p.role_depth is None else F.col("level") < p.role_depth),
        "gap_preservation": gap,
        "multi_surface_ambiguity": F.lit(p.multi_surface > 0) & (F.col("near_count") >= p.multi_surface),
        "surface_complexity": F.lit(p.complexity > 0) & (F.col("tests") >= p.complexity),
        "crowded_component_bounds": F.lit(p.crowded > 0) & (F.col("crowded_count") >= p.crowded),
        "mixed_parts": F.col("parts") > 1,
        "mixed_materials": F.col("materials") > 1,
        "material_contrast": F.col("contrast"),
        "surface_or_near_surface": F.lit(p.boundary) & (F.col("surface_hit") | F.col("near_hit")),
    }


def decide(cells: DataFrame, p: Params) -> DataFrame:
    """Classified cells with score, must (too large for what it holds) and may (refined if the budget allows)."""
    why = reasons(p)
    size = _size()
    score = P.refinement_score(
        role=why["role_region"], gap=why["gap_preservation"], multi=why["multi_surface_ambiguity"], complex_=why["surface_complexity"], crowded=why["crowded_component_bounds"], parts=why["mixed_parts"], materials=why["mixed_materials"],
        contrast=why["material_contrast"], surface_needed=why["surface_or_near_surface"], occupied=F.col("occupied"), bbox_only=F.col("bbox_only"), inside=F.col("inside_hit"), surface=F.col("surface_hit"), near_count=F.col("near_count"),
        crowded_count=F.col("crowded_count"), tests=F.col("tests"), size_mm=size, max_size_mm=p.max_size_mm,
    )
    wanted = F.col("occupied") & (F.col("fraction") > 0) & (F.col("fraction") < p.accept)
    for c in why.values():
        wanted = wanted | c
    can = (F.col("level") < p.max_depth) & (size > p.min_size_mm)
    must = F.col("occupied") & F.lit(p.max_size_mm > 0) & (size > p.max_size_mm)
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in why.items()], F.when(must, F.lit("above_max_cell_size"))))
    return cells.withColumns({"score": score, "reasons": named, "must": must, "may": can & F.coalesce(wanted, F.lit(False))})


def _finish(cells: DataFrame, p: Params) -> DataFrame:
    surface, inside = F.col("surface_hit"), F.col("inside_hit")
    return cells.withColumns({"confidence": P.confidence(F.col("occupied"), surface, inside, F.col("fraction"), F.col("candidate"), p.min_solid), "accepted": P.acceptance_reason(surface, inside, F.col("near_hit"), F.col("candidate"))})


def build(scene: Scene, root: DataFrame, p: Params = Params()) -> DataFrame:
    """Leaves of the octree over root cells (cell_id, level, centre and size), classified, balanced and marked.

    Without a budget whole levels are refined at once. With one (max_leaves) the order counts: cells wait in a queue by score,
    and a cell that need not be split is only while leaves, waiting cells and its children fit. The queue with one number a
    cell is the driver's; cells are classified in bulk whenever one that is not yet classified comes first.
    """
    leaves = _by_level(scene, root, p) if p.max_leaves is None else _by_priority(scene, root, p)
    return mark_oversized(balance(staged(leaves), scene, p), p.max_size_mm)


def _by_level(scene: Scene, root: DataFrame, p: Params) -> DataFrame:
    frontier, leaves = staged(root), None
    while not frontier.isEmpty():
        rows = staged(decide(classify(frontier, scene, p), p))
        done = _finish(rows.where("NOT (must OR may)"), p)
        leaves = done if leaves is None else leaves.unionByName(done)
        frontier = staged(octree.subdivide(rows.where("must OR may")))
    return leaves


def _by_priority(scene: Scene, root: DataFrame, p: Params) -> DataFrame:
    known: dict[str, tuple] = {}
    classified, waiting = [], root
    heap = [(0.0, n, r["cell_id"], r["level"]) for n, r in enumerate(root.orderBy("cell_id").collect())]
    pushed, leaves = len(heap), []
    while heap:
        if heap[0][2] not in known:
            rows = staged(decide(classify(waiting, scene, p), p))
            classified.append(rows)
            known.update({r["cell_id"]: (r["score"], r["must"], r["may"]) for r in rows.select("cell_id", "score", "must", "may").collect()})
            waiting = octree.subdivide(rows)  # children of all that were classified; those that are split come up next
            continue
        _, _, cell, level = heapq.heappop(heap)
        score, must, may = known[cell]
        if must or may and len(leaves) + len(heap) + 8 <= p.max_leaves:
            for d in range(8):
                heapq.heappush(heap, (-(score + 0.01 * (level + 1)) if p.by_priority else 0.0, pushed, f"{cell}{d}", level + 1))
                pushed += 1
        else:
            leaves.append(cell)
        if heap and heap[0][2] not in known:
            ids = root.sparkSession.createDataFrame([(x[2],) for x in heap if x[2] not in known], "cell_id string")
            every = octree.subdivide(classified[0].select("cell_id", "level", *[f"{v}{a}" for v in "cs" for a in AXES]))
            for rows in classified[1:]:
                every = every.unionByName(octree.subdivide(rows.select("cell_id", "level", *[f"{v}{a}" for v in "cs" for a in AXES])))
            waiting = staged(every.join(F.broadcast(ids), "cell_id", "left_semi"))
    ids = root.sparkSession.createDataFrame([(c,) for c in leaves], "cell_id string")
    every = classified[0]
    for rows in classified[1:]:
        every = every.unionByName(rows)
    return _finish(every.join(ids, "cell_id", "left_semi"), p)


def balance(leaves: DataFrame, scene: Scene, p: Params) -> DataFrame:
    """Leaves of which solid ones that touch a solid leaf more than balance_ratio times smaller are split, pass after pass.

    With a budget the first ones in order of ids are split as long as seven more leaves fit.
    """
    for _ in range(p.balance_passes):
        solid = leaves.where("component IS NOT NULL").select(F.col("cell_id").alias("node_id"), "component", *[f"{v}{a}" for v in "cs" for a in AXES])
        targets = coarse_neighbours(solid, p.balance_ratio).withColumnRenamed("node_id", "cell_id")
        targets = leaves.join(targets, "cell_id", "left_semi").where((F.col("level") < p.max_depth) & (_size() > p.min_size_mm)).select("cell_id")
        if p.max_leaves is not None:
            targets = targets.orderBy("cell_id").limit(max(0, (p.max_leaves - leaves.count()) // 7))
        targets = staged(targets)
        if targets.isEmpty():
            break
        kids = octree.subdivide(leaves.join(targets, "cell_id", "left_semi"))
        leaves = staged(leaves.join(targets, "cell_id", "left_anti").unionByName(_finish(decide(classify(staged(kids), scene, p), p), p).select(*leaves.columns)))
    return leaves


def mark_oversized(leaves: DataFrame, max_size_mm: float) -> DataFrame:
    """leaves with oversized; solid ones above the limit have low confidence."""
    big = F.col("component").isNotNull() & (_size() > max_size_mm)
    return leaves.withColumns({"oversized": big, "confidence": F.when(big, "low").otherwise(F.col("confidence"))})
