"""Adaptive octrees built level by level: a frontier of cells is classified and split in bulk."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from caloris.operators.roles import triangle_hits
from caloris.session import staged

AXES = ("x", "y", "z")
#: Fixed value: direction of the containment ray before it is normalised.
RAY = (1.0, 0.3713906763541037, 0.1937728766089219)
#: Sample points of a cell, and the part of them that a triangle in the cell stands for.
SAMPLES, SURFACE_SHARE = 9, 0.12
#: Cells that are broadcast to the triangles.
FEW_CELLS = 10_000


def subdivide(cells: DataFrame) -> DataFrame:
    """Eight children of every cell, in the order (-, -, -), (-, -, +), ...; a child's id is its parent's and a digit."""
    eight = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(float(s)).alias(a) for a, s in zip(AXES, sign, strict=True)]) for n, sign in enumerate(product((-1, 1), repeat=3))]))
    rows = cells.select("cell_id", "level", *[f"c{a}" for a in AXES], *[f"s{a}" for a in AXES], eight.alias("o"))
    return rows.select(F.concat("cell_id", F.col("o.n").cast("string")).alias("cell_id"), (F.col("level") + 1).alias("level"), *[(F.col(f"c{a}") + F.col(f"o.{a}") * F.col(f"s{a}") / 4).alias(f"c{a}") for a in AXES], *[(F.col(f"s{a}") / 2).alias(f"s{a}") for a in AXES])


def sample_points(count: int) -> list[tuple[float, float, float]]:
    """Offsets (in half sizes) of a cell's samples: the nearest of a regular grid; they cover its central half."""
    if count <= 1:
        return [(0.0, 0.0, 0.0)]
    n = max(2, math.ceil(count ** (1 / 3)))
    steps = [-0.5 + (k + 1) / (n + 1) for k in range(n)]
    return sorted(product(steps, repeat=3), key=lambda p: (math.sqrt(sum(x * x for x in p)), p))[:count]


def met(cells: DataFrame, triangles: DataFrame) -> DataFrame:
    """The equi-join of cells with the triangles that are dealt to their grid cells (kx, ky, kz).

    Spark takes the dealt triangles for as small as the file that their keys came from, so it must not choose what to
    broadcast: cells are as long as they are few, so that the triangles stay where they are, and else both are shuffled.
    """
    keys = [f"k{a}" for a in AXES]
    return triangles.join(F.broadcast(cells), keys) if cells.count() <= FEW_CELLS else triangles.hint("merge").join(cells, keys)


def touched(cells: DataFrame, triangles: DataFrame) -> DataFrame:
    """cell_id, component of each component a triangle of which meets the cell. Triangles: component, tri (9 doubles).

    Cells of one level share a size, so triangles are dealt to the level's grid cells their bounds cover: an equi-join.
    """
    size = cells.agg(*[F.max(f"s{a}").alias(a) for a in AXES]).first()
    if size["x"] is None:
        return cells.select("cell_id").limit(0).withColumn("component", F.lit(None).cast("string"))
    keyed = cells
    rows = triangles
    near = F.lit(True)  # bounds meet: what is further apart need not pass the axes' tests
    for n, a in enumerate(AXES):
        s = float(size[a])
        low, high = (f(*[F.col("tri")[3 * v + n] for v in range(3)]) for f in (F.least, F.greatest))
        keyed = keyed.withColumn(f"k{a}", F.floor(F.col(f"c{a}") / s).cast("long"))
        rows = rows.withColumn(f"k{a}", F.explode(F.sequence(F.floor((low - 1e-6) / s - 0.5).cast("long"), F.floor((high + 1e-6) / s + 0.5).cast("long"))))
        near = near & (low <= F.col(f"c{a}") + F.col(f"s{a}") / 2 + 1e-6) & (high >= F.col(f"c{a}") - F.col(f"s{a}") / 2 - 1e-6)
    pairs = met(keyed, rows).where(near).select("cell_id", "component", "tri", *[f"c{a}" for a in AXES], *[f"s{a}" for a in AXES])
    return triangle_hits(pairs).select("cell_id", "component").distinct()


def inside(points: DataFrame, triangles: DataFrame, bounds: DataFrame) -> DataFrame:
    """point_id, component of the closed meshes that contain a point: an odd number of distinct ray hits.

    points: point_id, x, y, z; bounds: component with low and high (x, y, z), which are as few as components.
    """
    length = math.sqrt(sum(r * r for r in RAY))
    d = [r / length for r in RAY]
    within = points.join(F.broadcast(bounds) if bounds.count() <= 10_000 else bounds, F.expr(" AND ".join(f"{a} BETWEEN low_{a} AND high_{a}" for a in AXES)))
    rows = within.select("point_id", "component", *AXES).join(triangles.hint("merge"), "component")  # not broadcast: see met
    v = [[F.col("tri")[3 * k + n] for n in range(3)] for k in range(3)]
    e1, e2 = [[b - a for a, b in zip(v[0], v[k], strict=True)] for k in (1, 2)]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    ray = [F.lit(x) for x in d]
    h = cross(ray, e2)
    det = dot(e1, h)
    s = [F.col(a) - p for a, p in zip(AXES, v[0], strict=True)]
    u = dot(s, h) / det
    q = cross(s, e1)
    w, t = dot(ray, q) / det, dot(e2, q) / det
    hit = (F.abs(det) > 1e-12) & (u >= 0) & (w >= 0) & (u + w <= 1) & (t > 1e-9)
    crossings = rows.groupBy("point_id", "component").agg(F.count_distinct(F.when(hit, F.round(t, 8))).alias("n"))
    return crossings.where("n % 2 = 1").select("point_id", "component")


def occupancy(samples: DataFrame, total: int) -> DataFrame:
    """cell_id, component, fraction from (cell_id, component, hits): at least one hit, renormalised if they exceed 1."""
    from pyspark.sql import Window

    part = F.greatest("hits", F.lit(1)) / F.lit(float(total))
    rows = samples.withColumn("fraction", part)
    over = F.sum("fraction").over(Window.partitionBy("cell_id"))
    return rows.withColumn("fraction", F.col("fraction") / F.greatest(over, F.lit(1.0))).select("cell_id", "component", "fraction")


def dominant(fractions: DataFrame, order: str = "component") -> DataFrame:
    """cell_id, component of the largest fraction, ties by `order`."""
    best = F.min(F.struct((-F.col("fraction")).alias("f"), F.col(order).alias("o"), "component")).alias("b")
    return fractions.groupBy("cell_id").agg(best).select("cell_id", F.col("b.component").alias("component"), (-F.col("b.f")).alias("fraction"))


def point_octree(points: DataFrame, root: tuple[float, float, float, float], max_points: int, max_depth: int) -> DataFrame:
    """Leaves (cell_id, level, points) of an octree over points (x, y, z) that splits cells of more than max_points.

    A point's path is arithmetic, so all levels' counts come from one pass over the points.
    """
    x0, y0, z0, size = root
    keys = []
    for level in range(max_depth + 1):
        n = 1 << level
        k = [F.least(F.greatest(F.floor((F.col(a) - o) / size * n), F.lit(0)), F.lit(n - 1)).cast("long") for a, o in zip(AXES, (x0, y0, z0), strict=True)]
        keys.append(F.struct(F.lit(level).alias("level"), (k[0] * n * n + k[1] * n + k[2]).alias("key")))
    rows = points.select(F.explode(F.array(*keys)).alias("c")).groupBy("c.level", "c.key").agg(F.count("*").alias("points"))
    # a cell is a leaf if it is small or deepest, and every ancestor was split
    n = F.pow(F.lit(2), "level").cast("long")
    i, j, k = F.floor(F.col("key") / (n * n)), F.floor(F.col("key") / n) % n, F.col("key") % n
    half = F.floor(n / 2)
    parent = rows.select("level", "key", "points", (F.floor(i / 2) * half * half + F.floor(j / 2) * half + F.floor(k / 2)).cast("long").alias("up"))
    split = rows.where((F.col("points") > max_points) & (F.col("level") < max_depth)).select((F.col("level") + 1).alias("level"), F.col("key").alias("up"))
    # counts fall along a path, so a split parent means that all ancestors were split
    reached = parent.join(split, ["level", "up"], "left_semi").unionByName(parent.where("level = 0"))
    return reached.where((F.col("points") <= max_points) | (F.col("level") == max_depth)).select("level", "key", "points")


def closed(triangles: DataFrame) -> DataFrame:
    """component of the meshes without a border: every edge belongs to exactly two triangles. Triangles of no area do not count."""
    corner = [F.array(*[F.col("tri")[3 * k + n] + F.lit(0.0) for n in range(3)]) for k in range(3)]
    sides = F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in ((corner[0], corner[1]), (corner[1], corner[2]), (corner[0], corner[2]))]))
    solid = triangles.where((corner[0] != corner[1]) & (corner[1] != corner[2]) & (corner[0] != corner[2]))
    edges = solid.select("component", sides.alias("e")).groupBy("component", "e").agg(F.count("*").alias("n"))
    return edges.groupBy("component").agg(F.bool_and(F.col("n") == 2).alias("whole")).where("whole").select("component")


def classify(cells: DataFrame, triangles: DataFrame, solids: DataFrame, bounds: DataFrame, samples: int) -> DataFrame:
    """cell_id, component (the one that fills most of the cell), components, of every cell that holds any.

    A component whose triangles meet the cell counts as SURFACE_SHARE of the samples, and each sample point for the first
    closed mesh that contains it. solids and bounds: the triangles and bounds of the closed meshes.
    """
    offsets = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(float(o)).alias(a) for a, o in zip(AXES, p, strict=True)]) for n, p in enumerate(sample_points(samples))])
    points = cells.select("cell_id", *[f"c{a}" for a in AXES], *[f"s{a}" for a in AXES], F.explode(offsets).alias("o"))
    points = points.select(F.struct("cell_id", "o.n").alias("point_id"), *[(F.col(f"c{a}") + F.col(f"o.{a}") * F.col(f"s{a}") / 2).alias(a) for a in AXES])
    held = inside(points, solids, bounds).groupBy("point_id").agg(F.min("component").alias("component"))
    surface = touched(cells, triangles).withColumn("hits", F.lit(max(1, math.ceil(samples * SURFACE_SHARE))).cast("long"))
    hits = surface.unionByName(held.groupBy(F.col("point_id.cell_id").alias("cell_id"), "component").agg(F.count("*").alias("hits")))
    hits = hits.groupBy("cell_id", "component").agg(F.least(F.sum("hits"), F.lit(samples)).alias("hits"))
    shares = occupancy(hits, samples)
    return dominant(shares).select("cell_id", "component").join(shares.groupBy("cell_id").agg(F.count("*").alias("components")), "cell_id")


def build(triangles: DataFrame, root: DataFrame, *, max_size_mm: float, max_depth: int, samples: int = SAMPLES) -> DataFrame:
    """Octree: cells that a triangle meets or a closed mesh fills are split until they are small enough or deepest; leaves
    with component (null: empty). Level-synchronous, so its leaves do not depend on an order."""
    from caloris.sources.glb import component_bounds

    solids = staged(triangles.join(closed(triangles), "component", "left_semi").select("component", "tri"))
    bounds = staged(component_bounds(solids).drop("triangles"))
    frontier, leaves = staged(root), None
    while not frontier.isEmpty():
        rows = staged(frontier.join(classify(frontier, triangles, solids, bounds, samples), "cell_id", "left"))
        size = F.greatest(*[F.col(f"s{a}") for a in AXES])
        split: Column = F.col("component").isNotNull() & (size > max_size_mm) & (F.col("level") < max_depth)
        done = rows.where(~split)
        leaves = done if leaves is None else leaves.unionByName(done)
        frontier = staged(subdivide(rows.where(split)))
    return leaves


def histograms(leaves: DataFrame) -> DataFrame:
    """Leaves by level, by size and in all, in one pass."""
    rows = leaves.withColumn("size_mm", F.round(F.greatest("sx", "sy", "sz"), 6))
    return rows.groupingSets([["level"], ["size_mm"], []], "level", "size_mm").agg(F.count("*").alias("leaves"), F.count("component").alias("solid"))
