"""Adaptive octrees over boxes, whose cells can be judged by hand."""

from __future__ import annotations

from itertools import product

import pytest

from caloris.operators import adaptive


def box(name: str, low: tuple[float, ...], high: tuple[float, ...]) -> list[tuple[str, list[float]]]:
    """Twelve triangles of an axis-aligned box."""
    corner = [tuple(float((low, high)[b][n]) for n, b in enumerate(bits)) for bits in product((0, 1), repeat=3)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return [(name, [x for k in tri for x in corner[k]]) for a, b, c, d in quads for tri in ((a, b, c), (a, c, d))]


@pytest.fixture(scope="module")
def scene(spark):
    rows = box("big", (1, 1, 1), (31, 31, 31)) + box("small", (33, 1, 1), (39, 7, 7))
    parts = [("big", 0, "steel", 16.0, 4e6), ("small", 1, "copper", 400.0, 3.4e6)]
    return adaptive.Scene(spark.createDataFrame(rows, "component string, tri array<double>"), spark.createDataFrame(parts, "component string, ordinal int, material string, k_w_mk double, rho_cp double"))


def root(spark):
    return spark.createDataFrame([("r", 0, 32.0, 32.0, 32.0, 64.0, 64.0, 64.0)], "cell_id string, level int, cx double, cy double, cz double, sx double, sy double, sz double")


def volume(leaves) -> float:
    return sum(r.sx * r.sy * r.sz for r in leaves)


def test_leaves_fill_the_root_and_solid_ones_are_small_enough(spark, scene):
    p = adaptive.Params(min_size_mm=4.0, max_size_mm=16.0, max_depth=3, near_mm=0.0, boundary=False, multi_surface=0, complexity=0, accept=0.0, balance_passes=0)
    leaves = adaptive.build(scene, root(spark), p).collect()
    assert volume(leaves) == 64.0**3 and len({r.cell_id for r in leaves}) == len(leaves)
    for r in leaves:
        touches = [n for n, (lo, hi) in {"big": (1, 31), "small": (33, 39)}.items() if r.cx - r.sx / 2 <= hi and r.cx + r.sx / 2 >= lo and all(c - s / 2 <= (hi if n == "big" else 7) and c + s / 2 >= 1 for c, s in ((r.cy, r.sy), (r.cz, r.sz)))]
        assert (r.component is not None) == bool(touches) and (not touches or r.component in touches)
        assert r.component is None or r.sx <= 16.0
        assert not r.oversized and abs(sum(r.occupancy.values() if r.occupancy else [0]) - min(1, sum(r.occupancy.values() if r.occupancy else [0]))) < 1e-9


def test_classes_of_single_cells(spark, scene):
    cells = spark.createDataFrame([("in", 1, 16.0, 16.0, 16.0, 8.0, 8.0, 8.0), ("face", 1, 32.0, 4.0, 4.0, 8.0, 8.0, 8.0), ("gap", 1, 32.0, 16.0, 16.0, 1.0, 1.0, 1.0), ("far", 1, 60.0, 60.0, 60.0, 4.0, 4.0, 4.0)], root(spark).schema)
    got = {}
    for name in ("in", "face", "gap", "far"):
        p = adaptive.Params(near_mm=10.0)
        got[name] = adaptive.decide(adaptive.classify(cells.where(f"cell_id = '{name}'"), scene, p), p).first()
    assert got["in"].component == "big" and got["in"].inside_hit and not got["in"].surface_hit and got["in"].fraction == 1.0
    assert got["face"].surface_hit and got["face"].near_count == 2 and got["face"].parts == 2 and got["face"].contrast
    assert {"mixed_parts", "mixed_materials", "material_contrast", "multi_surface_ambiguity"} <= set(got["face"].reasons)
    assert not got["gap"].occupied and got["gap"].near_hit and got["gap"].near_count == 1 and not got["gap"].bbox_only
    assert got["far"].component is None and got["far"].score == 0.0 and not got["far"].candidate


def test_budget_and_priority(spark, scene):
    """Without need of the budget the queue gives the same leaves as whole levels; a small one is kept, but for what must be split."""
    p = {"min_size_mm": 4.0, "max_size_mm": 32.0, "max_depth": 2, "balance_passes": 0}
    whole = {r.cell_id for r in adaptive.build(scene, root(spark), adaptive.Params(**p)).collect()}
    assert {r.cell_id for r in adaptive.build(scene, root(spark), adaptive.Params(**p, max_leaves=10**6)).collect()} == whole
    few = adaptive.build(scene, root(spark), adaptive.Params(**p, max_leaves=16)).collect()
    assert len(few) == 15 < len(whole) and volume(few) == 64.0**3 and all(r.component is None or r.sx <= 32.0 for r in few)


def test_balance_splits_coarse_neighbours(spark, scene):
    p = {"min_size_mm": 2.0, "near_mm": 0.0}
    kids = adaptive.octree.subdivide(root(spark))
    rough = kids.where("cell_id <> 'r0'").unionByName(adaptive.octree.subdivide(adaptive.octree.subdivide(kids.where("cell_id = 'r0'"))))
    rough = adaptive.staged(adaptive._finish(adaptive.decide(adaptive.classify(adaptive.staged(rough), scene, adaptive.Params(**p)), adaptive.Params(**p)), adaptive.Params(**p)))
    even = adaptive.balance(rough, scene, adaptive.Params(**p, balance_passes=2, balance_ratio=2.0)).collect()
    assert volume(even) == 64.0**3 and len(even) > rough.count()
    solid = [r for r in even if r.component is not None]
    for a in solid:
        for b in solid:
            if a.sx > 2 * b.sx:
                assert max(abs(x - y) - (a.sx + b.sx) / 2 for x, y in zip((a.cx, a.cy, a.cz), (b.cx, b.cy, b.cz), strict=True)) > 1e-9
    capped = adaptive.balance(rough, scene, adaptive.Params(**p, balance_passes=2, balance_ratio=2.0, max_leaves=rough.count() + 8))
    assert capped.count() == rough.count() + 7


def test_oversized_leaves_are_marked(spark):
    rows = spark.createDataFrame([("a", "x", 9.0, "high"), ("b", None, 9.0, "high"), ("c", "x", 3.0, "high")], "cell_id string, component string, sx double, confidence string").selectExpr("*", "sx AS sy", "sx AS sz")
    assert {r.cell_id: (r.oversized, r.confidence) for r in adaptive.mark_oversized(rows, 5.0).collect()} == {"a": (True, "low"), "b": (False, "high"), "c": (False, "high")}
