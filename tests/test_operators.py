"""Small cases with known results."""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from caloris.functions import boxes, text
from caloris.operators import contacts, control, graph, materials, octree, reports, roles, simulate, sysid
from caloris.sources import glb, graph_io
from caloris.streaming import controller

CELL = "node_id long, cx double, cy double, cz double, sx double, sy double, sz double, component string, material string, k double"


def cells(spark, *rows):
    """Rows of (id, x, size, component, material, k)."""
    return spark.createDataFrame([(i, float(x), 0.0, 0.0, *([float(s)] * 3), c, m, float(k)) for i, x, s, c, m, k in rows], CELL)


def test_touching_cells_of_other_part_and_material_get_an_interface(spark):
    c = cells(spark, (1, 0, 10, "a", "Copper", 401), (2, 10, 10, "b", "Aluminium", 167))
    (e,) = contacts.typed_edges(contacts.shared_faces(contacts.candidate_pairs(c))).collect()
    want = 1 / (0.005 / (401 * 1e-4) + 1 / (1e4 * 1e-4) + 0.005 / (167 * 1e-4))
    assert (e.edge_type, e.contact_confidence) == ("uncertain_contact", "low") and e.g_w_k == pytest.approx(want)


def test_near_contact(spark):
    c = cells(spark, (1, 0, 10, "a", "m", 100), (2, 12, 10, "b", "m", 100))
    assert contacts.shared_faces(contacts.candidate_pairs(c)).count() == 0
    (e,) = contacts.typed_edges(contacts.near_faces(contacts.candidate_pairs(c, 3.0), 3.0), near=True).collect()
    assert e.edge_type == "near_same_material_contact" and e.shared_area_m2 == pytest.approx(1e-4) and e.distance_m == pytest.approx(0.012)


def test_pairs_of_boxes_from_small_to_huge(spark):
    """Edges from 1 to 10,000 mm: the same pairs as by comparing all, each once, and few buckets however large a box."""
    from caloris.operators import spatial

    rng = np.random.default_rng(3)
    size = 10.0 ** rng.uniform(0, 4, 70)
    at = rng.uniform(-2000, 2000, (70, 3))
    rows = [(n, *map(float, at[n]), *map(float, size[n] * rng.uniform(0.2, 1, 3))) for n in range(70)]
    c = spark.createDataFrame(rows, "node_id long, cx double, cy double, cz double, sx double, sy double, sz double")
    near = lambda a, b, gap: all(abs(a[1 + k] - b[1 + k]) <= (a[4 + k] + b[4 + k]) / 2 + gap for k in range(3))
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b, 25.0))
    assert sorted((r.a_node_id, r.b_node_id) for r in contacts.candidate_pairs(c, 25.0).select("a_node_id", "b_node_id").collect()) == want and len(want) > 50
    boxes = spatial.with_corners(c)
    left, right = boxes.where("node_id % 3 = 0"), boxes.where("node_id % 3 <> 0")
    got = sorted((r.l_node_id, r.r_node_id) for r in spatial.pairs(left, right, 12.5).select("l_node_id", "r_node_id").collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] % 3 == 0 and b[0] % 3 and near(a, b, 25.0))
    assert spatial._stored(spatial._leveled(boxes, 12.5), 12.5, "").groupBy("node_id").count().agg(F.max("count")).first()[0] <= 8


def test_candidate_pairs_come_once(spark):
    c = cells(spark, (1, 0, 10, "a", "m", 1), (2, 10, 10, "a", "m", 1), (3, 23, 10, "a", "m", 1), (4, 200, 10, "a", "m", 1))
    pairs = lambda gap: sorted((r.a_node_id, r.b_node_id) for r in contacts.candidate_pairs(c, gap).collect())
    assert pairs(0.0) == [(1, 2)] and pairs(3.0) == [(1, 2), (2, 3)]


def test_exposed_area_of_a_lone_cube(spark):
    c = cells(spark, (1, 0, 1, "a", "m", 1))
    assert contacts.exposed_area(c, contacts.shared_faces(contacts.candidate_pairs(c))).first().exposed_mm2 == 6.0


def test_grid_edges(spark):
    c = spark.createDataFrame([(10, 0, 0, 0), (2, 1, 0, 0), (7, 1, 1, 0)], "node_id long, i long, j long, k long")
    assert sorted(map(tuple, contacts.grid_edges(c).collect())) == [(2, 7), (2, 10)]


def test_components_and_degrees(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node_id long")
    edges = spark.createDataFrame([(1, 2), (3, 4), (4, 3)], "node_i long, node_j long")
    got = {r.node_id: r.component_id for r in graph.numbered_components(graph.components(nodes, edges)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "node_i long, node_j long")
    d = {r.node_id: (r.neighbours, r.visible_neighbours) for r in graph.degrees(nodes, edges, nodes.where("node_id <= 2")).collect()}
    assert d[1] == (2, 1) and d[5] == (0, 0)


def test_components_of_a_long_path_and_no_edges(spark):
    nodes = spark.range(200).withColumnRenamed("id", "node_id")
    path = spark.range(199).select(F.col("id").alias("node_i"), (F.col("id") + 1).alias("node_j"))
    assert graph.components(nodes, path).select("label").distinct().count() == 1
    assert graph.components(nodes, path.limit(0)).select("label").distinct().count() == 200


def test_tags_and_quality(spark):
    cols = "node_id long, size_mm double, confidence string, warnings array<string>, degree long, disconnected boolean, is_heater boolean, is_sensor boolean, heater_valid boolean, sensor_valid boolean, assigned_sensor_id long, assigned_heater_id long"
    n = spark.createDataFrame([(1, 8.0, "low", [], 1, False, True, False, True, True, None, None), (2, 1.0, "high", ["w"], 0, True, False, True, True, False, None, 1)], cols)
    got = {r.node_id: r.t for r in n.select("node_id", reports.warning_tags(4.0).alias("t")).collect()}
    assert got == {1: ["oversized_cell", "low_confidence", "unpaired_heater"], 2: ["node_warning", "isolated_node", "disconnected_component", "invalid_sensor"]}
    q = reports.quality(n.withColumn("tags", reports.warning_tags(4.0))).first()
    assert q.score == 100 - 2 - 1 - 2 - 2 - 2 and q.grade == "A"


def test_material_aliases_and_inference(spark):
    report = spark.createDataFrame([("PartA-1", "Copper")], "part string, material string")
    assert {r.alias: r.material for r in materials.alias_table(report).collect()} == {"PartA-1": "Copper", "PartA": "Copper"}
    known = [m[0] for m in materials.SEED]
    rows = spark.createDataFrame([("x SHCS_18-8SS_1530",), ("DISC SPRING_304SS_483",), ("SOME_PART_17-7PH_22",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.infer_material(F.col("t"), known)).collect()] == ["18-8 Stainless Steel", "AISI 304 Stainless Steel", "17-7PH Stainless Steel", None]


def test_material_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"name": "a", "rho_kg_m3": 1, "cp_J_kgK": 2, "k_W_mK": 3}, {"name": "b"}, {"name": "c", "density_kg_m3": "x", "cp_J_kgK": 1, "k_W_mK": 1}]))
    good, bad = materials.read_material_json(spark, str(tmp_path / "m.json"))
    assert [(r.name, r.emissivity) for r in good.collect()] == [("a", 0.85)] and bad.count() == 2


def roles_at(spark, *rows):
    return spark.createDataFrame([(i, k, n, float(x), 0.0, 0.0, 2.0, 2.0, 2.0) for i, k, n, x in rows], "role_id long, kind string, name string, cx double, cy double, cz double, sx double, sy double, sz double")


def test_pairing_by_distance_and_capacity(spark):
    r = roles_at(spark, (1, "heater", "h", 0), (2, "heater", "h", 1), (3, "sensor", "s", 4))
    c = roles.pair_candidates(r.where("kind = 'heater'"), r.where("kind = 'sensor'"), 2.1)
    assert sorted(map(tuple, roles.greedy_pairs(c).collect())) == [(2, 3, 1.0)]
    assert sorted(map(tuple, roles.greedy_pairs(c, 2).collect())) == [(1, 3, 2.0), (2, 3, 1.0)]


def test_greedy_rounds_equal_sequential_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(h), int(s), float(rng.integers(1, 9))) for h in range(12) for s in range(100, 108) if rng.random() < 0.5]
    taken, used, want = set(), {}, []
    for h, s, d in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if h not in taken and used.get(s, 0) < 2:
            taken.add(h)
            used[s] = used.get(s, 0) + 1
            want.append((h, s, d))
    got = roles.greedy_pairs(spark.createDataFrame(rows, "heater_id long, sensor_id long, distance_mm double"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_role_collapse(spark):
    r = roles_at(spark, (1, "heater", "h_mesh", 0), (2, "heater", "h_body", 1), (3, "heater", "h", 50))
    assert [(x.role, x.objects) for x in roles.collapse(r, 5.0).orderBy("min_x").collect()] == [("h_1", 2), ("h_2", 1)]


def test_triangle_outside_the_corner_misses():
    tri = np.array([[[0.9, 0.9, 0.0], [0.4, 1.2, 0.0], [1.2, 0.4, 0.0]], [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]])
    assert boxes.meet(tri, np.full((2, 3), 0.5)).tolist() == [False, True]


def block(c, t, i, j, g):
    return (np.array(c, float), np.array(t, float), np.zeros(len(c)), np.array(i), np.array(j), np.array(g, float))


def test_implicit_steps_approach_the_exact_solution():
    c, t, s, i, j, g = block([10, 10], [310, 290], [0], [1], [0.5])
    exact = 300 + 10 * math.exp(-0.1 * 4)
    euler = simulate.advance_block(c, t, s, i, j, g, 1.0, 4, "backward_euler")
    bdf = simulate.advance_block(c, t, s, i, j, g, 1.0, 4, "tr_bdf2")
    assert abs(bdf[0] - exact) < 2e-3 < abs(euler[0] - exact) and bdf.sum() == pytest.approx(600)


def test_steppers_agree(spark):
    cols = "node_id long, capacity_j_k double, temperature_k double, power_w double, radiation_w_k4 double, surroundings_k double"
    s = spark.createDataFrame([(n, 10.0 + n, 300.0 + n, 0.1 * n, 0.0, 290.0) for n in range(6)], cols)
    e = spark.createDataFrame([(n, n + 1, 0.5) for n in range(4)], "node_i long, node_j long, g_w_k double")
    by = lambda df: np.array([r.temperature_k for r in df.orderBy("node_id").collect()])
    exact = by(simulate.exponential_steps(s, e, 1.0, 2))
    assert np.abs(by(simulate.implicit_steps(s, e, 1.0, 2)) - exact).max() < 1e-4
    assert np.abs(by(simulate.explicit_steps(s, e, 1.0, 2, substeps=4).where("step = 2").select("node_id", "temperature_k")) - exact).max() < 5e-2
    nodes = s.select("node_id", F.col("capacity_j_k").alias("c"), F.col("temperature_k").alias("t"), F.col("power_w").alias("s"))
    euler = by(simulate.implicit_steps(s, e, 1.0, 2, method="backward_euler"))
    assert np.abs(by(simulate._distributed(nodes, e, 1.0, 2)) - euler).max() < 1e-5


@pytest.mark.parametrize("method", ["tr_bdf2", "backward_euler"])
def test_components_beyond_one_task_take_the_same_steps(spark, monkeypatch, method):
    cols = "node_id long, capacity_j_k double, temperature_k double, power_w double, radiation_w_k4 double, surroundings_k double"
    s = spark.createDataFrame([(n, 5.0 + n % 3, 300.0 + 7 * (n % 5), 0.1 * n, 1e-9, 290.0) for n in range(9)], cols)
    e = spark.createDataFrame([*[(n, n + 1, 0.5 + n % 2) for n in range(6)], (7, 8, 1.5)], "node_i long, node_j long, g_w_k double")
    by = lambda: np.array([r.temperature_k for r in simulate.implicit_steps(s, e, 10.0, 2, method=method).orderBy("node_id").collect()])
    whole = by()
    monkeypatch.setattr(simulate, "TASK_NODES", 2)
    assert np.abs(by() - whole).max() < 1e-6


def test_unconverged_solves_raise(spark):
    nodes = spark.createDataFrame([(n, 1.0, 300.0 + 7 * (n % 5), 0.0) for n in range(9)], "node_id long, c double, t double, s double")
    e = spark.createDataFrame([(n, n + 1, 50.0) for n in range(8)], "node_i long, node_j long, g_w_k double")
    with pytest.raises(RuntimeError):
        simulate._distributed(nodes, e, 10.0, 1, most=1)
    with pytest.raises(RuntimeError):
        simulate.conjugate_gradient(lambda x: x * np.array([1.0, 50.0, 900.0]), np.ones(3), np.ones(3), np.zeros(3), most=1)


def test_radiation_cools(spark):
    cols = "node_id long, capacity_j_k double, temperature_k double, power_w double, radiation_w_k4 double, surroundings_k double"
    s = spark.createDataFrame([(1, 10.0, 300.0, 0.0, 0.5 * 5.670374419e-8 * 2, 290.0)], cols)
    e = spark.createDataFrame([], "node_i long, node_j long, g_w_k double")
    want = 300 + 0.5 * 5.670374419e-8 * 2 / 10 * (290**4 - 300**4)
    assert simulate.explicit_steps(s, e, 1.0, 1).where("step = 1").first().temperature_k == pytest.approx(want)
    assert simulate.explicit_steps(s, e, 1.0, 1, radiation=False).where("step = 1").first().temperature_k == 300.0


def test_allocation():
    one = lambda **k: control.allocate(np.array([[1.0]]), np.array([k.pop("y")]), low=np.array([k.pop("low", -100.0)]), high=np.array([k.pop("high", 100.0)]), **k)[0]
    assert one(y=5.0) == pytest.approx(5)
    assert one(y=20.0, high=4.0) == 4.0
    assert one(y=12.0, smooth=1.0, previous=np.array([2.0])) == pytest.approx(7)
    assert one(y=10.0, ridge=1.0, reference=np.array([20.0])) == pytest.approx(15)
    assert one(y=50.0, previous=np.array([2.0]), slew=np.array([3.0])) == 5.0


def test_controls(spark):
    r = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 3.0)], "k long, error double, weight double")
    assert control.weighted_rms(r, "k").first().rms == pytest.approx(math.sqrt(13))
    s = spark.createDataFrame([(1, 0, 10.0)], "sensor_id long, n int, value double")
    assert control.fractional(s, 0.5, 4.0, memory=4).first().result == pytest.approx(20)
    assert control.fractional(s, 1.0, 4.0, memory=4, derive=True).first().result == 0.0


def test_gain_comparison(spark):
    g = lambda *rows: spark.createDataFrame(rows, "sensor_id long, heater_id long, gain double")
    a, b = g((1, 10, 1.0), (2, 10, 2.0)), g((2, 10, 3.0), (2, 11, 4.0), (3, 10, 5.0), (3, 11, 6.0))
    got = sysid.compare(a, b).first()
    assert got.cells == 6 and got.max_abs == 6.0
    assert sysid.compare(a.limit(0), b).first().relative is None


def test_octree_samples_and_subdivision(spark):
    assert octree.sample_points(1) == [(0.0, 0.0, 0.0)] and len(octree.sample_points(9)) == 9 and max(abs(x) for p in octree.sample_points(9) for x in p) < 0.5
    root = spark.createDataFrame([("r", 0, 0.0, 0.0, 0.0, 8.0, 8.0, 8.0)], "cell_id string, level int, cx double, cy double, cz double, sx double, sy double, sz double")
    kids = octree.subdivide(root).orderBy("cell_id").collect()
    assert [k.cell_id for k in kids] == [f"r{n}" for n in range(8)] and (kids[1].cx, kids[1].cz, kids[1].sx) == (-2.0, 2.0, 4.0)


def tetrahedron():
    v = [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (0.0, 4.0, 0.0), (0.0, 0.0, 4.0)]
    return [[x for p in f for x in v[p]] for f in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]


def test_containment_and_surface_octree(spark):
    tri = spark.createDataFrame([("t", f) for f in tetrahedron()], "component string, tri array<double>")
    points = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 3.0, 3.0, 3.0)], "point_id long, x double, y double, z double")
    bounds = glb.component_bounds(tri)
    assert [r.point_id for r in octree.inside(points, tri, bounds).collect()] == [1]
    root = spark.createDataFrame([("r", 0, 4.0, 4.0, 4.0, 8.0, 8.0, 8.0)], "cell_id string, level int, cx double, cy double, cz double, sx double, sy double, sz double")
    leaves = octree.build(tri, root, max_size_mm=2.0, max_depth=5)
    assert leaves.where("component IS NOT NULL").agg(F.max("sx")).first()[0] <= 2.0
    assert leaves.agg(F.sum(F.col("sx") * F.col("sy") * F.col("sz"))).first()[0] == pytest.approx(512.0)


def cube(low: float, high: float) -> list[list[float]]:
    p = [[high if n >> a & 1 else low for a in range(3)] for n in range(8)]
    quads = ((0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5))
    return [p[a] + p[b] + p[c] for q in quads for a, b, c in (q[:3], (q[0], q[2], q[3]))]


def test_octree_fills_closed_meshes_and_shared_cells_go_to_what_fills_them(spark):
    rows = [("b", t) for t in cube(1.0, 31.0)] + [("a", t) for t in cube(1.2, 1.3)] + [("open", t) for t in cube(2.0, 30.0)[1:]]
    tri = spark.createDataFrame(rows, "component string, tri array<double>")
    assert {r.component for r in octree.closed(tri).collect()} == {"a", "b"}
    root = spark.createDataFrame([("r", 0, 16.0, 16.0, 16.0, 32.0, 32.0, 32.0)], "cell_id string, level int, cx double, cy double, cz double, sx double, sy double, sz double")
    leaves = octree.build(tri, root, max_size_mm=4.0, max_depth=5).collect()
    # all 512 cells of 4 mm hold b: 216 of the 8 x 8 x 8 lie wholly inside
    assert len(leaves) == 512 and {r.sx for r in leaves} == {4.0}
    assert {r.component for r in leaves if all(4 < r[f"c{x}"] < 28 for x in "xyz")} == {"b"}
    assert next(r.component for r in leaves if r.cx == r.cy == r.cz == 2.0) == "b"


def glb_bytes() -> bytes:
    points = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4")
    faces = np.array([0, 1, 2, 0, 1, 9], "<u2")
    binary = points.tobytes() + faces.tobytes()
    spec = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}],
        "nodes": [{"name": "root", "children": [1], "translation": [1, 0, 0]}, {"name": "part", "mesh": 0, "scale": [2, 2, 2]}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "material": 0}]}], "materials": [{"name": "Copper"}],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 3, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 6, "type": "SCALAR"}],
        "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 36}, {"buffer": 0, "byteOffset": 36, "byteLength": 12}], "buffers": [{"byteLength": len(binary)}],
    }
    head = json.dumps(spec).encode()
    head += b" " * (-len(head) % 4)
    body = struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(binary), b"BIN\0") + binary
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def test_glb_scene(spark, tmp_path):
    (tmp_path / "a.glb").write_bytes(glb_bytes())
    (r,) = glb.read_scenes(spark, str(tmp_path)).collect()
    assert (r.component, r.material_name, r.path) == ("part", "Copper", ["root#0", "part#1"]) and r.tri[:6] == [1000.0, 0.0, 0.0, 3000.0, 0.0, 0.0]
    spark.dataSource.register(glb.GlbSource)
    assert spark.read.format("glb").load(str(tmp_path / "a.glb")).count() == 1
    up = glb.ancestors(spark, spark.createDataFrame([(0, None, "root"), (1, 0, "a"), (2, 1, "b")], "node int, parent int, name string"))
    assert {x.node: x.path for x in up.collect()}[2] == ["root", "a", "b"]
    deep = [(n, n - 1 if n else None, f"n{n}") for n in range(150)] + [(200, 201, "x"), (201, 200, "y"), (202, 201, "z"), (300, 999, "alone")]
    up = {x.node: x.path for x in glb.ancestors(spark, spark.createDataFrame(deep, "node int, parent int, name string")).collect()}
    assert up[149] == [f"n{n}" for n in range(150)] and up[300] == ["alone"] and set(up) == {*range(150), 300}


def test_graph_folder_and_sparse_matrix(spark, tmp_path):
    (tmp_path / "graph.json").write_text(json.dumps({"graph_nodes": [{"id": 1, "component": "c", "center_mm": [1, 2, 3], "size_mm": [1, 1, 1]}, {"node_id": "bad"}], "graph_edges": [{"edge_id": "e", "node_i": 1, "node_j": 2, "G_W_K": 0.5}]}))
    nodes, edges = graph_io.read_graph(spark, str(tmp_path))
    assert [(n.node_id, n.component, n.cy) for n in nodes.collect()] == [(1, "c", 2.0)] and edges.first().g_w_k == 0.5
    (tmp_path / "l.json").write_text(json.dumps({"shape": [2, 2], "format": "coo", "row": [0, 1], "col": [1, 0], "data": [-1.0, -1.0]}))
    assert graph.asymmetry(graph_io.read_sparse(spark, str(tmp_path / "l.json"))).first().symmetric
    (tmp_path / "x.json").write_text(json.dumps({"shape": [2, 2], "format": "csr", "row": [0], "col": [1], "data": [1.0]}))
    with pytest.raises(Exception, match="COO"):
        graph_io.read_sparse(spark, str(tmp_path / "x.json")).collect()


def test_gain_runs_and_tag_overlay(spark, tmp_path):
    g = spark.createDataFrame([(1, 2, 0.5)], "sensor_id long, heater_id long, gain double")
    run = graph_io.save_gains(g, str(tmp_path), "r")
    assert graph_io.list_gains(spark, str(tmp_path)).first().run == run and graph_io.load_gains(spark, str(tmp_path), run).count() == 1
    n = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "1"})], "node_id long, tags map<string,string>")
    t = spark.createDataFrame([(1, {"b": "9"})], "node_id long, tags map<string,string>")
    assert {r.node_id: r.tags for r in graph_io.overlay_tags(n, t).collect()} == {1: {"a": "1", "b": "9"}, 2: {"a": "1"}}


def test_stream_keeps_state_across_batches(spark, tmp_path):
    schema = "sensor_id long, time_s double, value double"
    o = {"tau_s": 1.0, "setpoint": 0.0, "hold": 1.0, "coarse": 5.0}
    run = lambda: controller.run_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), **o)
    spark.createDataFrame([(1, 0.0, 10.0)], schema).write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([(1, 1.0, 0.0), (1, 0.5, 99.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.time_s: (r.filtered, r.mode) for r in run().collect()}
    assert got[0.0] == (10.0, "coarse") and got[1.0][1] == "hold" and len(got) == 3
