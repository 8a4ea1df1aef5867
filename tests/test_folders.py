"""Graph folders, parameters, workbooks, matrices and their checks."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from caloris.operators import matrices, reports
from caloris.sources import folders, graph_io


def test_grid_folder_is_read_repaired_and_written(spark, tmp_path):
    nodes = [{"id": str(n), "coord": [n % 2, n // 2, 0], "material": "copper" if n else "ALUMINUM?", "C_J_K": 5.0, "side_length_m": 0.01} for n in range(4)]
    (tmp_path / "graph3d.json").write_text(json.dumps({"nodes": [*nodes, {"id": "x"}], "edges": [{"source": "0", "target": "0", "Gij_W_K": 1.0}, {"source": "1", "target": "9", "Gij_W_K": 1.0}]}))
    g = folders.load(spark, f"file://{tmp_path}")
    assert {(r.node_i, r.node_j) for r in g.edges.collect()} == {(0, 1), (0, 2), (1, 3), (2, 3)} and len(g.warnings) == 1
    assert g.nodes.where("resolved_material = '6061-T6 Aluminum'").count() == 4  # names are matched as they are written
    (tmp_path / "metadata.json").write_text('{"edge_mode": "loaded_matrix"}')
    assert folders.load(spark, f"file://{tmp_path}").edges.count() == 0
    folders.save(g, f"file://{tmp_path}/out")
    assert json.loads((tmp_path / "out/summary.json").read_text())["edges"] == 4 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".summary.json.") and not p.name.endswith(".crc")]
    folders.save(g, f"file://{tmp_path}/out")
    with pytest.raises(FileNotFoundError):
        folders.load(spark, f"file://{tmp_path}/out")
    mode, edges, warned = matrices.after_topology_change(g.nodes.where("node_id < 3"), g.edges, "loaded_G")
    assert mode == "auto" and edges.count() == 2 and warned


def test_unsound_folder_raises(spark, tmp_path):
    (tmp_path / "graph.json").write_text(json.dumps({"graph_nodes": [{"node_id": 1, "C_J_K": 1.0}, {"node_id": 1, "C_J_K": 1.0}], "graph_edges": []}))
    with pytest.raises(ValueError, match="duplicate_node 1"):
        folders.load(spark, f"file://{tmp_path}")


def test_parameters_keep_unknown_names_and_move_old_ones(spark, tmp_path):
    (tmp_path / "simulation_parameters.json").write_text(json.dumps({"simulation_duration": 9.0, "mimo_decoupling_lambda": 0.5, "own": 3, "dt_s": 2.0}))
    known, others = folders.load_parameters(spark, str(tmp_path), {"dt_s": 1.0, "t_final_s": 60.0, "mimo_lambda_u": 0.1, "mimo_rho_du": 0.0})
    assert known == {"dt_s": 2.0, "t_final_s": 9.0, "mimo_lambda_u": 0.5, "mimo_rho_du": 0.0} and others["own"] == 3 and "mimo_decoupling_lambda" not in others
    folders.save_parameters(spark, str(tmp_path), known, others)
    assert folders.load_parameters(spark, str(tmp_path), known)[0] == known
    (tmp_path / "broken.json").write_text("{")
    for name in ("broken.json", "missing.json"):
        assert folders.load_parameters(spark, str(tmp_path), {"dt_s": 1.0}, name) == ({"dt_s": 1.0}, {})


def workbook() -> bytes:
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Cover" r:id="a"/><sheet name="Materials" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Part Name</t></si><si><r><t>Cop</t></r><r><t>per</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        rows = '<row><c r="B1"><v>7</v></c></row><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t> MATERIAL name</t></is></c></row><row><c r="A3"><v>12</v></c><c r="C3" t="s"><v>1</v></c></row><row><c r="A4"><v>13</v></c></row>'
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "materials.xlsx").write_bytes(workbook())
    assert [tuple(r) for r in folders.read_material_workbooks(spark, str(tmp_path)).collect()] == [("12", "Copper")]
    with pytest.raises(ValueError):
        folders.material_rows([["a"], ["b"]])


def test_scene_rule_phases_and_guards(spark, tmp_path):
    assert folders.one_scene(["a.GLB", "materials.xlsx"]) == "a.GLB"
    for names in (["a.glb", "b.gltf"], [], ["a.glb", "b.glb"]):
        with pytest.raises(ValueError):
            folders.one_scene(names)
    folder = f"file://{tmp_path}"
    assert folders.phase("leaves", spark.range(3), folder).count() == 3 and folders.phase("leaves", spark.range(9), folder).count() == 3
    none = spark.range(0)
    reports.require_nodes(spark.range(1), none)
    for leaves, limit, said in ((none, None, "no leaves"), (spark.range(4), 100, "100 leaves")):
        with pytest.raises(ValueError, match=said):
            reports.require_nodes(none, leaves, limit)


def test_matrix_checks_raise_what_is_wrong(spark):
    nodes = spark.range(3).withColumnRenamed("id", "node_id")
    vectors = nodes.selectExpr("node_id", "node_id AS i", "0 AS j", "0 AS k", "1.0D AS capacity_j_k", "0.0D AS g_rad_w_k")
    g = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0)], "row long, col long, value double")
    assert matrices.check_matrices(vectors, g, None, nodes).isEmpty() and matrices.check_matrices(vectors, None, None, nodes).first().rule == "missing_matrix"
    matrices.raise_if_any(matrices.check_conductance(nodes, g, nodes), "fine")
    with pytest.raises(ValueError, match="g_asymmetric 0-1"):
        matrices.raise_if_any(matrices.check_conductance(nodes, g.where("row = 0"), nodes), "bad")
    assert matrices.has_conduction(g) and not matrices.has_conduction(g.withColumn("value", F.lit(0.0)))


def test_gain_runs_are_replaced_and_temperatures_travel(spark, tmp_path):
    g = spark.createDataFrame([(1, 2, 0.5)], "sensor_id long, heater_id long, gain double")
    a, b = (graph_io.save_gains(g, str(tmp_path), n) for n in "ab")
    graph_io.update_gains(g.withColumn("gain", F.lit(0.75)), str(tmp_path), a)
    assert graph_io.load_gains(spark, str(tmp_path), a).first().gain == 0.75 and graph_io.load_gains(spark, str(tmp_path), b).first().gain == 0.5
    nodes = spark.createDataFrame([(1, 300.0), (2, 310.0)], "node_id long, temperature_k double")
    assert graph_io.temperature_payload(nodes).first()[0] == {"1": 300.0, "2": 310.0}
    payload = spark.createDataFrame([({"1": "250", "x": "1", "9": "2", "2": "warm"},)], "initial_temperature_by_node_K map<string,string>")
    rows, n = graph_io.apply_payload(nodes, payload)
    assert n == 1 and {r.node_id: r.temperature_k for r in rows.collect()} == {1: 250.0, 2: 310.0}
