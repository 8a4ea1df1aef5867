"""Graph folders, parameter files and workbooks: reading with aliases, checks and repair, writing in one step."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Mapping
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F

from caloris.operators import materials, matrices, reports
from caloris.sources import graph_io

#: Names of parameters that are gone, and old names of parameters that still exist.
GONE = frozenset("mimo_Kp_coarse mimo_Ki_coarse mimo_Kp_hold mimo_Ki_hold mimo_decoupling_lambda mimo_lambda_regularization mimo_rho_smoothness mimo_coupling_cutoff_fraction mimo_control_deadband_K mimo_hold_control_deadband_K mimo_negative_error_bleed_per_s mimo_hold_negative_error_bleed_per_s".split())
RENAMED = {"dt_s": ("simulated_seconds_per_update",), "t_final_s": ("simulation_duration",), "mimo_lambda_u": ("mimo_lambda_regularization", "mimo_decoupling_lambda"), "mimo_rho_du": ("mimo_rho_smoothness",)}


class Files:
    """Small files in a folder that Spark can reach: looked for, read, and written by renaming a whole new file into place."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._gateway, self._jvm, self.folder = spark.sparkContext._gateway, spark.sparkContext._jvm, folder.rstrip("/")
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.folder).getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self._at(f"{self.folder}/{name}")))

    def names(self) -> list[str]:
        at = self._at(self.folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(f"{self.folder}/{name}"))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        draft, last = self._at(f"{self.folder}/.{name}.{uuid.uuid4().hex}"), self._at(f"{self.folder}/{name}")
        out = self._fs.create(draft, True)
        out.write(text.encode())
        out.hsync()
        out.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(last), options)


def one_scene(names: list[str]) -> str:
    """The one .glb among the names of a folder; other kinds of scenes and more than one are refused."""
    if wrong := [n for n in names if n.lower().endswith(".gltf")]:
        raise ValueError(f"only binary scenes can be read, not {wrong[0]}")
    found = [n for n in names if n.lower().endswith(".glb")]
    if len(found) != 1:
        raise ValueError(f"one .glb is needed, there are {len(found)}")
    return found[0]


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    mode: str = "auto"
    materials: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


_NODE3D = "node_id string, id string, coord array<string>, material string, C_J_K double, Grad_W_K double, initial_temperature_K double, side_length_m double, is_heater boolean, is_sensor boolean"
_EDGE3D = "source string, target string, Gij_W_K double, source_metadata string, edge_type string"


def _read_grid_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.schema(f"nodes array<struct<{graph_io._fields(_NODE3D)}>>, edges array<struct<{graph_io._fields(_EDGE3D)}>>").option("multiLine", True).json(f"{folder}/graph3d.json")
    whole = lambda c: F.expr(f"try_cast({c} as bigint)")
    n = raw.select(F.explode("nodes").alias("n")).select("n.*").withColumn("node_id", F.coalesce(whole("node_id"), whole("id"))).where("node_id IS NOT NULL")
    place = [F.coalesce(F.try_element_at("coord", F.lit(k + 1)).try_cast("long"), F.col("node_id") if k == 0 else F.lit(0)).alias(a) for k, a in enumerate("ijk")]
    nodes = n.select("node_id", *place, "material", F.col("C_J_K").alias("capacity_j_k"), F.coalesce("Grad_W_K", F.lit(0.0)).alias("g_rad_w_k"), F.coalesce("initial_temperature_K", F.lit(293.15)).alias("temperature_k"), F.coalesce("side_length_m", F.lit(0.01)).alias("side_m"), F.coalesce("is_heater", F.lit(False)).alias("is_heater"), F.coalesce("is_sensor", F.lit(False)).alias("is_sensor"))
    e = raw.select(F.posexplode("edges").alias("ordinal", "e")).select("ordinal", whole("e.source").alias("node_i"), whole("e.target").alias("node_j"), F.col("e.Gij_W_K").alias("g_w_k"), F.coalesce("e.edge_type", F.lit("grid")).alias("edge_type"), F.coalesce("e.source_metadata", F.lit("auto")).alias("source"))
    return nodes, e


def load(spark: SparkSession, folder: str) -> Graph:
    """A graph folder: graph.json, else graph3d.json, with material properties put on its nodes, checked, and repaired.

    Edges to themselves or to missing nodes go, and of a pair the last counts. In auto mode a grid graph in which nothing
    conducts gets its edges anew. Breaches of the rules raise.
    """
    files = Files(spark, folder)
    if files.exists("graph.json"):
        nodes, edges = graph_io.read_graph(spark, folder)
        grid, mode = False, "auto"
    elif files.exists("graph3d.json"):
        nodes, edges = _read_grid_graph(spark, folder)
        meta = json.loads(files.read("metadata.json")) if files.exists("metadata.json") else {}
        grid, mode = True, "loaded_G" if str(meta.get("edge_mode")) in ("loaded_G", "loaded_matrix") else "auto"
    else:
        raise FileNotFoundError(f"{folder} holds neither graph.json nor graph3d.json")
    library = materials.seed_table(spark)
    if files.exists("materials_used.json"):
        library = materials.merge_library(library, materials.read_material_json(spark, f"{folder}/materials_used.json")[0].select("name", "density_kg_m3", "cp_j_kgk", "k_w_mk", "emissivity"))
    nodes = materials.resolve(nodes, library.drop("rho_cp"))
    ids = nodes.select("node_id").distinct()
    for c in ("node_i", "node_j"):
        edges = edges.join(ids.withColumnRenamed("node_id", c), c, "left_semi")
    keep = ("g_w_k", "edge_type", "source")
    edges = edges.where("node_i <> node_j").groupBy(F.least("node_i", "node_j").alias("node_i"), F.greatest("node_i", "node_j").alias("node_j")).agg(F.max_by(F.struct(*keep), "ordinal").alias("e")).select("node_i", "node_j", *[f"e.{c}" for c in keep])
    matrices.raise_if_any(reports.violations(nodes.withColumn("component", F.lit("any")), edges).where("rule IN ('duplicate_node', 'bad_temperature', 'negative_conductance')"), "the graph is not sound")
    warnings: list[str] = []
    if grid:
        edges, warnings = matrices.repair(nodes, edges, mode)
    return Graph(nodes, edges, mode, library, warnings)


def save(graph: Graph, folder: str) -> None:
    """Nodes and edges as tables, and graph.json's summary, which appears last and in one step."""
    spark = graph.nodes.sparkSession
    graph_io.write_graph(graph.nodes, graph.edges, folder)
    counts = {"nodes": graph.nodes.count(), "edges": graph.edges.count(), "edge_mode": graph.mode, "warnings": graph.warnings}
    Files(spark, folder).write("summary.json", json.dumps(counts))


def write_bundle(graph: Graph, folder: str, tables: Mapping[str, DataFrame]) -> None:
    """A build's whole output: the graph, and named reports as tables."""
    save(graph, folder)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_laplacian(spark: SparkSession, folder: str, edges: DataFrame) -> DataFrame:
    """L_sparse.json of a folder, else the Laplacian of the edges."""
    from caloris.operators.graph import conducting, laplacian

    if Files(spark, folder).exists("L_sparse.json"):
        return graph_io.read_sparse(spark, f"{folder}/L_sparse.json")
    return laplacian(conducting(edges))


def phase(graph_phase: str, df: DataFrame, folder: str) -> DataFrame:
    """A phase of a build, written and read again, so that a build which stops goes on from there."""
    files = Files(df.sparkSession, folder)
    if not files.exists(f"{graph_phase}/_SUCCESS"):
        df.write.mode("overwrite").parquet(f"{folder}/{graph_phase}")
    return df.sparkSession.read.parquet(f"{folder}/{graph_phase}")


def load_parameters(spark: SparkSession, folder: str, defaults: Mapping[str, object], name: str = "simulation_parameters.json") -> tuple[dict[str, object], dict[str, object]]:
    """Known parameters over their defaults, and unknown ones to be kept. Old names fill in for new ones that are missing; what
    is gone is dropped; a file that cannot be read counts as empty."""
    files = Files(spark, folder)
    try:
        raw = json.loads(files.read(name)) if files.exists(name) else {}
    except json.JSONDecodeError:
        raw = {}
    found = dict(raw)
    for new, old in RENAMED.items():
        if new not in found and (first := next((o for o in old if o in raw), None)):
            found[new] = raw[first]
    return {k: found.get(k, v) for k, v in defaults.items()}, {k: v for k, v in raw.items() if k not in defaults and k not in GONE}


def save_parameters(spark: SparkSession, folder: str, known: Mapping[str, object], others: Mapping[str, object], name: str = "simulation_parameters.json") -> None:
    Files(spark, folder).write(name, json.dumps({**others, **known}, indent=2))


def workbook_rows(data: bytes, sheet: str = "Materials") -> list[list[str]]:
    """Rows of text of a sheet of a workbook (.xlsx), the named one or else the first."""
    book = zipfile.ZipFile(io.BytesIO(data))
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    texts = lambda e: "".join(x.text or "" for x in e.iter() if tag(x) == "t")
    shared = [texts(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    links = {r.attrib["Id"]: r.attrib["Target"] for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.attrib["name"], next(v for k, v in s.attrib.items() if k.endswith("}id"))) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if tag(s) == "sheet"]
    target = links[dict(sheets).get(sheet, sheets[0][1])].lstrip("/")
    rows = []
    for r in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter():
        if tag(r) != "row":
            continue
        cells: dict[int, str] = {}
        for c in r:
            column = 0
            for letter in re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]:
                column = column * 26 + ord(letter) - 64
            value = next((x.text or "" for x in c if tag(x) == "v"), "")
            kind = c.attrib.get("t")
            cells[column - 1 if column else len(cells)] = shared[int(value)] if kind == "s" else texts(c) if kind == "inlineStr" else value
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def material_rows(rows: list[list[str]]) -> list[tuple[str, str]]:
    """(part, material) below the header with 'part name' and 'material name', which is looked for in the first 50 rows."""
    for n, row in enumerate(rows[:50]):
        head = [x.strip().lower() for x in row]
        if "part name" in head and "material name" in head:
            p, m = head.index("part name"), head.index("material name")
            found = [(r[p].strip(), r[m].strip()) for r in rows[n + 1 :] if len(r) > max(p, m)]
            return [x for x in found if all(x)]
    raise ValueError("no row with 'Part Name' and 'Material Name'")


def read_material_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """part, material of every workbook under a path that Spark can read."""
    import pyarrow as pa

    from caloris.session import ship_package

    ship_package(spark)

    def run(batches):  # noqa: ANN001, ANN202
        from caloris.sources.folders import material_rows, workbook_rows

        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = material_rows(workbook_rows(data))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["part", "material"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInArrow(run, "part string, material string")
