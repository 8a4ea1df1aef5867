"""Binary glTF scenes as a Spark data source: one row per triangle, in scene order."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: component types and element sizes.
_TYPES = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
SCHEMA = "component string, material_name string, path array<string>, tri_id long, tri array<double>"


def chunks(data: bytes) -> tuple[dict, bytes]:
    """The JSON and binary chunks of a GLB file."""
    magic, version, length = struct.unpack_from("<4sII", data)
    if magic != b"glTF" or version != 2:
        raise ValueError("not a binary glTF 2 file")
    spec, binary, at = {}, b"", 12
    while at + 8 <= min(length, len(data)):
        size, kind = struct.unpack_from("<I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"JSON":
            spec = json.loads(body)
        elif kind == b"BIN\0":
            binary = body
        at += 8 + size
    return spec, binary


def accessor(spec: dict, binary: bytes, index: int) -> np.ndarray:
    a = spec["accessors"][index]
    view = spec["bufferViews"][a["bufferView"]]
    kind, width = np.dtype(_TYPES[a["componentType"]]), _WIDTH[a["type"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = view.get("byteStride") or kind.itemsize * width
    rows = np.ndarray((a["count"], width), kind, binary, start, (stride, kind.itemsize))
    return rows.astype(float if kind.kind == "f" else np.int64)


def matrix(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = node.get("rotation", (0, 0, 0, 1))
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)))
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def triangles(data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA: nodes from the scene's roots down, transforms applied, rows that are not finite left out."""
    spec, binary = chunks(data)
    nodes = spec.get("nodes", [])
    children = {c for n in nodes for c in n.get("children", ())}
    scenes = spec.get("scenes") or [{"nodes": [i for i in range(len(nodes)) if i not in children]}]
    stack = [(i, np.eye(4), (), frozenset()) for i in reversed(scenes[spec.get("scene", 0)].get("nodes", ()))]
    while stack:
        i, above, path, seen = stack.pop()
        if i in seen:
            continue
        node = nodes[i]
        here, name = above @ matrix(node), node.get("name") or f"node_{i}"
        path = (*path, f"{name}#{i}")
        stack += [(c, here, path, seen | {i}) for c in reversed(node.get("children", ()))]
        if "mesh" not in node:
            continue
        n = 0
        for part in spec["meshes"][node["mesh"]].get("primitives", ()):
            if part.get("mode", 4) != 4:
                continue
            points = accessor(spec, binary, part["attributes"]["POSITION"]) @ here[:3, :3].T + here[:3, 3]
            faces = (accessor(spec, binary, part["indices"])[:, 0] if "indices" in part else np.arange(len(points)))[: len(points) // 3 * 3 if "indices" not in part else None]
            faces = faces[: len(faces) // 3 * 3].reshape(-1, 3)
            faces = faces[((faces >= 0) & (faces < len(points))).all(axis=1)]
            tri = points[faces].reshape(-1, 9)
            material = spec["materials"][part["material"]].get("name") if "material" in part else None
            for row in tri[np.isfinite(tri).all(axis=1)]:
                yield name, material, list(path), n, row.tolist()
                n += 1


class _File(InputPartition):
    pass


class GlbReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_File(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        files, name = fs.FileSystem.from_uri(partition.value) if "://" in partition.value else (fs.LocalFileSystem(), partition.value.removeprefix("file:"))
        with files.open_input_stream(name) as f:
            yield from triangles(f.read())


class GlbSource(DataSource):
    """spark.dataSource.register(GlbSource); spark.read.format("glb").load(path), for stores that Arrow can open on the executors;
    read_scenes takes any path that Spark can read."""

    @classmethod
    def name(cls) -> str:
        return "glb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return GlbReader(dict(self.options))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of every GLB file under a path that Spark can read, in mm: scenes smaller than 10 units are in metres."""
    from caloris.session import ship_package

    ship_package(spark)

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from caloris.sources.glb import triangles

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, *r) for r in triangles(data)]
                for k in range(0, len(rows), 20_000):
                    cols = [*zip(*rows[k : k + 20_000], strict=True)]
                    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["scene", "component", "material_name", "path", "tri_id", "tri"])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").load(path).select("path", "content").mapInArrow(run, f"scene string, {SCHEMA}")
    return in_mm(rows)


def in_mm(rows: DataFrame) -> DataFrame:
    """Scale every scene whose largest extent lies between 0 and 10 by 1000."""
    axis = lambda n: F.array(*[F.col("tri")[3 * v + n] for v in range(3)])
    extents = [F.max(F.array_max(axis(n))) - F.min(F.array_min(axis(n))) for n in range(3)]
    scale = rows.groupBy("scene").agg(F.greatest(*extents).alias("extent")).select("scene", F.when((F.col("extent") > 0) & (F.col("extent") < 10), 1000.0).otherwise(1.0).alias("scale"))
    return rows.join(scale, "scene").withColumn("tri", F.transform("tri", lambda x: x * F.col("scale"))).drop("scale")


def component_bounds(rows: DataFrame) -> DataFrame:
    """component, triangles, low_x..high_z."""
    axis = lambda n: F.array(*[F.col("tri")[3 * v + n] for v in range(3)])
    both = [(f(g(axis(n))).alias(f"{p}_{a}")) for n, a in enumerate("xyz") for p, f, g in (("low", F.min, F.array_min), ("high", F.max, F.array_max))]
    return rows.groupBy("component").agg(F.count("*").alias("triangles"), *both)


def transform(rows: DataFrame, m: list[list[float]]) -> DataFrame:
    """Triangles under a homogeneous 4 by 4 matrix, as column arithmetic."""
    cells = [m[r][0] * F.col("tri")[3 * v] + m[r][1] * F.col("tri")[3 * v + 1] + m[r][2] * F.col("tri")[3 * v + 2] + F.lit(float(m[r][3])) for v in range(3) for r in range(3)]
    return rows.withColumn("tri", F.array(*cells))


def ancestors(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """node, path of names from the root, from rows (node, parent, name).

    Every round a node's path takes in the path of the node it has got to, so a hierarchy of any depth takes as many rounds as
    its depth has binary digits. Nodes on a cycle, or below one, have no root and stay out; a missing parent ends a path.
    """
    from caloris.session import staged

    rows = staged(parents.select("node", F.col("parent").alias("up"), F.array("name").alias("path")))
    for _ in range(rows.count().bit_length() + 1):
        if rows.where("up IS NOT NULL").isEmpty():
            break
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        rows = staged(rows.join(above, "up", "left").select("node", F.col("next").alias("up"), F.concat(F.coalesce("head", F.array().cast("array<string>")), "path").alias("path")))
    return rows.where("up IS NULL").select("node", "path")
