"""Readers and writers of graph folders, sparse matrices, trajectories and gain runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_NODE = "node_id string, id string, component_name string, component string, material_name string, material string, center_mm array<double>, size_mm array<double>, level int, confidence string, warnings array<string>, C_J_K double, initial_temperature_K double, is_heater boolean, is_sensor boolean, coord array<int>"
_EDGE = "edge_id string, node_i string, node_j string, edge_type string, G_W_K double, shared_area_m2 double, distance_m double, contact_confidence string, source string"


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph.json: aliases of column names are merged, bad values become null."""
    raw = spark.read.schema(f"graph_nodes array<struct<{_fields(_NODE)}>>, graph_edges array<struct<{_fields(_EDGE)}>>").option("multiLine", True).json(f"{folder}/graph.json")
    n = raw.select(F.explode("graph_nodes").alias("n")).select("n.*")
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    nodes = n.select(
        F.coalesce(number("node_id"), number("id")).alias("node_id"), F.coalesce("component_name", "component").alias("component"), F.coalesce("material_name", "material").alias("material"),
        *[F.try_element_at("center_mm", F.lit(k + 1)).alias(f"c{a}") for k, a in enumerate("xyz")], *[F.try_element_at("size_mm", F.lit(k + 1)).alias(f"s{a}") for k, a in enumerate("xyz")],
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("confidence", F.lit("high")).alias("confidence"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.col("C_J_K").alias("capacity_j_k"), F.coalesce("initial_temperature_K", F.lit(293.15)).alias("temperature_k"), F.coalesce("is_heater", F.lit(False)).alias("is_heater"), F.coalesce("is_sensor", F.lit(False)).alias("is_sensor"),
    )
    e = raw.select(F.posexplode("graph_edges").alias("ordinal", "e")).select("ordinal", "e.*")
    edges = e.select("ordinal", "edge_id", number("node_i").alias("node_i"), number("node_j").alias("node_j"), "edge_type", F.col("G_W_K").alias("g_w_k"), "shared_area_m2", "distance_m", "contact_confidence", "source")
    return nodes.where("node_id IS NOT NULL"), edges


def _fields(ddl: str) -> str:
    return ", ".join(f"{x.split(' ', 1)[0]}: {x.split(' ', 1)[1]}" for x in ddl.split(", "))


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph as two Parquet tables; each is committed by Spark's own committer."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """COO rows (row, col, value) of {shape, format: coo, row, col, data}; fails on other formats and unequal lengths."""
    raw = spark.read.schema("shape array<int>, format string, row array<bigint>, col array<bigint>, data array<double>").option("multiLine", True).json(path)
    fine = (F.col("format") == "coo") & (F.size("row") == F.size("col")) & (F.size("row") == F.size("data"))
    checked = raw.withColumn("data", F.when(F.coalesce(fine, F.lit(False)), F.col("data")).otherwise(F.raise_error(F.lit("not a COO matrix"))))
    return checked.select(F.inline(F.arrays_zip(F.col("row"), F.col("col"), F.col("data").alias("value")))).toDF("row", "col", "value")


def write_sparse(coo: DataFrame, path: str) -> None:
    coo.write.mode("overwrite").parquet(path)


def flatten(df: DataFrame, column: str) -> DataFrame:
    """A struct column as columns named column_field."""
    fields = df.select(f"{column}.*").columns
    return df.select(*[c for c in df.columns if c != column], *[F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields])


def write_csv(df: DataFrame, path: str) -> None:
    for name, kind in df.dtypes:
        if kind.startswith("struct"):
            df = flatten(df, name)
    text: list[Column] = [F.to_json(F.struct(n)).alias(n) if k.startswith(("array", "map")) else F.col(n) for n, k in df.dtypes]
    df.select(*text).write.mode("overwrite").option("header", True).csv(path)


def write_trajectory(trajectory: DataFrame, folder: str) -> None:
    """The trajectory, and its least, greatest and mean temperature at each step."""
    from caloris.operators.simulate import trajectory_stats

    trajectory.write.mode("overwrite").partitionBy("step").parquet(f"{folder}/trajectory")
    trajectory_stats(trajectory).write.mode("overwrite").parquet(f"{folder}/temperature_stats")


def save_gains(gains: DataFrame, folder: str, name: str) -> str:
    """A gain matrix as a run of its own; returns the run's id."""
    run = f"{name}-{uuid.uuid4().hex[:8]}"
    gains.withColumns({"run": F.lit(run), "created_at": F.current_timestamp()}).write.mode("append").partitionBy("run").parquet(f"{folder}/gains")
    return run


def list_gains(spark: SparkSession, folder: str) -> DataFrame:
    """Runs, newest first."""
    rows = spark.read.parquet(f"{folder}/gains").groupBy("run").agg(F.max("created_at").alias("created_at"), F.count("*").alias("cells"))
    return rows.orderBy(F.desc("created_at"), F.desc("run"))


def load_gains(spark: SparkSession, folder: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/gains").where(F.col("run") == run).select("sensor_id", "heater_id", "gain")


def update_gains(gains: DataFrame, folder: str, run: str) -> None:
    """Replace the gains of one run; the others stay."""
    rows = gains.withColumns({"run": F.lit(run), "created_at": F.current_timestamp()})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{folder}/gains")


def temperature_payload(nodes: DataFrame) -> DataFrame:
    """One row: the initial temperatures by node id (as text), as parameters are kept."""
    return nodes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("node_id").cast("string"), "temperature_k")))).alias("initial_temperature_by_node_K"))


def apply_payload(nodes: DataFrame, payload: DataFrame) -> tuple[DataFrame, int]:
    """nodes with the temperatures of a payload (ids and temperatures as text), and how many nodes it named."""
    given = payload.select(F.explode("initial_temperature_by_node_K").alias("id", "t")).select(F.expr("try_cast(id AS bigint)").alias("node_id"), F.expr("try_cast(t AS double)").alias("temperature_k")).where("node_id IS NOT NULL AND temperature_k IS NOT NULL")
    return apply_temperatures(nodes, given), nodes.join(given, "node_id", "left_semi").count()


def overlay_tags(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """nodes with their tag map overlaid by key: what `tags` (node_id, tags) says wins."""
    more = tags.withColumnRenamed("tags", "_more")
    kept = F.map_filter("tags", lambda k, _: ~F.array_contains(F.map_keys("_more"), k))
    return nodes.join(more, "node_id", "left").withColumn("tags", F.when(F.col("_more").isNull(), F.col("tags")).otherwise(F.map_concat(kept, F.col("_more")))).drop("_more")


def apply_temperatures(nodes: DataFrame, given: DataFrame) -> DataFrame:
    """nodes with the initial temperatures given for their ids; the others keep theirs."""
    g = given.select("node_id", F.col("temperature_k").alias("_t"))
    return nodes.join(g, "node_id", "left").withColumn("temperature_k", F.coalesce("_t", "temperature_k")).drop("_t")
