"""All registered queries of the thermal-graph engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caloris.plans import control_queries, controller_queries, editing_queries, geometry_queries, graph_queries, matrix_queries, simulation_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (geometry_queries, graph_queries, control_queries, controller_queries, editing_queries, matrix_queries, simulation_queries, text_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
