"""The queries over whole tables against brute force on small fixtures."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pytest

from pyspark.sql import functions as F

from caloris import catalog
from caloris.functions.text import COLOUR_STOPS, hex_colour

BRANDS, TYPES = ("Brand#1", "Brand#2", "Brand#7"), ("SMALL", "PROMO", "ECONOMY")


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("small")
    # a third of the places of three layers, with every p_size from 1 to 50
    keys = [n for n in range(1, 1200) if n * 7919 % 101 < 34]
    pd.DataFrame({"p_partkey": keys, "p_size": [1 + n * 31 % 50 for n in keys], "p_brand": [BRANDS[n % 3] for n in keys], "p_type": [TYPES[n * 5 % 3] for n in keys]}).to_parquet(folder / "part.parquet")
    pd.DataFrame({"s_suppkey": range(1, 21)}).to_parquet(folder / "supplier.parquet")
    lines = [(n * 7 % 20 + 1, n * 13 % 30 + 1, n % 4 + 1, (n % 5) / 100) for n in range(120)]
    pd.DataFrame(lines, columns=["l_suppkey", "l_partkey", "l_linenumber", "l_discount"]).to_parquet(folder / "lineitem.parquet")
    pd.DataFrame({"n_nationkey": range(25), "n_name": [f"N{n}" for n in range(25)]}).to_parquet(folder / "nation.parquet")
    return str(folder)


def flood(small):
    """node_id -> component number of every part, largest component first, and each node's degree."""
    at = {(n % 20, n // 20 % 20, n // 400): n for n in pd.read_parquet(f"{small}/part.parquet").p_partkey}
    near = {n: [at[q] for a in range(3) for d in (-1, 1) if (q := tuple(x + d * (b == a) for b, x in enumerate(p))) in at] for p, n in at.items()}
    label = {}
    for n in sorted(near):
        todo = [n] if n not in label else []
        while todo:
            m = todo.pop()
            if m not in label:
                label[m] = n
                todo += near[m]
    order = {x: k for k, (x, _) in enumerate(sorted(Counter(label.values()).items(), key=lambda x: (-x[1], x[0])))}
    return {n: order[x] for n, x in label.items()}, {n: len(x) for n, x in near.items()}


def run(spark, small, name):
    return catalog.QUERIES[name](spark, small).collect()


def test_components_of_every_part(spark, small):
    want, _ = flood(small)
    assert {r.node_id: r.component_id for r in run(spark, small, "connected_components_all")} == want
    rows = {r.component_id: r for r in run(spark, small, "component_summary_all")}
    assert {c: r.node_count for c, r in rows.items()} == Counter(want.values())
    assert {c: r.heater_count for c, r in rows.items() if r.heater_count} == Counter(c for n, c in want.items() if n % 11 == 0)


def test_reports_of_every_part(spark, small):
    part, degree = flood(small)
    size = dict(pd.read_parquet(f"{small}/part.parquet").set_index("p_partkey").p_size)
    want = {}
    for n in part:
        tags = {"oversized_cell": size[n] > 10, "low_confidence": n % 4 == 0, "node_warning": n % 6 < 4, "isolated_node": not degree[n], "disconnected_component": part[n] > 0}
        tags |= {"invalid_heater": n % 11 == 0 and n % 22, "unpaired_heater": n % 11 == 0 and n % 33, "invalid_sensor": n % 13 == 0 and n % 26, "unpaired_sensor": n % 13 == 0 and n % 39}
        want[n] = {t for t, x in tags.items() if x}
    assert {r.node_id: {t for t in r.tags.split(",") if t} for r in run(spark, small, "warning_tags_all")} == want
    (quality,) = run(spark, small, "quality_score_all")
    assert quality.nodes == len(part) and all(quality[t] == sum(t in x for x in want.values()) for t in ("oversized_cell", "isolated_node", "invalid_sensor"))
    assert {r.nodes for r in run(spark, small, "oversized_summary_all") if r.reason is None} == {sum(s > 10 for s in size.values())}
    assert [r.node_id for r in run(spark, small, "largest_nodes_all")] == sorted(n for n in part if size[n] > 10)[:20]


def test_matrix_edges_and_neighbours_of_every_row(spark, small):
    lines = pd.read_parquet(f"{small}/lineitem.parquet")
    known = set(range(1, 21))
    want = Counter((a, b) for a, b, d in zip(lines.l_suppkey, lines.l_partkey, lines.l_discount, strict=True) if a < b and d > 0 and {a, b} <= known)
    assert {(r.node_i, r.node_j): r.edges for r in run(spark, small, "edges_from_matrix_all")} == want
    pairs = {(a % 40, b % 40) for a, b in zip(lines.l_suppkey, lines.l_partkey, strict=True)}
    both = {(a, b) for x in pairs for a, b in (x, x[::-1]) if a % 5 == 0 and b % 5}
    assert {(r.role_node, r.other) for r in run(spark, small, "body_neighbours_all")} == both


def test_the_colour_scale_meets_its_stops(spark):
    rows = spark.createDataFrame([(400.0 * t, c) for t, c in COLOUR_STOPS] + [(-5.0, "#d9d9d9"), (999.0, "#5a001f")], "t double, want string")
    got = rows.select("want", hex_colour(F.col("t"), F.lit(0.0), F.lit(400.0)).alias("got"), hex_colour(F.col("t"), F.lit(7.0), F.lit(7.0)).alias("middle")).collect()
    assert all(r.got == r.want for r in got) and {r.middle for r in got} == {"#5fb917"}


def test_surface_octree_reaches_every_layer(spark, tmp_path):
    # odd places lie inside a leaf of 20 mm; layers 1, 33 and 65 are under three different roots
    keys = [400 * k + 20 * j + i for k, j, i in ((1, 1, 1), (1, 5, 3), (33, 1, 1), (65, 7, 9), (65, 7, 11))]
    pd.DataFrame({"p_partkey": keys, "p_size": [50, 1, 20, 46, 30], "p_brand": "b", "p_type": "SMALL"}).to_parquet(tmp_path / "part.parquet")
    assert {r.level: r.solid for r in run(spark, str(tmp_path), "surface_octree") if r.solid} == {4: len(keys)}
