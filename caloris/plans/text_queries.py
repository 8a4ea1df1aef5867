"""Queries over names and texts: normalisers, role kinds, material inference, formats, node look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caloris.functions import text as X
from caloris.operators import materials
from caloris.plans import views
from caloris.plans.registry import Registry
from caloris.plans.views import sql

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, replace(replace(replace(p_name, '\\', '/'), '-', '_'), ' ', '_') AS normal, lower(replace(replace(replace(p_brand || '-' || p_name, '\\', '/'), '-', '_'), ' ', '_')) AS key,
    CASE WHEN regexp_matches(p_name, '(?i)red|ring') AND NOT regexp_matches(p_name, '(?i)blue|bolt') THEN 'heater' WHEN regexp_matches(p_name, '(?i)blue|bolt') AND NOT regexp_matches(p_name, '(?i)red|ring') THEN 'sensor' END AS kind FROM part""")
def role_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), X.normalise_name(n).alias("normal"), X.match_key(F.concat_ws("-", "p_brand", n)).alias("key"), X.role_kind(n, ["red", "ring"], ["blue", "bolt"]).alias("kind"))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS id, 'heater' || CASE WHEN s_suppkey % 2 = 0 THEN '_' ELSE '/x_' END || (s_suppkey % 7) AS bare, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'heater' ELSE 'sensor' END AS kind FROM supplier""")
def role_group_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid suffixes stripped, and kinds along a hierarchy path."""
    s = F.col("s_suppkey").cast("long")
    name = F.concat(F.when(s % 2 == 0, "heater ").otherwise("heater\\x-"), (s % 7).cast("string"), F.when(s % 2 == 0, " mesh-body").otherwise("_Solid"))
    path = F.array(F.lit("root"), F.when(s % 3 == 0, "skip_me").otherwise("group"), F.when(s % 2 == 0, "heater_a").otherwise("sensor_b"), F.lit("sensor_c"))
    return views.table(spark, sf_dir, "supplier").select(s.alias("id"), X.strip_solid_suffix(name).alias("bare"), X.path_role_kind(path, ["heater"], ["sensor"], ["skip"]).alias("kind"))


_KNOWN = [m[0] for m in materials.SEED]


@query("""WITH parts AS (SELECT DISTINCT p_brand || '-' || (p_size % 7) AS part, CASE p_size % 7 WHEN 0 THEN 'Copper' WHEN 1 THEN 'not assigned' WHEN 3 THEN 'SHCS 18-8SS x' WHEN 4 THEN 'mystery' WHEN 5 THEN 'AISI 304' WHEN 6 THEN 'unknown' END AS mesh FROM part
      UNION ALL SELECT DISTINCT p_brand, NULL FROM part),
    report AS (SELECT DISTINCT p_brand || '-' || (p_size % 3) AS part, CASE WHEN p_brand IN ('Brand#1', 'Brand#3') THEN CASE WHEN p_size % 3 = 0 THEN 'Copper' ELSE 'Phenolic' END ELSE 'Invar36' END AS material FROM part),
    al AS (SELECT part AS alias, material FROM report UNION ALL SELECT split_part(part, '-', 1), max(material) FROM report GROUP BY split_part(part, '-', 1) HAVING count(DISTINCT material) = 1)
    SELECT part, CASE WHEN mesh IN ('Copper', 'AISI 304') THEN mesh WHEN material IS NOT NULL THEN material WHEN mesh = 'SHCS 18-8SS x' THEN '18-8 Stainless Steel' ELSE '6061-T6 Aluminum' END AS material,
      CASE WHEN mesh IN ('Copper', 'AISI 304') THEN 'mesh' WHEN material IS NOT NULL THEN 'report' WHEN mesh = 'SHCS 18-8SS x' THEN 'text' ELSE 'default' END AS origin
    FROM parts LEFT JOIN al ON alias = part""")
def material_resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, b, s = views.table(spark, sf_dir, "part"), F.col("p_brand"), F.col("p_size")
    mesh = F.element_at(F.create_map(*[x for k, v in ((0, "Copper"), (1, "not assigned"), (3, "SHCS 18-8SS x"), (4, "mystery"), (5, "AISI 304"), (6, "unknown")) for x in (F.lit(k).cast("long"), F.lit(v))]), (s % 7).cast("long"))
    parts = p.select(F.concat_ws("-", b, (s % 7).cast("string")).alias("part"), mesh.alias("mesh_material")).distinct().unionByName(p.select(b.alias("part"), F.lit(None).cast("string").alias("mesh_material")).distinct())
    material = F.when(b.isin("Brand#1", "Brand#3"), F.when(s % 3 == 0, "Copper").otherwise("Phenolic")).otherwise("Invar36")
    report = p.select(F.concat_ws("-", b, (s % 3).cast("string")).alias("part"), material.alias("material")).distinct()
    return materials.resolve_chain(parts, report, _KNOWN)


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, 'o_' || o_orderpriority AS dummy, regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe,
    CASE WHEN o_totalprice >= 1024 THEN printf('%.1f KiB', round(o_totalprice / 1024, 1)) ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) || ' B' END AS size_text, round(o_totalprice - 273.15, 6) AS celsius,
    translate(regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', ''), '-.', 'mp') AS token  FROM orders""")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit("o_"), "o_orderpriority").alias("dummy"), X.safe_name(F.col("o_orderpriority")).alias("safe"), X.format_bytes(price).alias("size_text"), F.round(X.celsius(price), 6).alias("celsius"), X.number_token(price, 2).alias("token"))


def _channel(k: int) -> str:
    """SQL of one channel of the colour scale at t, between 0 and 1."""
    cases = " ".join(f"WHEN t <= {b}::DOUBLE THEN (1 - (t - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE)) * ({int(x[k : k + 2], 16)} / 255.0::DOUBLE) + (t - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE) * ({int(y[k : k + 2], 16)} / 255.0::DOUBLE)" for (a, x), (b, y) in zip(X.COLOUR_STOPS, X.COLOUR_STOPS[1:], strict=False))
    return f"CAST(round_even(255 * CASE {cases} END, 0) AS INTEGER)"


@query(f"""SELECT id, printf('#%02x%02x%02x', {_channel(1)}, {_channel(3)}, {_channel(5)}) AS colour, 'kind: ' || event_type || chr(10) || 'id: ' || id AS tip
    FROM (SELECT CAST(event_id AS BIGINT) AS id, event_type, least(greatest((value - 20) / 400.0::DOUBLE, 0), 1) AS t FROM events)""")
def colour_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's value as a temperature between 20 and 420, on the thermal colour scale."""
    e = views.table(spark, sf_dir, "events")
    i = F.col("event_id").cast("long")
    return e.select(i.alias("id"), X.hex_colour(F.col("value"), F.lit(20.0), F.lit(420.0)).alias("colour"), X.tooltip(("kind", F.col("event_type")), ("id", i), ("none", F.lit(None).cast("string"))).alias("tip"))


_TEXTS = (" zero MATTER ", "Not assigned", "copper", "rod, COPPER 1/2", "plate 6061 - T6", "x 18_8 ss", "AL bracket", "aluminum", "invar 36 ring", "INVAR rod", "nylon", "304 SS sheet", "aisi 304", "al36")


@query(f"""WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS id, ({[*_TEXTS]})[1 + p_partkey % {len(_TEXTS)}] || CASE WHEN p_size % 4 = 0 THEN ' P' || p_size ELSE '' END AS text FROM part), m(name) AS (VALUES {", ".join(f"('{k}')" for k in [m[0] for m in materials.SEED])}),
    n AS (SELECT id, lower(trim(text)) AS bare, regexp_replace(upper(text), '[^A-Z0-9-]+', ' ', 'g') AS norm FROM t)
    SELECT id, coalesce(max(CASE WHEN lower(name) NOT IN ('not assigned') THEN name END), CASE {" ".join(f"WHEN regexp_matches(any_value(norm), '{p}') THEN '{m}'" for p, m in X.MATERIAL_PATTERNS)} END) AS material
    FROM n LEFT JOIN m ON lower(name) = bare GROUP BY id""")
def material_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials from texts: exact names whatever the case, then the ordered patterns."""
    p = views.table(spark, sf_dir, "part")
    text = F.concat(F.element_at(F.array(*[F.lit(x) for x in _TEXTS]), (1 + F.col("p_partkey") % len(_TEXTS)).cast("int")), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" P"), F.col("p_size").cast("string"))).otherwise(""))
    return p.select(F.col("p_partkey").cast("long").alias("id"), X.infer_material(text, _KNOWN).alias("material"))


@query(sql("cells", "SELECT component, count(*) FILTER (lower(material) LIKE '%mall%') AS matches, CAST(min(CASE WHEN component = 'Brand#7' THEN node_id END) AS BIGINT) AS first_hit FROM cells GROUP BY component"))
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search over node texts, first hit by id."""
    c = views.cells(spark, sf_dir)
    return c.groupBy("component").agg(F.count_if(X.match_key(F.col("material")).contains("mall")).alias("matches"), F.min(F.when(F.col("component") == "Brand#7", F.col("node_id"))).alias("first_hit"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_size % 5 = 0 THEN 'P' || (100 + p_size) END AS code FROM part")
def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    name = F.when(s % 5 == 0, F.concat(F.lit("x P"), (100 + s).cast("string"), F.lit(" y"))).otherwise("P12 z")
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), X.part_code(name).alias("code"))
