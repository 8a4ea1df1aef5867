"""Material tables and the ordered look-ups that give each part a material."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caloris.functions.text import infer_material, is_unassigned

#: Name, density kg/m3, heat capacity J/kgK, conductivity W/mK, emissivity.
SEED = (
    ("17-7PH Stainless Steel", 7800.0, 460.0, 16.0, 0.35),
    ("18-8 Stainless Steel", 8000.0, 500.0, 16.2, 0.35),
    ("6061-T6 (SS)", 2700.0, 896.0, 167.0, 0.09),
    ("6061-T6 Aluminum", 2700.0, 896.0, 167.0, 0.09),
    ("AISI 304", 8000.0, 500.0, 16.2, 0.35),
    ("AISI 304 Stainless Steel", 8000.0, 500.0, 16.2, 0.35),
    ("Copper", 8960.0, 385.0, 401.0, 0.35),
    ("Delrin 2700 NC010, Low Viscosity Acetal Copolymer (SS)", 1410.0, 1460.0, 0.31, 0.85),
    ("Invar, AL 36", 8050.0, 515.0, 13.0, 0.30),
    ("Invar36", 8050.0, 515.0, 13.0, 0.30),
    ("Not assigned", 2200.0, 800.0, 2.0, 0.85),
    ("Phenolic", 1350.0, 1400.0, 0.30, 0.85),
    ("ZERO MATTER", 1.0, 1.0, 1.0e-9, 0.0),
)
DEFAULT_NAME, FALLBACK = "6061-T6 Aluminum", ("default_unknown", 2200.0, 800.0, 2.0, 0.85)
_SCHEMA = "name string, density_kg_m3 double, cp_j_kgk double, k_w_mk double, emissivity double"


def seed_table(spark: SparkSession, rows: Sequence[tuple] = SEED) -> DataFrame:
    return spark.createDataFrame([FALLBACK, *rows], _SCHEMA).withColumn("rho_cp", F.col("density_kg_m3") * F.col("cp_j_kgk"))


def read_material_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid and skipped rows of a JSON list of materials; rho_kg_m3 stands in for density_kg_m3."""
    fields = "name string, density_kg_m3 string, rho_kg_m3 string, cp_J_kgK string, k_W_mK string, emissivity string, _corrupt_record string"
    raw = spark.read.schema(fields).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    number = lambda c: F.expr(f"try_cast({c} as double)")
    rows = raw.select("name", F.coalesce(number("density_kg_m3"), number("rho_kg_m3")).alias("density_kg_m3"), number("cp_J_kgK").alias("cp_j_kgk"), number("k_W_mK").alias("k_w_mk"), F.coalesce(number("emissivity"), F.when(F.col("emissivity").isNull(), F.lit(0.85))).alias("emissivity"))
    good = F.coalesce(F.col("name").isNotNull() & F.col("density_kg_m3").isNotNull() & F.col("cp_j_kgk").isNotNull() & F.col("k_w_mk").isNotNull() & F.col("emissivity").isNotNull(), F.lit(False))
    return rows.where(good).withColumn("rho_cp", F.col("density_kg_m3") * F.col("cp_j_kgk")), rows.where(~good)


def merge_library(base: DataFrame, own: DataFrame) -> DataFrame:
    """A library over defaults: by name, each missing value from the default of that name."""
    b, o = base.alias("b"), own.alias("o")
    cols = [c for c in base.columns if c not in ("name", "rho_cp")]
    out = b.join(o, F.col("b.name") == F.col("o.name"), "full").select(F.coalesce("o.name", "b.name").alias("name"), *[F.coalesce(f"o.{c}", f"b.{c}").alias(c) for c in cols])
    return out.withColumn("rho_cp", F.col("density_kg_m3") * F.col("cp_j_kgk"))


def resolve(rows: DataFrame, materials: DataFrame, column: str = "material", default: str = DEFAULT_NAME) -> DataFrame:
    """Rows with their material's properties; an unknown or unassigned name gets the default and the flag fell_back."""
    m = materials.withColumnRenamed("name", "_name")
    usable = F.when(is_unassigned(F.col(column)), None).otherwise(F.col(column))
    known = m.select("_name").withColumnRenamed("_name", "_known")
    out = rows.withColumn("_wanted", usable).join(known, F.col("_wanted") == F.col("_known"), "left")
    out = out.withColumn("fell_back", F.col("_known").isNull()).withColumn("_use", F.coalesce("_known", F.lit(default)))
    return out.join(m, F.col("_use") == F.col("_name")).drop("_wanted", "_known", "_use").withColumnRenamed("_name", "resolved_material")


def defaults_for(rows: DataFrame, materials: DataFrame, fallback: str, column: str = "material") -> DataFrame:
    """rows with their material's properties by name whatever its case; an unknown name gets those of the fallback."""
    m = materials.groupBy(F.lower("name").alias("folded")).agg(F.min_by(F.struct("density_kg_m3", "cp_j_kgk", "k_w_mk", "emissivity"), "name").alias("own"))
    other = materials.where(F.col("name") == fallback).select(F.struct("density_kg_m3", "cp_j_kgk", "k_w_mk", "emissivity").alias("other")).limit(1)
    given = other.first()
    rest = F.struct(*[F.lit(given["other"][k] if given else None).cast("double").alias(k) for k in ("density_kg_m3", "cp_j_kgk", "k_w_mk", "emissivity")])
    out = rows.withColumn("folded", F.lower(column)).join(m, "folded", "left").withColumn("own", F.coalesce("own", rest))
    return out.select(*rows.columns, "own.*")


def heat_capacity(mass_kg: Column, cp_j_kgk: Column, own: Column, by_hand: Column) -> Column:
    """Mass times heat capacity, unless the value was set by hand."""
    return F.when(F.coalesce(by_hand, F.lit(False)), own).otherwise(mass_kg * cp_j_kgk)


def aliases(name: Column) -> Column:
    """A component's name and what is left after taking off up to three trailing -n or _n."""
    steps = [name]
    for _ in range(3):
        steps.append(F.regexp_replace(steps[-1], r"[-_]\d+$", ""))
    return F.array_distinct(F.filter(F.array(*steps), lambda x: x != ""))


def alias_table(report: DataFrame) -> DataFrame:
    """alias, material from (part, material): explicit names, and derived ones that lead to one material only."""
    explicit = report.groupBy("part").agg(F.max("material").alias("material")).select(F.col("part").alias("alias"), "material")
    derived = report.select(F.explode(aliases(F.col("part"))).alias("alias"), "material").groupBy("alias").agg(F.count_distinct("material").alias("n"), F.max("material").alias("material")).where("n = 1").drop("n")
    return explicit.unionByName(derived.join(explicit.select("alias"), "alias", "left_anti"))


def resolve_chain(parts: DataFrame, report: DataFrame, known: Sequence[str], default: str = DEFAULT_NAME) -> DataFrame:
    """part, material, origin: the mesh's own material, else the report's, else inferred from the material text, else from
    the name, else the default."""
    listed = F.array(*[F.lit(k) for k in known])
    rows = parts.join(alias_table(report).withColumnRenamed("material", "_report"), parts["part"] == F.col("alias"), "left")
    usable = lambda c: F.when(~is_unassigned(F.col(c)) & F.array_contains(listed, F.col(c)), F.col(c))
    mesh, from_report = usable("mesh_material"), usable("_report")
    by_text, by_name = infer_material(F.col("mesh_material"), known), infer_material(F.col("part"), known)
    origin = F.when(mesh.isNotNull(), "mesh").when(from_report.isNotNull(), "report").when(by_text.isNotNull(), "text").when(by_name.isNotNull(), "name").otherwise("default")
    return rows.select(parts["part"], F.coalesce(mesh, from_report, by_text, by_name, F.lit(default)).alias("material"), origin.alias("origin"))


def contrast(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, contrast: whether conductivity or volumetric capacity differ by the factor among a key's materials."""
    ratio = lambda c: F.when(F.count_if(F.col(c) > 0) >= 2, F.max(F.when(F.col(c) > 0, F.col(c))) / F.min(F.when(F.col(c) > 0, F.col(c))))
    return rows.groupBy(key).agg(F.coalesce((ratio("k_w_mk") >= threshold) | (ratio("rho_cp") >= threshold), F.lit(False)).alias("contrast"))
