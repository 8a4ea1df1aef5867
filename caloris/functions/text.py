"""Scalar text functions: names, roles, materials, formatting. All are JVM-side column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Names that count as no material.
UNASSIGNED = ("", "default_unknown", "not assigned", "none", "null", "unknown", "unknown material", "unassigned")
#: Ordered patterns over normalised text and the material each names.
MATERIAL_PATTERNS = (
    (r"\b18\s*[-_]?\s*8\s*SS\b", "18-8 Stainless Steel"),
    (r"\b18\s*[-_]?\s*8\s*STAINLESS\b", "18-8 Stainless Steel"),
    (r"\b304\s*SS\b", "AISI 304 Stainless Steel"),
    (r"\bAISI\s*304\b", "AISI 304 Stainless Steel"),
    (r"\b17\s*[-_]?\s*7\s*PH\b", "17-7PH Stainless Steel"),
    (r"\b17\s*[-_]?\s*7\b", "17-7PH Stainless Steel"),
    (r"\b6061\s*[-_]?\s*T6\b", "6061-T6 Aluminum"),
    (r"\b6061\b", "6061-T6 Aluminum"),
    (r"\bAL(?:UMINUM)?\b", "6061-T6 Aluminum"),
    (r"\bCOPPER\b", "Copper"),
    (r"\bCU\b", "Copper"),
    (r"\bINVAR\s*36\b", "Invar36"),
    (r"\bINVAR\b", "Invar, AL 36"),
    (r"\bDELRIN\b", "Delrin 2700 NC010, Low Viscosity Acetal Copolymer (SS)"),
    (r"\bPHENOLIC\b", "Phenolic"),
)
#: Stops of the thermal colour scale, from cold to hot.
COLOUR_STOPS = ((0.0, "#d9d9d9"), (0.12, "#4b00b5"), (0.25, "#0000cc"), (0.42, "#00a52a"), (0.6, "#d6d100"), (0.75, "#c46a00"), (0.9, "#b00020"), (1.0, "#5a001f"))


def normalise_name(c: Column) -> Column:
    """Backslashes to slashes, dashes and spaces to underscores; case stays."""
    return F.translate(c, "\\- ", "/__")


def match_key(c: Column) -> Column:
    return F.lower(normalise_name(c))


def strip_solid_suffix(c: Column) -> Column:
    """The normalised name without trailing _geometry, _mesh, _body or _solid, however many; a name made of them alone stays."""
    bare = F.regexp_replace(normalise_name(c), "(?i)(_geometry|_mesh|_body|_solid)+$", "")
    return F.when(bare == "", c).otherwise(bare)


def normalise_material_text(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9-]+", " ")


def is_unassigned(c: Column) -> Column:
    """No material name: null, or one of the fixed placeholders whatever its case and outer blanks."""
    return c.isNull() | F.lower(F.trim(c)).isin(*UNASSIGNED)


def infer_material(c: Column, known: Sequence[str]) -> Column:
    """A known material whose name the text is (whatever the case and outer blanks, of several the first; placeholders do not
    count), else that of the first pattern that fits and whose material is known; null if none does."""
    names = {k.casefold(): k for k in reversed(known) if k.strip().lower() not in UNASSIGNED}
    exact = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.trim(c))) if names else F.lit(None).cast("string")
    text = normalise_material_text(c)
    return F.coalesce(exact, *[F.when(text.rlike(p), F.lit(m)) for p, m in MATERIAL_PATTERNS if m in known], F.lit(None).cast("string"))


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns occurs, whatever the case; null text matches none."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(c.rlike(f"(?i){p}"), F.lit(False))
    return out


def role_kind(c: Column, heater: Sequence[str], sensor: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """'heater', 'sensor' or null by case-insensitive patterns; a name that is both is null, an excluded one too."""
    h, s, x = (matches_any(c, ps) for ps in (heater, sensor, exclude))
    return F.when(x | (h & s), None).when(h, "heater").when(s, "sensor")


def strict_role_kind(c: Column, heater: Sequence[str], sensor: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """role_kind that fails on names that match both roles."""
    both = matches_any(c, heater) & matches_any(c, sensor) & ~matches_any(c, exclude)
    return F.when(both, F.raise_error(F.concat(F.lit("ambiguous role name: "), c))).otherwise(role_kind(c, heater, sensor, exclude))


def path_role_kind(path: Column, heater: Sequence[str], sensor: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """The kind of the first part of a path that has one; excluded if the joined path is."""
    kinds = F.filter(F.transform(path, lambda p: role_kind(p, heater, sensor)), lambda k: k.isNotNull())
    return F.when(~matches_any(F.array_join(path, "/"), exclude), F.try_element_at(kinds, F.lit(1)))


def part_code(c: Column) -> Column:
    found = F.regexp_extract(c, r"(P\d{3,5})", 1)
    return F.when(found != "", found)


def safe_name(c: Column, default: str = "run") -> Column:
    name = F.trim(F.translate(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "", ""))
    name = F.regexp_replace(name, r"^_+|_+$", "")
    return F.when(name == "", F.lit(default)).otherwise(name)


def number_token(c: Column, digits: int = 6) -> Column:
    """A number as part of a file name: - becomes m, . becomes p, trailing zeros go."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", c.cast("double")), r"\.?0+$", "")
    return F.translate(text, "-.", "mp")


def format_bytes(c: Column) -> Column:
    """Bytes with a unit of 1024 steps and one decimal."""
    out = F.concat(c.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(c >= 1024.0**power, F.format_string(f"%.1f {unit}", F.round(c / F.lit(1024.0**power), 1))).otherwise(out)
    return out


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def hex_colour(value: Column, low: Column, high: Column) -> Column:
    """Piecewise-linear colour of a value between low and high as #rrggbb; an empty range gives the middle."""
    t = F.when(high > low, F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))
    channels = []
    for k in (1, 3, 5):
        stops = [(at, int(colour[k : k + 2], 16) / 255.0) for at, colour in COLOUR_STOPS]
        out = F.lit(stops[-1][1])
        for (a, x), (b, y) in reversed([*zip(stops, stops[1:], strict=False)]):
            part = (t - a) / (b - a)
            out = F.when(t <= b, (1.0 - part) * x + part * y).otherwise(out)
        channels.append(F.bround(out * 255.0, 0).cast("int"))
    return F.format_string("#%02x%02x%02x", *channels)


def tooltip(*parts: tuple[str, Column]) -> Column:
    """Lines 'label: value' of the parts that are not null."""
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string"))) for label, c in parts])


def normalised(value: Column, low: Column, high: Column) -> Column:
    """A value's place between low and high, from 0 to 1; the middle of an empty range."""
    return F.when(high > low, F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.5))


def whole_number(c: Column) -> Column:
    """A text as a whole number, null if it is none."""
    return F.when(c.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim(c).cast("long"))


def number(c: Column) -> Column:
    """A text as a number, null if it is none or NaN."""
    found = F.trim(c).try_cast("double")
    return F.when(~F.isnan(found), found)


def whole_numbers(c: Column) -> Column:
    """The whole numbers among the texts of an array, in order; none for null."""
    return F.coalesce(F.filter(F.transform(c, whole_number), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def edge_mode(c: Column) -> Column:
    """'loaded_G' for its old and new names, else 'auto'."""
    return F.when(F.trim(c).isin("loaded_G", "loaded_matrix"), "loaded_G").otherwise("auto")


def grid_coordinate(c: Column) -> Column:
    """'(i, j, k)' or 'i,j,k' as three whole numbers, null for anything else."""
    parts = F.split(F.regexp_replace(c, r"[()\s]", ""), ",")
    return F.when(c.rlike(r"^\s*\(?\s*-?[0-9]{1,9}\s*,\s*-?[0-9]{1,9}\s*,\s*-?[0-9]{1,9}\s*\)?\s*$"), F.transform(parts, lambda x: x.cast("long")))


def role_path_candidates(hierarchy: Column, scene_path: Column) -> Column:
    """The paths along which a component's role is looked for: its hierarchy, and the first word of its scene path."""
    some = lambda p: F.filter(p, lambda x: x.isNotNull() & (x != ""))
    scene = some(F.split(F.translate(F.element_at(F.split(F.coalesce(scene_path, F.lit("")), " "), 1), "\\", "/"), "/"))
    paths = F.array(some(F.coalesce(hierarchy, F.array().cast("array<string>"))), scene)
    return F.array_distinct(F.filter(paths, lambda p: F.size(p) > 0))


def hierarchy_group(paths: Column, kind: str, heater: Sequence[str], sensor: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Name of the group that a component of a kind belongs to, over its candidate paths; null if none says.

    On each path the first part of that kind counts: alone if it holds a #, else with all parts before it. A match with
    parts below it beats one without, then the one nearer the root, then the larger name.
    """

    def match(path: Column) -> Column:
        kinds = F.transform(path, lambda p: F.coalesce(role_kind(normalise_name(p), heater, sensor, exclude), F.lit("")) == kind)
        at = F.array_position(kinds, True).cast("int")
        name = F.when(F.element_at(path, F.greatest(at, F.lit(1))).contains("#"), F.element_at(path, F.greatest(at, F.lit(1)))).otherwise(F.array_join(F.slice(path, 1, F.greatest(at, F.lit(1))), "/"))
        return F.when((F.size(path) >= 2) & (at > 0), F.struct((at < F.size(path)).cast("int").alias("below"), (-at).alias("near"), normalise_name(name).alias("name")))

    return F.array_max(F.filter(F.transform(paths, match), lambda x: x.isNotNull()))["name"]
