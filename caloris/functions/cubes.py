"""Two cubes: their sizes, the face they share, the patch of contact, and checks of their parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Vec = Sequence[Column]


def sizes(side_m: Column, mass_kg: Column, cp_j_kgk: Column) -> dict[str, Column]:
    """Heat capacity, area of a face, volume."""
    return {"capacity_j_k": mass_kg * cp_j_kgk, "face_m2": side_m * side_m, "volume_m3": side_m * side_m * side_m}


def bounds(centre: Vec, side_m: Column) -> tuple[list[Column], list[Column]]:
    return [c - side_m * 0.5 for c in centre], [c + side_m * 0.5 for c in centre]


def _common(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> list[Column]:
    return [F.greatest(F.least(ah, bh) - F.greatest(al, bl), F.lit(0.0)) for al, ah, bl, bh in zip(*a, *b, strict=True)]


def _touching(a: tuple[Vec, Vec], b: tuple[Vec, Vec], tolerance_m: float) -> list[Column]:
    return [(F.abs(ah - bl) <= tolerance_m) | (F.abs(bh - al) <= tolerance_m) for al, ah, bl, bh in zip(*a, *b, strict=True)]


def face_overlap(a: tuple[Vec, Vec], b: tuple[Vec, Vec], tolerance_m: float = 1e-9) -> Column:
    """Area that two boxes share on the first axis along which faces touch and overlap; 0 without one."""
    common = _common(a, b)
    area = [common[1] * common[2], common[0] * common[2], common[0] * common[1]]
    return F.coalesce(*[F.when(t & (x > 0), x) for t, x in zip(_touching(a, b, tolerance_m), area, strict=True)], F.lit(0.0))


def contact_patch(a: tuple[Vec, Vec], b: tuple[Vec, Vec], tolerance_m: float = 1e-9, thickness_m: float = 0.0) -> Column:
    """The shared face as a box (low, high: arrays of x, y, z), as thick as asked for along its axis; null without one."""
    common, touching = _common(a, b), _touching(a, b, tolerance_m)
    area = [common[1] * common[2], common[0] * common[2], common[0] * common[1]]
    out = F.lit(None).cast("struct<low:array<double>,high:array<double>>")
    for k in (2, 1, 0):
        at = F.when(F.abs(a[1][k] - b[0][k]) <= tolerance_m, a[1][k]).otherwise(a[0][k])
        low = [at - thickness_m / 2 if n == k else F.greatest(a[0][n], b[0][n]) for n in range(3)]
        high = [at + thickness_m / 2 if n == k else F.least(a[1][n], b[1][n]) for n in range(3)]
        out = F.when(touching[k] & (area[k] > 0), F.struct(F.array(*low).alias("low"), F.array(*high).alias("high"))).otherwise(out)
    return out


def faults(side_m: Column, mass_kg: Column, cp_j_kgk: Column, k_w_mk: Column, resistance_k_w: Column, end_s: Column, step_s: Column) -> Column:
    """Which parameters of a cube and of its simulation are not positive, in order."""
    checks = (("side_length", side_m), ("mass", mass_kg), ("specific_heat", cp_j_kgk), ("thermal_conductivity", k_w_mk), ("contact_resistance", resistance_k_w), ("t_end", end_s), ("time_step", step_s))
    return F.array_compact(F.array(*[F.when(~F.coalesce(c > 0, F.lit(False)), F.lit(n)) for n, c in checks]))


def corner_to_centre(corner: Vec, side_m: Column) -> list[Column]:
    """Centre of a cube that an older layout gives by its least corner."""
    return [c + side_m * 0.5 for c in corner]
