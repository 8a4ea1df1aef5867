"""Scalar geometry and heat-transfer functions as column expressions (SI units, lengths of cells in mm)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

STEFAN_BOLTZMANN = 5.670374419e-8
INTERFACE_W_M2K = 1.0e4
TOUCH_MM = 1.0e-7
Vec = Sequence[Column]


def gaps(amin: Vec, amax: Vec, bmin: Vec, bmax: Vec) -> list[Column]:
    """Signed gap of two boxes along each axis: negative where they overlap."""
    return [F.greatest(bl - ah, al - bh) for al, ah, bl, bh in zip(amin, amax, bmin, bmax, strict=True)]


def overlaps(amin: Vec, amax: Vec, bmin: Vec, bmax: Vec) -> list[Column]:
    return [F.least(ah, bh) - F.greatest(al, bl) for al, ah, bl, bh in zip(amin, amax, bmin, bmax, strict=True)]


def norm(parts: Vec) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def surface_gap(amin: Vec, amax: Vec, bmin: Vec, bmax: Vec) -> Column:
    """Distance between the surfaces of two boxes; 0 where they touch or overlap."""
    return norm([F.greatest(g, F.lit(0.0)) for g in gaps(amin, amax, bmin, bmax)])


def contact_conductance(k_a: Column, k_b: Column, area_mm2: Column, distance_mm: Column, interface: Column | None = None) -> Column:
    """Two half cells in series, with an interface between them if given; 0 for anything not positive and finite."""
    area, half = area_mm2 * 1e-6, distance_mm * 1e-3 * 0.5
    good = (area > 0) & (half > 0) & (k_a > 0) & (k_b > 0) & (area < float("inf")) & (half < float("inf"))
    resistance = half / (k_a * area) + half / (k_b * area)
    if interface is not None:
        good = good & (interface > 0)
        resistance = resistance + F.lit(1.0) / (interface * area)
    return F.coalesce(F.when(good & (resistance > 0), F.lit(1.0) / resistance), F.lit(0.0))


def cubic_conductance(k_a: Column, k_b: Column, side_a_m: Column, side_b_m: Column) -> Column:
    """Conductance of two touching cubes: half a side of each over the smaller face."""
    area = F.least(side_a_m, side_b_m) * F.least(side_a_m, side_b_m)
    good = (k_a > 0) & (k_b > 0) & (area > 0)
    return F.coalesce(F.when(good, F.lit(1.0) / (side_a_m * 0.5 / (k_a * area) + side_b_m * 0.5 / (k_b * area))), F.lit(0.0))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.lit(2.0) / (F.lit(1.0) / a + F.lit(1.0) / b)).otherwise(F.lit(0.0))


def in_slab(centre: Column, low: Column, high: Column, focus: Column, width: Column) -> Column:
    """Whether a centre lies within half the width of the focus, both as parts of the span from low to high."""
    return F.abs(F.when(high > low, (centre - low) / (high - low)).otherwise(F.lit(0.5)) - focus) <= width / 2


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment in the plane."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return norm([px - (ax + t * dx), py - (ay + t * dy)])


def opacity(base: Column, dimmed: Column, inside: Column) -> Column:
    """Opacity of what a focus dims."""
    return F.when(inside, base).otherwise(base * dimmed)


def radiation_linear(emissivity: Column, area_m2: Column, reference_K: float = 293.15) -> Column:
    """Linearised radiative conductance 4 e s A T^3."""
    return F.lit(4.0) * emissivity * STEFAN_BOLTZMANN * area_m2 * float(reference_K) ** 3


def radiation_coefficient(emissivity: Column, area_m2: Column, g_rad_w_k: Column, reference_K: Column) -> Column:
    """Coefficient e s A of the T^4 law; where area or emissivity is missing, that of the linear conductance G / (4 T^3)."""
    own = F.greatest(emissivity, F.lit(0.0)) * STEFAN_BOLTZMANN * F.greatest(area_m2, F.lit(0.0))
    linear = F.when(reference_K > 0, F.greatest(g_rad_w_k, F.lit(0.0)) / (4.0 * F.pow(reference_K, F.lit(3))))
    return F.coalesce(F.when(own > 0, own), linear, F.lit(0.0))


def radiation_power(emissivity: Column, area_m2: Column, temperature_K: Column, surroundings_K: Column) -> Column:
    """Power gained from the surroundings: e s A (Ts^4 - T^4)."""
    return emissivity * STEFAN_BOLTZMANN * area_m2 * (F.pow(surroundings_K, 4) - F.pow(temperature_K, 4))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, col(low)), col(high))


def cryocooler_power(temperature_K: Column, setpoint_K: Column, gain: Column, most_W: Column) -> Column:
    return clip(gain * (temperature_K - setpoint_K), 0.0, most_W)


def contact_resistance(side_a: Column, k_a: Column, side_b: Column, k_b: Column, area_m2: Column, interface_K_W: Column) -> Column:
    return side_a / 2 / (k_a * area_m2) + side_b / 2 / (k_b * area_m2) + interface_K_W


def pulse(time_s: Column, power: Column, start_s: Column, stop_s: Column) -> Column:
    """A heater that is on from start, and off from stop."""
    return F.when((time_s >= start_s) & (time_s < stop_s), power).otherwise(F.lit(0.0))


def crowded_margin(absolute_mm: Column, neighbours: Column, size_mm: Column) -> Column:
    """Refinement margin: an absolute distance if one is set, else a multiple of the cell."""
    return F.when(absolute_mm > 0, absolute_mm).otherwise(F.greatest(neighbours, F.lit(0.0)) * size_mm)


def acceptance_reason(surface: Column, inside: Column, near: Column, candidate: Column) -> Column:
    return (
        F.when(surface & inside, "surface_and_watertight_inside")
        .when(surface, "triangle_surface_intersection")
        .when(inside, "watertight_point_containment")
        .when(near, "near_surface_empty")
        .when(candidate, "bbox_only_empty")
        .otherwise("empty")
    )


def confidence(occupied: Column, surface: Column, inside: Column, fraction: Column, candidate: Column, min_solid: float) -> Column:
    return (
        F.when(~occupied, F.when(candidate, "low").otherwise("high"))
        .when(inside, "high")
        .when(surface & (F.coalesce(fraction, F.lit(0.0)) >= min_solid), "medium")
        .otherwise("low")
    )


def refinement_score(
    *, role: Column, gap: Column, multi: Column, complex_: Column, crowded: Column, parts: Column, materials: Column, contrast: Column, surface_needed: Column,
    occupied: Column, bbox_only: Column, inside: Column, surface: Column, near_count: Column, crowded_count: Column, tests: Column, size_mm: Column, max_size_mm: float,
) -> Column:
    """Priority of a cell in adaptive refinement: weighted reasons, never below zero."""
    on = lambda c, v: F.when(c, v).otherwise(F.lit(0.0))
    near, crowd, t = near_count.cast("double"), crowded_count.cast("double"), tests.cast("double")
    score = (
        on(role, F.lit(120.0)) + on(gap, 7500.0 + 250.0 * near) + on(multi, 90.0 + 5.0 * near) + on(complex_, F.least(F.lit(80.0), 10.0 + 0.25 * t))
        + on(crowded, 30.0 + 2.0 * crowd) + on(parts, F.lit(45.0)) + on(materials, F.lit(35.0)) + on(contrast, F.lit(25.0)) + on(surface_needed, F.lit(20.0))
        + on(occupied & (size_mm > max_size_mm), 10000.0 + 100.0 * size_mm / max(max_size_mm, 1e-9)) + on(bbox_only, F.lit(5.0)) - on(inside & ~surface & (near_count <= 1), F.lit(15.0))
    )
    return F.greatest(F.lit(0.0), score)
