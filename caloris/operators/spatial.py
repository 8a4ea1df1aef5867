"""Pairs of boxes that come near each other, as equi-joins on integer buckets.

Every box has a level, the power of two that its longest edge (grown by the padding) fits into, and lies in at most eight
buckets of its level's grid. A box is stored at its own level and looks for others at its own and all coarser levels that
occur, so a box a thousand times larger than the rest is still in eight buckets, and costs the rest one more level to look at.
A pair is taken only in the bucket that holds the lower corner of the two boxes' common part, so it comes out once without a
distinct. Low and high corners are columns low_x .. high_z.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

AXES = ("x", "y", "z")


def with_corners(boxes: DataFrame) -> DataFrame:
    """boxes (cx .. sz: centres and sizes) with their corners as columns of their own."""
    half = {a: F.col(f"s{a}") * 0.5 for a in AXES}
    return boxes.withColumns({f"low_{a}": F.col(f"c{a}") - half[a] for a in AXES} | {f"high_{a}": F.col(f"c{a}") + half[a] for a in AXES})


def _leveled(boxes: DataFrame, pad: float) -> DataFrame:
    edge = F.greatest(*[F.col(f"high_{a}") - F.col(f"low_{a}") for a in AXES]) + 2 * pad
    return boxes.withColumn("lvl", F.ceil(F.log2(F.greatest(edge, F.lit(1e-9)))).cast("int"))


def _levels(*boxes: DataFrame) -> list[int]:
    """The levels that occur: as few as there are powers of two between the smallest and the largest box."""
    found = set()
    for b in boxes:
        found |= {r["lvl"] for r in b.select("lvl").distinct().collect() if r["lvl"] is not None}
    return sorted(found)


def _stored(boxes: DataFrame, pad: float, prefix: str) -> DataFrame:
    return _placed(boxes.withColumn("at", F.col("lvl")), pad, prefix)


def _looking(boxes: DataFrame, pad: float, prefix: str, levels: Sequence[int], coarser_only: bool) -> DataFrame:
    own = F.col("lvl")
    wanted = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: (n > own) if coarser_only else (n >= own))
    return _placed(boxes.withColumn("at", F.explode(wanted)), pad, prefix)


def _placed(rows: DataFrame, pad: float, prefix: str) -> DataFrame:
    kept = [c for c in rows.columns if c != "at"]
    size = F.pow(F.lit(2.0), F.col("at"))
    for a in AXES:
        rows = rows.withColumn(f"k{a}", F.explode(F.sequence(F.floor((F.col(f"low_{a}") - pad) / size).cast("long"), F.floor((F.col(f"high_{a}") + pad) / size).cast("long"))))
    return rows.select(*[F.col(c).alias(f"{prefix}{c}") for c in kept], "at", *[f"k{a}" for a in AXES])


def _met(pairs: DataFrame, pad: float, p: str, q: str) -> DataFrame:
    """Pairs whose grown boxes meet, in the one bucket that counts."""
    size = F.pow(F.lit(2.0), F.col("at"))
    for a in AXES:
        corner = F.greatest(f"{p}low_{a}", f"{q}low_{a}") - pad
        pairs = pairs.where((corner <= F.least(f"{p}high_{a}", f"{q}high_{a}") + pad) & (F.floor(corner / size).cast("long") == F.col(f"k{a}")))
    return pairs


_KEYS = ["at", *[f"k{a}" for a in AXES]]


def self_pairs(boxes: DataFrame, pad: float, id_col: str) -> DataFrame:
    """Every pair of boxes that meet when each is grown by `pad`: columns a_* and b_*, where a has the lesser id."""
    names = boxes.columns
    rows = _leveled(boxes, pad)
    found = _looking(rows, pad, "p_", _levels(rows), False).join(_stored(rows, pad, "q_"), _KEYS)
    p, q = F.col(f"p_{id_col}"), F.col(f"q_{id_col}")
    found = _met(found.where((F.col("q_lvl") > F.col("p_lvl")) | ((F.col("q_lvl") == F.col("p_lvl")) & (p < q))), pad, "p_", "q_")
    pick = lambda c, first: F.when((p < q) == F.lit(first), F.col(f"p_{c}")).otherwise(F.col(f"q_{c}"))
    # a generator of one row puts the pair in order once; inlined into every later use it would be too much to compile
    pair = F.explode(F.array(F.struct(*[pick(c, True).alias(f"a_{c}") for c in names], *[pick(c, False).alias(f"b_{c}") for c in names])))
    return found.select(pair.alias("pair")).select("pair.*")


def pairs(left: DataFrame, right: DataFrame, pad: float) -> DataFrame:
    """Every pair of a left and a right box that meet when each is grown by `pad`: columns l_* and r_*."""
    a, b = _leveled(left, pad), _leveled(right, pad)
    levels = _levels(a, b)
    columns = [f"l_{c}" for c in left.columns] + [f"r_{c}" for c in right.columns]
    small = _looking(a, pad, "l_", levels, False).join(_stored(b, pad, "r_"), _KEYS)
    large = _looking(b, pad, "r_", levels, True).join(_stored(a, pad, "l_"), _KEYS)
    return _met(small, pad, "l_", "r_").select(*columns).unionByName(_met(large, pad, "l_", "r_").select(*columns))


def corners(prefix: str) -> tuple[list[Column], list[Column]]:
    return [F.col(f"{prefix}low_{a}") for a in AXES], [F.col(f"{prefix}high_{a}") for a in AXES]
