"""Vectorised triangle and box geometry over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

EPS = 1e-9


def triangles_meet_boxes(batch: pa.RecordBatch) -> np.ndarray:
    """For each row whether the triangle in `tri` meets the box (cx.., sx..). Touching counts."""
    names = batch.schema.names
    column = lambda n: batch.column(names.index(n)).to_numpy(zero_copy_only=False)
    centre = np.stack([column(f"c{a}") for a in "xyz"], axis=1)
    half = np.stack([column(f"s{a}") for a in "xyz"], axis=1) / 2
    tri = np.stack([np.asarray(x, float) for x in batch.column(names.index("tri")).to_pylist()]).reshape(-1, 3, 3)
    return meet(tri - centre[:, None, :], half)


def meet(tri: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Triangles (n, 3, 3) relative to box centres against half sizes (n, 3): no axis of the thirteen separates them."""
    hit = ((tri.min(axis=1) <= half + EPS) & (tri.max(axis=1) >= -half - EPS)).all(axis=1)
    normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    flat = np.abs((normal * tri[:, 0]).sum(axis=1)) <= (half * np.abs(normal)).sum(axis=1) + EPS
    hit &= flat | (np.linalg.norm(normal, axis=1) <= EPS)
    for k in range(3):
        edge = tri[:, (k + 1) % 3] - tri[:, k]
        for axis in np.eye(3):
            test = np.cross(edge, axis)
            p = (tri * test[:, None, :]).sum(axis=2)
            r = (half * np.abs(test)).sum(axis=1)
            apart = (p.min(axis=1) > r + EPS) | (p.max(axis=1) < -r - EPS)
            hit &= ~(apart & ((test * test).sum(axis=1) > EPS))
    return hit
