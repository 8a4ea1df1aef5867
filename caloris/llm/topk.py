"""Exact top-k inner products over norm-sorted blocks.

Vectors are turned into integers, and products too large for floating point are summed as integers, so scores are exact.
Candidates are dealt into blocks of falling length. A first pass against the longest candidates finds scores that each
query's k-th best reaches at least; that score over the query's length is the length which a candidate needs. Queries are
then sorted by this need and cut into blocks of their own, and a pair of blocks meets only if the longest candidate has the
least need of the queries. Inside a pair, vectors are rotated by the right singular vectors of all candidates, so that few
leading coordinates carry most of each product; what is left is bounded by Cauchy-Schwarz on the residual lengths, first
after HEADS[0] coordinates and then after HEADS[1], and only what may still reach the k-th score gets its exact product.
Of these only the ones that do reach it leave the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_arrow, settled, staged

QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: Leading rotated coordinates after which the two bounds are taken.
HEADS = (8, 32)
#: Sums of products up to this are exact in floating point.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int, id_col: str, vec_col: str, asks: Column) -> DataFrame:
    """id, v (array<long> of floor(scale * x)), asks, norm2 (double), dim: without rows of null ids and vectors that are null or
    have null, NaN or infinite parts."""
    big = F.raise_error(F.lit("a scaled component does not fit into 64 bits"))
    rows = settled(vectors, id_col, vec_col)
    parts = F.col(f"`{vec_col}`")
    x = F.transform(parts, lambda c: F.when(F.abs(c.cast("double") * scale) < float(1 << 63), F.floor(c.cast("double") * scale)).otherwise(big.cast("long")))
    good = parts.isNotNull() & F.forall(parts, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.where(good & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).withColumn("dim", F.size("v"))


def _rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors of all its vectors, from Gram matrices summed by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        grams: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, v in _by_dim(batch.column(0).to_pylist()):
                grams[d] = grams.get(d, 0) + v.T.astype(float) @ v.astype(float)
        dims = [d for d in grams for _ in range(d)]
        yield {
            "dim": np.array(dims, np.int32),
            "line": np.array([i for d in grams for i in range(d)], np.int32),
            "values": pa.array([row.tolist() for d in grams for row in grams[d]], pa.list_(pa.float64())),
        }

    lines = map_arrow(rows.select("v"), run, "dim int, line int, values array<double>")
    cells = lines.select("dim", "line", F.posexplode("values").alias("at", "value")).groupBy("dim", "line", "at").agg(F.sum("value").alias("value")).collect()
    out: dict[int, np.ndarray] = {}
    for r in cells:
        out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))[r["line"], r["at"]] = r["value"]
    return {d: np.linalg.eigh(g)[1][:, ::-1] for d, g in out.items()}


def _by_dim(vectors: list[list[int]]) -> list[tuple[int, np.ndarray]]:
    groups: dict[int, list] = {}
    for v in vectors:
        groups.setdefault(len(v), []).append(v)
    return [(d, np.array(v, np.int64).reshape(len(v), d)) for d, v in groups.items() if d]


def _best(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, c: np.ndarray, cid: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of a candidate block sorted by falling length; `floor` are scores known to be reached k times."""
    near, far = (min(n, q.shape[1]) for n in HEADS)
    qf, cf = q.astype(float), c.astype(float)
    qr, cr = qf @ turn, cf @ turn
    length, q_length = (np.sqrt((x**2).sum(axis=1)) for x in (cf, qf))
    (q_near, q_far), (c_near, c_far) = ([np.sqrt((x[:, n:] ** 2).sum(axis=1)) for n in (near, far)] for x in (qr, cr))
    slack = 1e-9 * q_length * (length[:1].sum() + 1) + 1e-6  # rounding of the rotated sums
    out = []
    floor = floor.astype(float)
    # the first candidates raise the floor where nothing is known yet; those of the query's own id do not count
    if len(c) > k:
        start = np.where(cid[None, : 4 * k] == qid[:, None], -np.inf, qf @ cf[: 4 * k].T)
        floor = np.maximum(floor, np.sort(start, axis=1)[:, -k])
    reach = np.searchsorted(-length, -(floor - slack) / np.maximum(q_length, 1e-12), "right")
    reach = np.where(floor <= 0, len(c), reach)
    for i in range(len(q)):
        n = int(reach[i])
        if not n:
            continue
        part = cr[:n, :near] @ qr[i, :near]
        may = np.flatnonzero(part + q_near[i] * c_near[:n] >= floor[i] - slack[i])
        may = may[cid[may] != qid[i]]
        if far > near and len(may):
            may = may[part[may] + cr[may, near:far] @ qr[i, near:far] + q_far[i] * c_far[may] >= floor[i] - slack[i]]
        if not len(may):
            continue
        about = cf[may] @ qf[i]
        if q_length[i] * length[may].max() < EXACT:
            score = about.astype(np.int64)
            if len(may) > k:
                least = np.partition(score, -k)[-k]
                best = np.flatnonzero(score >= least)
                may, score = may[best], score[best]
            order = np.lexsort((cid[may], -score))[:k]
            out.append((i, cid[may[order]], score[order]))
        else:
            found = _whole(q[i], c, cid, may, about, (q.shape[1] + 4) * 2.3e-16 * q_length[i] * length[may], k)
            out.append((i, cid[found[0]], found[1]))
    return out


def _whole(q: np.ndarray, c: np.ndarray, cid: np.ndarray, may: np.ndarray, about: np.ndarray, error: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of c among `may` and their scores, in whole numbers of any size; `about` is right to within `error`."""
    if len(may) > k:
        least = np.partition(about - error, -k)[-k]
        may = may[about + error >= least]
    own = [int(x) for x in q]
    score = {j: sum(x * y for x, y in zip(own, c[j].tolist(), strict=True)) for j in may.tolist()}
    order = sorted(score, key=lambda j: (-score[j], cid[j]))[:k]
    return np.array(order, np.int64), np.array([score[j] for j in order], np.int64)  # an OverflowError beyond 64 bits


def in_blocks(rows: DataFrame, size: int, name: str, *order: Column | str) -> DataFrame:
    """rows with `name`, the number of their block of `size` rows in an order that starts with dim: range partitions are
    numbered through from how many rows the ones before hold, so blocks do not depend on the partitions."""
    rows = staged(rows.repartitionByRange("dim", *order).sortWithinPartitions("dim", *order).withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())  # one row a partition
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part long, before long")
    rows = rows.withColumn("part", part.cast("long")).join(F.broadcast(offsets), "part")
    return rows.withColumn(name, F.floor((F.col("before") + row) / size)).drop("at", "part", "before")


def top_k(vectors: DataFrame, queries: Column, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k candidates of highest integer inner product of floor(scale * x): query_id, rank, id, score.

    queries marks the rows that are queries; every such row has a ranking of its own, also where an id stands on several
    rows. Candidates are all rows but those with the query's id, repeated rows each. Ties go to the smaller id. Rows without
    an id and vectors that are null, empty or hold null, NaN or infinite components take no part; vectors of different
    dimension do not meet. Scaled components and scores beyond 64 bits raise, as they do in SQL. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = staged(quantised(vectors, scale, id_col, vec_col, queries).where("dim > 0"))
    turns = rows.sparkSession.sparkContext.broadcast(_rotations(rows))  # dim x dim numbers
    blocks = in_blocks(rows.select("id", "v", "norm2", "dim"), CANDIDATE_BLOCK, "block", F.desc("norm2"), "id")  # of falling length
    asking = staged(rows.where("asks").withColumn("q", F.monotonically_increasing_id()).select("q", "id", "v", "norm2", "dim"))
    summary = blocks.groupBy("dim", "block").agg(F.max("norm2").alias("longest"))
    summary = staged(summary.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "block"))))

    def meet(asks: DataFrame, pairs: DataFrame) -> DataFrame:
        """The best of each query in each (query block, candidate block) pair. asks: q, id, v, dim, q_block, floor, floor_id."""
        left = pairs.join(asks.groupBy("dim", "q_block").agg(F.collect_list(F.struct("q", "id", "v", "floor", "floor_id")).alias("asks")), ["dim", "q_block"])
        right = blocks.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("norm2")).alias("o"), "id", "v"))).alias("has"))
        both = left.join(right, ["dim", "block"]).select("dim", "asks", "has")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    d = batch.column(0)[i].as_py()
                    asks, has = batch.column(1)[i].values, batch.column(2)[i].values
                    number, qid, cid = asks.field("q").to_numpy(), asks.field("id").to_numpy(), has.field("id").to_numpy()
                    q = asks.field("v").flatten().to_numpy().reshape(-1, d)
                    c = has.field("v").flatten().to_numpy().reshape(-1, d)
                    known = asks.field("floor").is_valid().to_numpy(zero_copy_only=False)
                    least, least_id = (pa.compute.fill_null(asks.field(f), 0).to_numpy() for f in ("floor", "floor_id"))
                    found = [np.zeros((3, 0), np.int64)]
                    for j, vec, score in _best(q, qid, np.where(known, least.astype(float), -np.inf), c, cid, turns.value[d], k):
                        if known[j]:  # what cannot be among the k best any more stays here
                            some = (score > least[j]) | (score == least[j]) & (vec <= least_id[j])
                            vec, score = vec[some], score[some]
                        found.append(np.stack([np.full(len(vec), number[j]), vec, score]))
                    yield dict(zip(("q", "vec", "score"), np.concatenate(found, axis=1), strict=True))

        return map_arrow(both, run, "q long, vec long, score long")

    # against the longest candidates
    none = [F.lit(None).cast("long").alias(c) for c in ("floor", "floor_id")]
    first = in_blocks(asking.select("q", "id", "v", "dim", *none), QUERY_BLOCK, "q_block", "q")
    head = staged(meet(first, first.select("dim", "q_block").distinct().join(summary.where("rank = 1").select("dim", "block"), "dim")))
    kth = head.groupBy("q").agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "vec")).alias("last")).where(F.col("n") >= k)
    kth = kth.select("q", (-F.col("last.s")).alias("floor"), F.col("last.vec").alias("floor_id"))
    # against the rest, queries of like need together
    need = F.when(F.col("floor") > 0, F.col("floor") / F.sqrt("norm2")).otherwise(F.lit(float("-inf")))
    second = asking.join(kth, "q", "left").withColumn("need", F.coalesce(need, F.lit(float("-inf"))))
    second = in_blocks(second.select("q", "id", "v", "dim", "floor", "floor_id", "need"), QUERY_BLOCK, "q_block", F.desc("need"), "q")
    least = second.groupBy("dim", "q_block").agg(F.min("need").alias("need"))
    pairs = least.join(summary.where("rank > 1"), "dim").where(F.sqrt("longest") * (1 + 1e-9) >= F.col("need"))
    rest = meet(second, pairs.select("dim", "q_block", "block"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec")
    out = head.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.join(asking.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", F.col("vec").alias(id_col), "score")
