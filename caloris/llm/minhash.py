"""MinHash near-dedup with ProbMinHash signatures, banding, exact verification and distributed components.

**Signature.** A text's shingles of five words carry weights: 1 each, as links are defined by sets, or with `weighted` the
number of occurrences. Every shingle emits a Poisson process of arrivals at the rate of its weight; each arrival falls on a
random register, and a register keeps its first arrival's shingle. Arrivals later than the text's largest register cannot
matter, so a shingle stops there: large texts look at little more than each shingle's first arrival. Registers agree with
the probability Jaccard of two texts, which for equal weights is that of the sets. Verification computes the same measure
from all shingles, so candidates and links speak of one similarity.

**Bands.** Groups of registers give band keys; texts that share one are candidates. Exact copies are one text here.

**Links.** In each bucket every member is compared with one leader; pairs whose estimate can reach the threshold are
verified on all their shingles. Where members of a bucket are not all connected by then, those outside its largest
component are compared exactly with all its members that belong to others, in blocks of bounded size. No pair inside what
is connected is looked at, so a large group costs its size and not its square, and no link between groups is lost: the
estimate only saves work.

**Classes.** Links become stars by alternating large-star and small-star rounds, each a few joins on edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Bloom, batches_of, code_points, drop_ids, map_arrow, mix64, only, span_hashes, staged, words_of

SHINGLE, THRESHOLD = 5, 0.8
REGISTERS, ROWS = 96, 4
#: Pairs with their leader of a lower estimate (4.5 standard deviations below the threshold) are left to the exact comparison.
LEAST_ESTIMATE = 0.62
#: Orders in which buckets choose their leaders: few, so that the bands of a group mostly choose the same ones.
ORDERS = 4
#: Members of a bucket that one task compares with as many others.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles_of(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, occurrences), sorted; a text of fewer words has one shingle of all of them, or none."""
    points, offsets = code_points(texts)
    starts, ends, own = words_of(points, offsets)
    n = np.diff(own)
    words = span_hashes(points, starts, ends)
    total = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), total)
    first = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total) + own[:-1][row]
    left = own[1:][row] - first
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        value = np.zeros(len(row), np.uint64)
        for k in range(size):
            value = mix64(value + np.where(left > k, padded[first + k], np.uint64(k)) * _GOLD)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: the shingle of each register of each text (0 for texts without shingles)."""
    first = np.full(texts * registers, np.inf)
    held = np.zeros(texts * registers, np.uint64)
    stop = np.full(texts, np.inf)
    now = np.zeros(len(row))
    turn = np.uint64(1)
    with np.errstate(over="ignore", divide="ignore"):
        while len(row):
            random = mix64(shingle + turn * _GOLD)
            now = now - np.log(((random >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / weight
            live = now <= stop[row]
            row, shingle, weight, now, random = (x[live] for x in (row, shingle, weight, now, random))
            slot = row * registers + (mix64(random) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(first, slot, now)
            won = first[slot] == now
            held[slot[won]] = shingle[won]
            stop = first.reshape(texts, registers).max(axis=1) if texts else stop
            turn += np.uint64(1)
    return held.reshape(texts, registers)


def sign(docs: DataFrame, *, registers: int = REGISTERS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """id, key (of the exact text), size (bytes of its shingles), bands (array<long>), brief (16 bits of each register); docs
    has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        salt = mix64(np.arange(1, registers // rows + 1, dtype=np.uint64))
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                row, shingle, times = shingles_of(texts)
                held = signatures(row, shingle, times.astype(float) if weighted else np.ones(len(row)), len(texts), registers)
                with np.errstate(over="ignore"):
                    bands = np.zeros((len(texts), registers // rows), np.uint64)
                    for k in range(rows):
                        bands = mix64(bands + salt + held[:, k::rows][:, : registers // rows] * _GOLD)
                size = np.bincount(row, minlength=len(texts))
                offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(size > 0, bands.shape[1], 0))]).astype(np.int32)
                brief = (mix64(held) & np.uint64(0xFFFF)).astype("<u2")
                yield {
                    "id": batch.column(0).slice(first, len(texts)),
                    "key": pa.array([_key(x) for x in texts], pa.binary()),
                    "size": size * (12 if weighted else 8),
                    "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[size > 0].ravel().view(np.int64))),
                    "brief": pa.array([x.tobytes() for x in brief], pa.binary()),
                }

    return map_arrow(docs, run, "id long, key binary, size long, bands array<long>, brief binary")


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def bring_shingles(docs: DataFrame, wanted: DataFrame, weighted: bool = False) -> DataFrame:
    """key, shingles (sorted 64-bit), times (32-bit occurrences if weighted) of the texts with wanted keys, once each.

    wanted: key, id (of one text with the key). A filter of the keys goes along with the scan; keys too many for it meet
    the texts in a join on the id instead.
    """
    wanted = staged(wanted)
    n = wanted.count()
    if Bloom.holds(n):
        keys = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted.select("key"), "key"))
    else:
        keys = None
        docs = docs.join(wanted.select(F.col("id").alias("one")), F.col("id").eqNullSafe(F.col("one")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        done: set[bytes] = set()
        for batch in batches:
            for _, texts in batches_of(batch, "text"):
                own = [_key(x) for x in texts]
                fresh = {}
                for i in np.flatnonzero(keys.value.test(own)).tolist() if keys else range(len(own)):
                    if own[i] not in done:
                        done.add(own[i])
                        fresh[own[i]] = i
                row, value, times = shingles_of([texts[i] for i in fresh.values()])
                cut = np.searchsorted(row, np.arange(len(fresh) + 1))
                yield {
                    "key": pa.array(list(fresh), pa.binary()),
                    "shingles": pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                    "times": pa.array([times[a:b].astype("<u4").tobytes() if weighted else b"" for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                }

    return map_arrow(docs, run, "key binary, shingles binary, times binary").groupBy("key").agg(F.first("shingles").alias("shingles"), F.first("times").alias("times"))


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """Sum over the common shingles d of 1 / sum over all e of max(wx[e] / wx[d], wy[e] / wy[d]); x and y are sorted."""
    every = np.union1d(x, y)
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, x)], b[np.searchsorted(every, y)] = wx, wy
    with np.errstate(divide="ignore"):
        ratio = np.where(b > 0, a / np.where(b > 0, b, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    a, b = a[order], b[order]
    low, high = np.cumsum(b), a.sum() - np.cumsum(a)  # up to d the second quotient is larger, after it the first
    both = (a > 0) & (b > 0)
    return float((1 / (low[both] / b[both] + high[both] / a[both])).sum())


class Shingles(NamedTuple):
    """One text's shingles, and their weights where they have any."""

    values: np.ndarray
    weights: np.ndarray | None

    @staticmethod
    def of(values: bytes, times: bytes) -> Shingles:
        return Shingles(np.frombuffer(values, np.uint64), np.frombuffer(times, "<u4").astype(float) if times else None)

    def like(self, other: Shingles, threshold: float) -> bool:
        if self.weights is not None:
            return probability_jaccard(*self, *other) >= threshold - 1e-12
        small, large = sorted((len(self.values), len(other.values)))
        if small < threshold * large:
            return False
        both = len(np.intersect1d(self.values, other.values, assume_unique=True))
        return both > 0 and both >= threshold * (small + large - both)


def _agreeing(pairs: DataFrame, least: float) -> DataFrame:
    """a, b of the rows (a, b, brief_a, brief_b) whose signatures agree in so large a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array(np.flatnonzero((x == y).mean(axis=1) >= least))
            yield {"a": batch.column(0).take(keep), "b": batch.column(1).take(keep)}

    return map_arrow(pairs.select("a", "b", "brief_a", "brief_b"), run, "a binary, b binary")


def verify(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole shingles have a similarity of threshold or more."""
    left, right = (shingles.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}"), F.col("times").alias(f"t{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            keep = pa.array([i for i, (x, u, y, v) in enumerate(rows) if Shingles.of(x, u).like(Shingles.of(y, v), threshold)], pa.int64())
            yield {"a": batch.column(0).take(keep), "b": batch.column(1).take(keep)}

    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ta", "sb", "tb"), run, "a binary, b binary")


def _across(known: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between a bucket's members in different components: enough to join what belongs together.

    known: band, key, size, component. In a bucket of several components the members outside the largest one (the others)
    are dealt into blocks of about BLOCK texts or BLOCK_BYTES of shingles, and so are those inside it; every block of the
    others meets every block, so a group's size is bounded and one stray member of a large bucket costs one scan of it.
    Buckets of the same members count once. Inside, similarities are exact, and one link is given for each pair of
    components that has one.
    """
    parts = known.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *[F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)])
    bands = parts.groupBy("band").agg(
        F.count("*").alias("parts"), F.max(F.struct("n", "component", "bytes")).alias("big"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1")
    )
    once = bands.where("parts > 1").groupBy("n", "h0", "h1").agg(F.min(F.struct("band", "big", "bytes")).alias("b"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    once = once.select("b.band", F.col("b.big.component").alias("big"), blocks(F.col("n") - F.col("b.big.n"), F.col("b.bytes") - F.col("b.big.bytes")).alias("few"), blocks(F.col("b.big.n"), F.col("b.big.bytes")).alias("many"))
    rows = staged(known.join(once, "band"))
    if rows.isEmpty():
        return known.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    deal = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    inside = F.col("component") == F.col("big")
    placed = rows.withColumn("block", F.when(inside, F.col("few") + deal(F.col("many"))).otherwise(deal(F.col("few"))))
    meets = F.when(inside, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1))
    pairs = F.transform(meets, lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    placed = placed.join(shingles, "key").withColumn("pair", F.explode(pairs)).select("band", "pair.i", "pair.j", "block", "key", "shingles", "times", "component")

    def compare(table: pa.Table) -> pa.Table:
        keys = table["key"].to_pylist()
        label = np.unique(np.array([c.hex() for c in table["component"].to_pylist()]), return_inverse=True)[1]
        sets = [Shingles.of(x, t) for x, t in zip(table["shingles"].to_pylist(), table["times"].to_pylist(), strict=True)]
        links = linked_components(sets, label, table["block"].to_numpy(), threshold)
        return pa.table({"a": pa.array([min(keys[r], keys[s]) for r, s in links], pa.binary()), "b": pa.array([max(keys[r], keys[s]) for r, s in links], pa.binary())})

    return placed.groupBy("band", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def linked_components(sets: list[Shingles], label: np.ndarray, block: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """One pair of similar texts for each pair of labels that has any; within one block, or across two where there are two."""
    n = len(sets)
    sizes = np.array([len(x.values) for x in sets], float)
    values, owner = np.concatenate([*(x.values for x in sets), np.zeros(0, np.uint64)]), np.repeat(np.arange(n), sizes.astype(np.int64))
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)  # common shingles, counted by a matrix product
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (k, k + 2048))
        part = np.zeros((n, 2048), np.float32)
        part[owner[a:b], column[a:b] - k] = 1
        both += part @ part.T
    apart = (label[:, None] != label[None, :]) & (both > 0)
    if len(np.unique(block)) > 1:
        apart &= block[:, None] != block[None, :]
    if sets and sets[0].weights is not None:
        r, s = np.nonzero(np.triu(apart, 1))
        like = np.array([sets[i].like(sets[j], threshold) for i, j in zip(r.tolist(), s.tolist(), strict=True)], bool)
        r, s = r[like], s[like]
    else:
        r, s = np.nonzero(np.triu(apart & (both >= threshold * (sizes[:, None] + sizes[None, :] - both)), 1))
    low, high = np.minimum(label[r], label[s]), np.maximum(label[r], label[s])
    _, first = np.unique(low * (n + 1) + high, return_index=True)
    return list(zip(r[first].tolist(), s[first].tolist(), strict=True))


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node) of every node in the links (a, b), by large-star and small-star rounds."""
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = staged(small.where("a <> b").distinct())


def near_dedup(docs: DataFrame, *, threshold: float = THRESHOLD, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate texts: id, class_id (the least id of the class), class_size, kept.

    Two texts are linked if their shingles of five words (words between white space) have a similarity of at least the
    threshold: the Jaccard similarity of the sets, or with `weighted` the probability Jaccard of their numbers of
    occurrences. Texts of fewer words have one shingle of all of them. Classes are the connected components, so exact copies
    share a class, also those without any word; null counts as empty. kept marks the row with the class's least id; null ids
    lose to any other, and a class of null ids has a null class_id and keeps all its rows. Rows that repeat an id are kept
    or dropped together. Links are found with a probability that falls below one only near the threshold: there two texts
    share a band with 1 - (1 - 0.8**4)**24 > 0.999996. Other columns are ignored; an empty table gives an empty result.
    """
    rows = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    signed = staged(sign(rows, weighted=weighted))
    texts = staged(signed.groupBy("key").agg(F.first("bands").alias("bands"), F.first("brief").alias("brief"), F.first("size").alias("size"), F.min("id").alias("id"), F.count("*").alias("n")))
    bands = texts.select("key", "size", F.explode("bands").alias("band"))
    order = F.xxhash64(F.pmod("band", F.lit(ORDERS)), "key")
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), "key")).alias("leader")).where("n > 1")
    members = staged(bands.join(shared.select("band", F.col("leader.key").alias("leader")), "band"))
    met = members.where("key <> leader").select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    for k in "ab":
        met = met.join(texts.select(F.col("key").alias(k), F.col("brief").alias(f"brief_{k}")), k)
    pairs = staged(_agreeing(met, LEAST_ESTIMATE))
    shingles = staged(bring_shingles(rows, members.select("key").distinct().join(texts.select("key", "id"), "key"), weighted))
    links = staged(verify(pairs, shingles, threshold))
    labels = components(links)
    # what the leaders have not connected
    known = staged(members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "size", F.coalesce("component", "key").alias("component")))
    more = staged(_across(known, shingles, threshold))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    keys = texts.select("key", "id", "n").join(labels.withColumnRenamed("node", "key"), "key", "left")
    keys = keys.select("key", F.coalesce("component", "key").alias("component"), "id", "n")
    classes = keys.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    keys = keys.join(classes, "component").select("key", "class_id", "class_size")
    out = signed.select("id", "key").join(keys, "key")
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def survivors(docs: DataFrame, *, threshold: float = THRESHOLD, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns; rows with null ids stay."""
    found = only(near_dedup(docs, threshold=threshold, weighted=weighted, id_col=id_col, text_col=text_col), id=id_col, kept="kept")
    return drop_ids(docs, staged(found.where("NOT kept AND id IS NOT NULL").select("id")), id_col)
