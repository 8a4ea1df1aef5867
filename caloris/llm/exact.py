"""Exact dedup by a log-structured merge index.

* **Memtables.** Each task keeps a table digest -> best identifier, members and one text; a second text with a known
  digest is compared byte by byte before it joins. A full memtable is flushed as a sorted *run*: its entries in digest order.
* **Compaction.** All runs are cut at the same digests; each slice is merged in order of digest into one run of the next
  level, in which a digest stands once, with its best identifier. Digests that came from more than one run are the *hits*.
* **Filters.** Every compacted run has a Bloom filter of its hits' representatives and its first digest as a fence. A lookup
  goes to the run whose fence lies before the digest and asks that run's filter. So the second scan learns which texts
  it must bring. The filters' size is bounded; filters too small for their hits only let more texts through.
* **Verification.** Representatives of one digest meet with their whole texts and are grouped by digest *and* text, so
  two texts that share a digest stay apart. Groups are salted by run first and then joined, so a text that a third of the
  rows share meets in many tasks.

What is shuffled is one short row per distinct text and run, and one text per hit and run, never all texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import drop_ids, map_arrow, mix64, only, staged

#: A memtable is flushed at so many rows or bytes of kept text.
MEMTABLE_ROWS, MEMTABLE_BYTES = 200_000, 48 << 20
#: Bits of the filters for each hit, and of all of them together.
BITS_PER_HIT, FILTER_BITS = 16, 1 << 28
_PROBES = 4
#: Groups into which the runs are dealt before the texts of a digest meet.
SALTS = 16


def build_runs(docs: DataFrame, keep: str, digest_bytes: int) -> DataFrame:
    """Runs of (run, slot, digest, best, best_at, n, members), in digest order; docs has the columns id and text."""
    better = max if keep == "max" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, count = TaskContext.get().partitionId(), 0
        table: dict[bytes, list[list]] = {}
        rows = size = 0

        def flush() -> dict:
            entries = [(d, e) for d in sorted(table) for e in table[d]]
            best = [better((x for x in e[1] if x is not None), default=None) for _, e in entries]
            return {
                "run": np.full(len(entries), (part << 24) + count, np.int64),
                "slot": np.arange(len(entries), dtype=np.int32),
                "digest": pa.array([d for d, _ in entries], pa.binary()),
                "best": pa.array(best, pa.int64()),
                "best_at": np.array([e[1].index(b) for (_, e), b in zip(entries, best, strict=True)], np.int32),
                "n": np.array([len(e[1]) for _, e in entries], np.int64),
                "members": pa.array([e[1] for _, e in entries], pa.list_(pa.int64())),
            }

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                digest = hashlib.sha256(raw).digest()[:digest_bytes]
                for entry in (found := table.setdefault(digest, [])):
                    if entry[0] == raw:
                        entry[1].append(i)
                        break
                else:
                    found.append([raw, [i]])
                    size += len(raw)
                rows += 1
                if rows >= MEMTABLE_ROWS or size >= MEMTABLE_BYTES:
                    yield flush()
                    table.clear()
                    rows = size = 0
                    count += 1
        if table:
            yield flush()

    return map_arrow(docs, run, "run long, slot int, digest binary, best long, best_at int, n long, members array<long>")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The hits (run, slot, digest, best, n, level_run): entries whose digest other entries have too.

    The runs' slices are merged as sorted streams: equal digests are neighbours, and only the open group is held, which has
    an entry for each run at most (and one for each text that shares a digest).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, held = TaskContext.get().partitionId(), None

        def hits(rows: pa.Table, upto: int) -> dict:
            """Rows before `upto` with a neighbour of the same digest."""
            digest = rows["digest"].combine_chunks()
            same = pa.compute.equal(digest.slice(1), digest.slice(0, max(len(digest) - 1, 0))).to_numpy(zero_copy_only=False)
            some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            found = rows.slice(0, upto).take(pa.array(np.flatnonzero(some[:upto])))
            return {**{k: found[k].combine_chunks() for k in ("run", "slot", "digest", "best", "n")}, "level_run": np.full(found.num_rows, part, np.int32)}

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            last = rows["digest"][rows.num_rows - 1]
            closed = int(pa.compute.sum(pa.compute.less(rows["digest"], last)).as_py())
            yield hits(rows, closed)
            held = rows.slice(closed)
        if held is not None:
            yield hits(held, held.num_rows)

    slices = runs.select("run", "slot", "digest", "best", "n").repartitionByRange("digest").sortWithinPartitions("digest", "run", "slot")
    return map_arrow(slices, run, "run long, slot int, digest binary, best long, n long, level_run int")


def _bits(digests: pa.Array, ids: pa.Array) -> np.ndarray:
    """64 random bits for each probe of (digest, id)."""
    head = np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in digests.to_pylist()), "<u8")
    key = mix64(head ^ mix64(pa.compute.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
    with np.errstate(over="ignore"):
        return mix64(key[:, None] + np.arange(_PROBES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Filters:
    """The compacted runs' fences and filters of (digest, best) of their hits."""

    def __init__(self, fences: list[bytes], words: list[np.ndarray]) -> None:
        self.fences, self.sizes = np.array(fences, object), np.array([len(w) for w in words])
        self.words, self.first = np.concatenate([*words, np.zeros(1, np.uint64)]), np.cumsum([0, *map(len, words)])[:-1]

    @classmethod
    def of(cls, hits: DataFrame, n: int) -> Filters:
        """Built where the hits lie: one row a compacted run, FILTER_BITS in all."""
        per_hit = min(BITS_PER_HIT, FILTER_BITS / max(n, 1))
        # rows of a partition are one compacted run: a checkpoint keeps partitions and their order
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            parts = [b for b in batches if b.num_rows]
            if not parts:
                return
            rows = pa.Table.from_batches(parts)
            size = max(1, int(rows.num_rows * per_hit) >> 6)
            words = np.zeros(size, np.uint64)
            bits = (_bits(rows["digest"].combine_chunks(), rows["best"].combine_chunks()) % np.uint64(64 * size)).ravel()
            np.bitwise_or.at(words, (bits >> np.uint64(6)).astype(np.int64), np.left_shift(np.uint64(1), bits & np.uint64(63)))
            yield {"fence": pa.array([min(rows["digest"].to_pylist())], pa.binary()), "words": pa.array([words.tobytes()], pa.binary())}

        made = map_arrow(hits.select("digest", "best"), run, "fence binary, words binary").toArrow().sort_by("fence").to_pylist()
        return cls([r["fence"] for r in made], [np.frombuffer(r["words"], np.uint64) for r in made])

    def test(self, digests: pa.Array, ids: pa.Array) -> np.ndarray:
        at = np.searchsorted(self.fences, np.array(digests.to_pylist(), object), "right") - 1
        inside = at >= 0
        at = np.maximum(at, 0)
        bits = _bits(digests, ids) % (np.uint64(64) * self.sizes[at].astype(np.uint64))[:, None]
        word = self.words[self.first[at][:, None] + (bits >> np.uint64(6)).astype(np.int64)]
        return inside & ((word >> (bits & np.uint64(63))) & np.uint64(1)).all(axis=1)


def bring_texts(docs: DataFrame, filters: Filters, digest_bytes: int) -> DataFrame:
    """Texts of the rows that pass the filters: id, digest, text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digests = pa.array([hashlib.sha256((x or "").encode()).digest()[:digest_bytes] for x in batch.column(1).to_pylist()], pa.binary())
            rows = pa.array(np.flatnonzero(shared.value.test(digests, batch.column(0))))
            yield {"id": batch.column(0).take(rows), "digest": digests.take(rows), "text": pa.compute.fill_null(batch.column(1).take(rows), "")}

    return map_arrow(docs, run, "id long, digest binary, text string")


def exact_dedup(docs: DataFrame, *, keep: str = "max", id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """Group rows whose texts are equal byte by byte and keep the one with the largest (or smallest) id of each group.

    Returns one row per input row, dropped ones too: id, keep_id, group_size, kept, text_sha256 (hex; of the first
    digest_bytes bytes). Null text counts as empty. A null id loses to any other; a group of null ids keeps its first row
    and has a null keep_id. Of repeated rows (same id, same text) exactly one is kept. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = only(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    runs = staged(build_runs(rows, keep, digest_bytes))
    hits = staged(merge_runs(runs))
    n = hits.count()
    if n:
        texts = bring_texts(rows, Filters.of(hits, n), digest_bytes).dropDuplicates(["id", "digest", "text"])
        met = hits.join(texts, (hits.digest == texts.digest) & hits.best.eqNullSafe(texts.id)).select("run", "slot", hits.digest, "best", "n", "text")
        # the best entry sorts last: nulls are least, then the id, then the first run and slot
        rank = F.struct((F.col("best") if keep == "max" else -F.col("best")).alias("key"), (-F.col("run")).alias("run"), (-F.col("slot")).alias("slot"), "best")
        salted = met.groupBy("digest", F.pmod(F.xxhash64("run"), F.lit(SALTS)).alias("salt"), "text").agg(F.max(rank).alias("top"), F.sum("n").alias("n"), F.collect_list(F.struct("run", "slot")).alias("entries"))
        groups = salted.groupBy("digest", "text").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"), F.collect_list("entries").alias("entries"))
        verified = groups.select("top", "group_size", F.explode(F.flatten("entries")).alias("e")).select(
            "e.run", "e.slot", F.col("top.best").alias("keep_id"), "group_size", ((F.col("e.run") == -F.col("top.run")) & (F.col("e.slot") == -F.col("top.slot"))).alias("winner")
        )
        out = runs.join(verified, ["run", "slot"], "left")
    else:
        out = runs.withColumns({"keep_id": F.lit(None).cast("long"), "group_size": F.lit(None).cast("long"), "winner": F.lit(None).cast("boolean")})
    out = out.select(
        F.coalesce("keep_id", "best").alias("keep_id"),
        F.coalesce("group_size", "n").alias("group_size"),
        F.coalesce("winner", F.lit(True)).alias("winner"),
        "best_at",
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.posexplode("members").alias("at", "id"),
    )
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("winner") & (F.col("at") == F.col("best_at"))).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, *, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. Rows with null ids stay; of several rows with one
    id and one text all stay if one does."""
    found = staged(only(exact_dedup(docs, keep=keep, id_col=id_col, text_col=text_col), id=id_col, kept="kept"))
    ids = found.where("NOT kept AND id IS NOT NULL").select("id")
    return drop_ids(docs, ids.join(found.where("kept").select("id"), "id", "left_anti"), id_col)
