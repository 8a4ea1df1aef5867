"""Mixture-controlled packing of token streams into fixed windows by deficit round-robin.

Each source is a queue: its documents' tokens one after the other. Queue q earns credit at its target rate p_q and is
served a quantum of Q tokens whenever its deficit reaches half a quantum, so quantum k of queue q is due at virtual time
(k + 1/2) * Q / p_q, and the packed stream is all quanta in order of their due times (ties by queue). Cutting that stream
every `capacity` tokens gives windows in which every queue holds its target share to within about a quantum; what a window
lacks is carried, as the deficit, into the next window and across partitions. A queue that runs dry leaves its share to the
others. A rare source is served in quanta too, so its documents are not cut into single tokens.

The order is a closed form: how many tokens of each queue stand before window w needs only the queues' totals
(`Mixture.cuts`). So after one pass that tokenises and counts, each row finds its own pieces; no token is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import tokenizer
from .common import batches_of, map_arrow, only, staged

#: Tokens that a queue is served at once.
QUANTUM = 64
#: Steps that bring a search near its window before the quanta are looked at one by one.
STEPS = 60
#: Most numbers (windows times queues) in one table of the closed form.
CELLS = 1 << 20
#: Most (partition, source) pairs whose offsets are broadcast; beyond it they are joined by a shuffle.
BROADCAST_CELLS = 1 << 20


class Mixture:
    """Totals and target rates of the queues, and the closed form of their order."""

    def __init__(self, totals: np.ndarray, rates: np.ndarray, capacity: int, quantum: int = QUANTUM) -> None:
        self.totals, self.rates, self.capacity, self.quantum = np.asarray(totals, np.int64), np.asarray(rates, np.float64), capacity, quantum
        self.total = int(self.totals.sum())
        self.pace = self.rates / quantum
        self.quanta = -(-self.totals // quantum)
        self._known, self._known_cuts = np.zeros(0, np.int64), np.zeros((0, len(self.totals)), np.int64)

    def _due(self, quantum: np.ndarray, pace: np.ndarray) -> np.ndarray:
        return (quantum + 0.5) / pace

    def served(self, v: np.ndarray, inclusive: bool) -> np.ndarray:
        """Quanta of each queue due before v (or at v too): one row per v. Exact in terms of the floating due times."""
        v = v[:, None]
        k = np.floor(v * self.pace - 0.5).astype(np.int64)
        past = np.less_equal if inclusive else np.less
        for _ in range(2):
            k += past(self._due(k, self.pace), v)
        for _ in range(3):
            k -= ~past(self._due(k - 1, self.pace), v) & (k > 0)
        return np.clip(k, 0, self.quanta)

    def due(self, v: np.ndarray, inclusive: bool) -> np.ndarray:
        """Tokens of each queue due before v (or at v too)."""
        return np.minimum(self.served(v, inclusive) * self.quantum, self.totals)

    def cuts(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue before each window: rows sum to capacity * w and never fall from one window to the next."""
        goal = np.minimum(windows.astype(np.int64) * self.capacity, self.total)
        out = np.zeros((len(goal), len(self.totals)), np.int64)
        out[goal >= self.total] = self.totals
        rows = np.flatnonzero((goal > 0) & (goal < self.total))
        # at `low` fewer tokens than wanted are due, at `high` enough; a few steps bring `low` near
        low = np.zeros(len(rows))
        high = np.full(len(rows), float(self._due(self.quanta - 1.0, self.pace)[self.totals > 0].max()) if len(rows) else 0.0)
        low_sum, high_sum = np.zeros(len(rows), np.int64), np.full(len(rows), self.total, np.int64)
        near = 4 * self.quantum
        for step in range(STEPS):
            far = np.flatnonzero(goal[rows] - low_sum > near)
            if not len(far):
                break
            aim = np.maximum(goal[rows[far]] - near // 2 - low_sum[far], 1) / np.maximum(high_sum[far] - low_sum[far], 1)
            guess = low[far] + (high[far] - low[far]) * (aim if step % 4 < 3 else 0.5)
            sums = self.due(guess, True).sum(axis=1)
            below = (sums < goal[rows[far]]) & (guess >= low[far])
            above = ~below & (guess < high[far])
            low[far[below]], low_sum[far[below]] = guess[below], sums[below]
            high[far[above]], high_sum[far[above]] = guess[above], sums[above]
        # the quanta after `low` one by one, in blocks of bounded size; where so many are too few, twice as many
        many = 8
        while len(rows):
            some = max(1, CELLS // (2 * many * len(self.totals)))
            left = []
            for i in range(0, len(rows), some):
                part = rows[i : i + some]
                out[part], found = self._after(low[i : i + some], goal[part], many)
                left.append(i + np.flatnonzero(~found))
            left = np.concatenate(left)
            rows, low, many = rows[left], low[left], 2 * many
        return out

    def _remembered(self, windows: np.ndarray) -> np.ndarray:
        """cuts() of sorted windows, which a task's next rows mostly need again; at most CELLS numbers are kept."""
        at = np.searchsorted(self._known, windows)
        new = windows[np.append(self._known, -1)[at] != windows]
        if len(new):
            if (len(self._known) + len(new)) * len(self.totals) > CELLS:
                self._known, self._known_cuts, new = windows, self.cuts(windows), new[:0]
            known = np.concatenate([self._known, new])
            order = np.argsort(known, kind="stable")
            self._known, self._known_cuts = known[order], np.concatenate([self._known_cuts, self.cuts(new)])[order]
            at = np.searchsorted(self._known, windows)
        return self._known_cuts[at]

    def _after(self, low: np.ndarray, goal: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each queue when `goal` are served, from `many` quanta of each queue after `low`; and whether so many do."""
        served = self.served(low, True)
        before = np.minimum(served * self.quantum, self.totals)
        quantum = served[:, :, None] + np.arange(many + 1)
        due = np.where(quantum < self.quanta[:, None], self._due(quantum, self.pace[:, None]), np.inf)
        size = np.clip(self.totals[:, None] - quantum[:, :, :many] * self.quantum, 0, self.quantum).reshape(len(low), -1)
        order = np.argsort(due[:, :, :many].reshape(len(low), -1), axis=1, kind="stable")
        inside = np.take_along_axis(size, order, axis=1)
        upto = np.cumsum(inside, axis=1)
        need = (goal - before.sum(axis=1))[:, None]
        served_now = np.zeros_like(size)
        np.put_along_axis(served_now, order, np.clip(need - (upto - inside), 0, inside), axis=1)
        last = np.minimum((upto < need).sum(axis=1), order.shape[1] - 1)
        at = np.take_along_axis(due[:, :, :many].reshape(len(low), -1), np.take_along_axis(order, last[:, None], axis=1), axis=1)[:, 0]
        found = (upto[:, -1:] >= need)[:, 0] & (at < due[:, :, many].min(axis=1))
        return before + served_now.reshape(len(low), -1, many).sum(axis=2), found

    def _before(self, v: np.ndarray, inclusive: bool) -> np.ndarray:
        """Tokens of all queues due before v (or at v too), in blocks of bounded size."""
        some = max(1, CELLS // len(self.rates))
        return np.concatenate([np.zeros(0, np.int64), *(self.due(v[i : i + some], inclusive).sum(axis=1) for i in range(0, len(v), some))])

    def _windows(self, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and window of every window that can hold a token of the spans [a, b) of queues q, in order."""
        first, last = a // self.quantum, (b - 1) // self.quantum
        w0 = self._before(self._due(first, self.pace[q]), False) // self.capacity
        w1 = (self._before(self._due(last, self.pace[q]), True) - 1) // self.capacity
        # a rare queue's span reaches over far more windows than it has quanta: there each quantum's windows are looked up
        wide = w1 - w0 + 1 > 2 * (last - first + 1)
        n = np.where(wide, 0, w1 - w0 + 1)
        row = np.repeat(np.arange(len(q)), n)
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + w0[row]
        if not wide.any():
            return row, window
        at = np.flatnonzero(wide)
        size = (last - first + 1)[at]
        owner = np.repeat(at, size)
        due = self._due(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[owner], self.pace[q[owner]])
        w0, w1 = self._before(due, False) // self.capacity, (self._before(due, True) - 1) // self.capacity
        n = w1 - w0 + 1
        row = np.concatenate([row, np.repeat(owner, n)])
        window = np.concatenate([window, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w0, n)])
        return tuple(np.unique(np.stack([row, window]), axis=1))

    def pieces(self, queue: np.ndarray, first: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        """Cut spans [first, first + length) of queues at window borders: row, start, length, window, offset."""
        rows = np.flatnonzero(length > 0)
        q, a, b = queue[rows], first[rows], first[rows] + length[rows]
        row, window = self._windows(q, a, b)
        some = max(1, CELLS // (2 * len(self.rates)))
        parts = [self._cut(rows, q, a, b, row[i : i + some], window[i : i + some]) for i in range(0, max(len(row), 1), some)]
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def _cut(self, rows: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, window: np.ndarray) -> dict[str, np.ndarray]:
        known, at = np.unique(np.concatenate([window, window + 1]), return_inverse=True)
        cut = self._remembered(known)
        here, after = at[: len(window)], at[len(window) :]
        low, high = cut[here, q[row]], cut[after, q[row]]
        start, end = np.maximum(low, a[row]), np.minimum(high, b[row])
        keep = end > start
        size = cut[after[keep]] - cut[here[keep]]
        before = (np.cumsum(size, axis=1) - size)[np.arange(len(size)), q[row[keep]]]
        return {"row": rows[row[keep]], "start": (start - a[row])[keep], "length": (end - start)[keep], "window": window[keep], "offset": before + (start - low)[keep]}


def encode_documents(docs: DataFrame, path: str, *, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """Every document's ids with the end id, staged: id, source, part, before, n, ids (little-endian, 16 or 32 bits).

    before counts the tokens of the same source earlier in the same partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe, part, seen = tokenizer(path), TaskContext.get().partitionId(), {}
        wide = "<u4" if max(len(bpe.bytes_of), end_id + 1) > 1 << 16 else "<u2"
        width = int(wide[-1])
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                ids, offsets = bpe.encode(texts)
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                sizes = np.diff(offsets)
                sources = [x or "" for x in batch.column(2).slice(first, len(texts)).to_pylist()]
                before = np.zeros(len(texts), np.int64)
                for i, (s, n) in enumerate(zip(sources, sizes.tolist(), strict=True)):
                    before[i] = seen.get(s, 0)
                    seen[s] = before[i] + n
                raw = ids.astype(wide).tobytes()
                yield {
                    "id": batch.column(0).slice(first, len(texts)),
                    "source": pa.array(sources, pa.string()),
                    "part": np.full(len(texts), part, np.int32),
                    "before": before,
                    "n": sizes,
                    "ids": pa.array([raw[width * a : width * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.binary()),
                    "wide": np.full(len(texts), width == 4),
                }

    rows = only(docs, id=id_col, text=text_col, source=source_col).withColumn("source", F.col("source").cast("string"))
    return staged(map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, source string, part int, before long, n long, ids binary, wide boolean"))


def _place(encoded: DataFrame, target: Mapping[str, float] | None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Rows with their queue and place in it, and each queue's (total, rate)."""
    cells = encoded.groupBy("part", "source").agg(F.sum("n").alias("n"))
    by_source = cells.groupBy("source").agg(F.sum("n").alias("n"))
    found = {r["source"]: r["n"] for r in by_source.collect()}
    queues = sorted(found)
    numbers = cells.sparkSession.createDataFrame(list(zip(queues, range(len(queues)), strict=True)), "source string, queue int")
    cells = cells.join(F.broadcast(numbers) if len(queues) <= BROADCAST_CELLS else numbers, "source")
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("part", "source", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    few = cells.count() <= BROADCAST_CELLS
    placed = encoded.join(F.broadcast(base) if few else base, ["part", "source"])
    rest = 1.0 if not target else min(v for v in target.values() if v > 0)
    counts = [found[q] for q in queues] or [0]
    rates = [float(max(n, 1)) if not target else float(target.get(q, 0) or rest * 1e-3) for q, n in zip(queues or [""], counts, strict=True)]
    return placed, list(zip(counts, rates, strict=True))


def pack(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 1, target: Mapping[str, float] | None = None, quantum: int = QUANTUM, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack every document's tokens (then end_id) into windows of `capacity` tokens with the target mixture of sources.

    target gives rates by source; by default each source's share of the corpus, so that all run dry together. Sources
    without a rate get a thousandth of the smallest one. Every source is a queue of its own, however many there are, and
    is served `quantum` tokens at a time: a smaller quantum holds the shares closer, a larger one cuts rare sources less.

    Returns one row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (array<int>) if
    with_ids. Null text counts as empty (one token, the end id), null source as ''; repeated rows are packed each; an
    empty table gives no piece; only the last window can be short.
    """
    placed, queues = _place(encode_documents(docs, path, id_col=id_col, text_col=text_col, source_col=source_col, end_id=end_id), target)
    totals, rates = np.array([n for n, _ in queues]), np.array([r for _, r in queues])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        mixture = Mixture(totals, rates, capacity, quantum)
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                q, a, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                got = mixture.pieces(q, a, n)
                ids = [np.frombuffer(x, "<u4" if w else "<u2").astype("<u4") for x, w in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                cut = [ids[r][s : s + m] for r, s, m in zip(got["row"].tolist(), got["start"].tolist(), got["length"].tolist(), strict=True)]
                out = {
                    id_col: batch.column(0).take(pa.array(got["row"])),
                    "start": got["start"],
                    "length": got["length"],
                    "ids_crc32": np.array([zlib.crc32(x) for x in cut], np.int64),
                    "doc_tokens": n[got["row"]],
                    "sequence_id": got["window"],
                    "offset": got["offset"],
                }
                if with_ids:
                    flat = np.concatenate([*cut, np.zeros(0, "<u4")]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(got["length"])]).astype(np.int32)), pa.array(flat))
                yield out

    rows = placed.select("id", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids", "wide")
    return map_arrow(rows, run, f"{id_col} {dict(docs.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, *, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed windows themselves: sequence_id, tokens (padded to capacity), n_tokens. Needs pack(with_ids=True).

    Pieces hold neither nulls nor overlaps, so each window is one group of at most capacity tokens; no piece, no window.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("tokens"))
    return rows.select("sequence_id", F.concat("tokens", F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size("tokens"))).alias("tokens"), F.size("tokens").alias("n_tokens"))
