"""Shared parts of the corpus operators: batch iteration, code-point views of text, hashing, staging."""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from caloris.session import checkpoint_dir, scratch, ship_package, staged  # noqa: F401  staging for all operators

#: Code points handled at once by the vectorised text code; bounds its memory to about 60 times this many bytes.
CHUNK_CHARS = 1 << 19

#: Most ids that are broadcast (8 bytes each, 40 as rows).
BROADCAST_IDS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = []


def keep_rows(docs: DataFrame, good: Callable[[list[str]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows whose text is good, with all their columns: `good` maps texts (null as '') to booleans."""
    ship_package(docs.sparkSession)
    at = settled(docs, text_col).columns.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in batches_of(batch, f"c{at}"):
                yield batch.slice(first, len(texts)).filter(pa.array(good(texts), pa.bool_()))
        give_back()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df in which the named columns can be told from all others: extra columns of the same name, or that differ from one
    only by letter case, get names of their own. The order of columns stays, so toDF(*df.columns) gives the names back."""
    chosen = {}
    for n in names:
        exact = [i for i, c in enumerate(df.columns) if c == n] or [i for i, c in enumerate(df.columns) if c.lower() == n.lower()]
        if not exact:
            raise ValueError(f"no column {n} among {df.columns}")
        chosen[exact[0]] = n
    low = {n.lower() for n in names}
    return df.toDF(*[chosen.get(i) or (f"extra {i} {c}" if c.lower() in low else c) for i, c in enumerate(df.columns)])


def only(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns `wanted` (new name=name in df), so that extra columns never meet an operator's own."""
    at = settled(df, *dict.fromkeys(wanted.values()))
    return at.select(*[F.col(f"`{n}`").alias(new) for new, n in wanted.items()])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """mapInArrow where fn yields dicts of columns (numpy arrays, lists or arrow arrays)."""
    names = [f.split()[0] for f in _fields(schema)]
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], (pa.Array, pa.ChunkedArray)) else pa.array(x) for n in names], names=names)
        give_back()

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [x.strip() for x in [*out, schema[start:]]]


def batches_of(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of at most `limit` characters (one row at least): first row, texts with null as ''.

    Texts become Python strings a few rows at a time, so a batch of long texts is not held twice.
    """
    column = batch.column(batch.schema.get_field_index(text))
    run: list[str] = []
    start = size = 0
    for at in range(0, len(column), 128):
        for i, x in enumerate(column.slice(at, 128).to_pylist(), at):
            x = x or ""
            if run and size + len(x) > limit:
                yield start, run
                run, start, size = [], i, 0
            run.append(x)
            size += len(x)
    if run:
        yield start, run


def give_back() -> None:
    """Return freed memory to the system: workers are reused and an executor's budget counts all of them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the offsets (one more than texts) at which each text starts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


class Spans:
    """64-bit hashes of spans [start, end) of one code-point array: equal spans have equal hashes."""

    def __init__(self, points: np.ndarray) -> None:
        up, self.down = _power_table(len(points) + 1)
        with np.errstate(over="ignore"):
            terms = (points.astype(np.uint64) + np.uint64(1)) * _MIX
            terms ^= terms >> np.uint64(29)
            terms *= up[: len(points)]
            self.total = np.zeros(len(points) + 1, np.uint64)
            np.cumsum(terms, out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(points).hashes(starts, ends)


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def distinct_spans(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, spans: Spans | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One representative of each distinct span, each span's representative, and the representatives' hashes.

    Spans are told apart by hash and then compared with their representative; if two ever collide, each span stands for
    itself, which callers must allow for.
    """
    hashes = (spans or Spans(points)).hashes(starts, ends)
    _, chosen, kind = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends - starts
    if not np.array_equal(lengths[chosen][kind], lengths) or not np.array_equal(points[expand(starts[chosen][kind], lengths)], points[expand(starts, lengths)]):
        chosen = kind = np.arange(len(starts))
    return chosen, kind, hashes[chosen]


#: What the corpus contracts call white space: space and U+0009 to U+000D.
def is_blank(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


def words_of(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-blank characters: starts, ends, and offsets of each text's words."""
    solid = ~is_blank(points)
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([np.zeros(1, bool), solid])
    after = np.concatenate([solid, np.zeros(1, bool)])
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(points: np.ndarray) -> np.ndarray:
    return points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))


def drop_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids in `dropped` (one column); broadcast only if they are few, else joined by a shuffle.

    A null id is never dropped; repeated rows of an id stay or go together. Columns of any name are kept as they are.
    """
    at = settled(docs, id_col).columns.index(id_col)
    gone = dropped.toDF("gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.join(F.broadcast(gone) if few else gone, F.col(f"c{at}") == F.col("gone"), "left_anti").toDF(*docs.columns)


def crc_of_id(column: str = "doc_id") -> F.Column:
    """crc32 of an id's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary"))


def crc_ids(ids: Iterable[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.int64)


class Bloom:
    """A Bloom filter of binary keys (16 bytes or more, already random), of bounded size: too small for its keys it only
    lets more through."""

    BITS_PER_KEY, MAX_BITS, PROBES = 16, 1 << 29, 4

    def __init__(self, words: np.ndarray, log2: int) -> None:
        self.words, self.log2 = words, log2

    @staticmethod
    def _bits(keys: Sequence[bytes], log2: int) -> np.ndarray:
        head = np.frombuffer(b"".join(k[:8] for k in keys), "<u8")
        with np.errstate(over="ignore"):
            return (mix64(head[:, None] + np.arange(Bloom.PROBES, dtype=np.uint64) * _MIX) >> np.uint64(64 - log2)).astype(np.int64)

    @classmethod
    def holds(cls, n: int) -> bool:
        """Whether a filter of n keys still tells them from others (half the bits for each key are enough)."""
        return 2 * n * cls.PROBES <= cls.MAX_BITS

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Bloom:
        """Built where the keys are; only the OR of its words reaches the driver, MAX_BITS at most."""
        n = keys.count()
        log2 = max(10, min(cls.MAX_BITS.bit_length() - 1, (max(1, n) * cls.BITS_PER_KEY).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                bits = np.unique(cls._bits(batch.column(0).to_pylist(), log2))
                word, first = np.unique(bits >> 6, return_index=True)
                values = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64)), first) if len(first) else np.zeros(0, np.uint64)
                yield {"word": word, "bits": values.view(np.int64)}

        rows = map_arrow(keys.select(column), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(1 << (log2 - 6), np.uint64)
        words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(words, log2)

    def test(self, keys: Sequence[bytes]) -> np.ndarray:
        bits = self._bits(keys, self.log2)
        return ((self.words[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
