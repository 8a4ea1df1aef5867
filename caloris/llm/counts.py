"""Token counts as delta-maintained rollups.

Totals by (source, lang, version of the tokenizer) are kept in a store. A batch brings signed rows: an insert adds a
document and its tokens, a delete takes both away, a revision replaces a count by another. A batch is first summed by key
(partial sums before the shuffle, so a hot source costs one row a task), then added to the last state; the new state is
written beside the old one and becomes current when the file of the next version number appears. That file names its batch
and its state and is renamed into place, which fails if another writer was first: the loser adds its batch to the state
that won. A batch that is delivered again finds itself among the commits and changes nothing; one that died before its
commit is done anew.

Tokens are counted once, by real tokenizers over whole texts (`token_counts`); batches carry the counts on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bpe import tokenizer
from .common import batches_of, map_arrow, only, scratch, staged

KEYS = ("source", "lang", "version")
_STATE = "source string, lang string, version string, documents long, tokens long"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@lru_cache(4)
def counter(path: str, pattern: str) -> Callable[[list[str]], np.ndarray]:
    """Numbers of tokens of texts under a vocabulary file: .json through the streaming transducer, .tiktoken (ranks; pieces
    by `pattern`) through the library, in which strings of special tokens are ordinary text."""
    if path.endswith(".json"):
        bpe = tokenizer(path)
        return lambda texts: np.diff(bpe.encode(texts)[1])
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: np.array([len(encoding.encode_ordinary(x)) for x in texts], np.int64)


def token_counts(docs: DataFrame, versions: Mapping[str, str], pattern: str, revise: Callable[[str], str] | None = None, *, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """source, lang, words, and n_<version> for every row; with `revise` also r_<version>, the counts of the revised text.

    Null text counts as empty. Repeated rows are counted each, other columns are ignored, an empty table gives no row.
    """
    kinds = ["n", "r"] if revise else ["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                out = {"source": batch.column(1).slice(first, len(texts)), "lang": batch.column(2).slice(first, len(texts))}
                out["words"] = np.array([sum(1 for _ in _WORD.finditer(x)) for x in texts], np.int64)
                new = [revise(x) for x in texts] if revise else texts
                other = [i for i, (x, y) in enumerate(zip(texts, new, strict=True)) if x != y]
                for v, path in versions.items():
                    count = counter(path, pattern)
                    out[f"n_{v}"] = count(texts)
                    if revise:
                        out[f"r_{v}"] = out[f"n_{v}"].copy()
                        out[f"r_{v}"][other] = count([new[i] for i in other]) if other else 0
                yield out

    rows = only(docs, text=text_col, source=source_col, lang=lang_col).select("text", F.col("source").cast("string"), F.col("lang").cast("string"))
    return map_arrow(rows, run, "source string, lang string, words long, " + ", ".join(f"{k}_{v} long" for k in kinds for v in versions))


def signed(docs: DataFrame, counts: Mapping[str, Column], *, sign: int = 1, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Inserts (sign 1) or deletes (sign -1) of every document under each tokenizer version's count. Null counts are 0."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.coalesce(c, F.lit(0)).cast("long").alias("n")) for v, c in counts.items()]))
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"), rows.alias("c"))
    return rows.select("source", "lang", "c.version", F.lit(sign).cast("long").alias("documents"), (F.col("c.n") * sign).alias("tokens"))


def revised(docs: DataFrame, version: str, old: Column, new: Column, *, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Revisions of every document's count from old to new."""
    change = F.coalesce(new, F.lit(0)).cast("long") - F.coalesce(old, F.lit(0)).cast("long")
    return docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.lit(version).alias("version"), F.lit(0).cast("long").alias("documents"), change.alias("tokens"))


class RollupStore:
    """Versions of the totals under a folder that all executors share, for any number of writers."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(self._conf)

    def _commits(self) -> list[tuple[int, str, str]]:
        """(version, batch, folder of the state) of every commit, in order."""
        folder = self._at(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        rows = self.spark.read.text(f"{self.path}/commits", pathGlobFilter="[0-9]*").collect()
        return sorted((int(v), tag, state) for v, tag, state in (r.value.split(" ") for r in rows))

    @staticmethod
    def _tag(batch_id: str) -> str:
        return hashlib.sha256(batch_id.encode()).hexdigest()

    def _read(self, commits: list[tuple[int, str, str]]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], _STATE)
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/state/{commits[-1][2]}")

    def state(self) -> DataFrame:
        """Current totals: source, lang, version, documents, tokens; keys without documents and tokens are absent."""
        return self._read(self._commits())

    def _commit(self, version: int, tag: str, state: str) -> bool:
        """Make a state current unless another writer has taken its version number."""
        self._fs.mkdirs(self._at(f"{self.path}/commits"))
        draft = self._at(f"{self.path}/commits/.{state}")
        out = self._fs.create(draft, True)
        out.write(f"{version} {tag} {state}\n".encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"{self.path}/commits/{version:012d}")), never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of signed rows; False if this batch has been committed before."""
        sums = None
        while True:
            commits = self._commits()
            if self._tag(batch_id) in {tag for _, tag, _ in commits}:
                return False
            if sums is None:
                sums = staged(deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")))
            version = (commits[-1][0] if commits else 0) + 1
            both = self._read(commits).unionByName(sums).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            state = f"{version:012d}-{uuid.uuid4().hex}"
            both.where("documents <> 0 OR tokens <> 0").write.parquet(f"{self.path}/state/{state}")
            if self._commit(version, self._tag(batch_id), state):
                for _, _, old in commits[:-1]:  # readers may still hold the one before
                    self._fs.delete(self._at(f"{self.path}/state/{old}"), True)
                return True
            self._fs.delete(self._at(f"{self.path}/state/{state}"), True)


def token_rollup(docs: DataFrame, versions: Mapping[str, str], pattern: str, *, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """A life of a corpus in signed batches, as totals by source, lang and version.

    Batches: all documents under every tokenizer version; the same batch again, which changes nothing; a revision of each
    version's counts, as white space at the ends of texts goes; deletion of documents of fewer than five words, at their
    current counts. So what is left are the documents of five words or more at the counts of their revised texts. Null text
    counts as empty, null source and lang are keys of their own, repeated rows count each, an empty table has no totals,
    other columns are ignored.
    """
    spark = docs.sparkSession
    counted = staged(token_counts(docs, versions, pattern, str.strip, text_col=text_col, source_col=source_col, lang_col=lang_col))
    with scratch(spark, "rollup") as folder:
        store = RollupStore(spark, folder)
        inserts = signed(counted, {v: F.col(f"n_{v}") for v in versions})
        store.apply("insert", inserts)
        store.apply("insert", inserts)
        for v in versions:
            store.apply(f"revise {v}", revised(counted, v, F.col(f"n_{v}"), F.col(f"r_{v}")))
        store.apply("delete", signed(counted.where("words < 5"), {v: F.col(f"r_{v}") for v in versions}, sign=-1))
        return staged(store.state())
