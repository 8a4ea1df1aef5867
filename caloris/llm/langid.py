"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text recognises every substring of it. A text is
parsed greedily: the longest match becomes a phrase and the next one starts after it (Ziv-Merhav cross parsing).
Phrases times the log of the sample's length, per letter, estimate the cross entropy; the lowest wins.

The automata are dense tables in which "no such continuation" already leads to the restarted phrase, so one step is one
table look-up (automata of thousands of letters are searched instead). Texts are parsed whole, in blocks of BLOCK characters that advance side by side; a block's end ends a
phrase. Blocks keep the steps few and make one long text as cheap as many short ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import _LETTER, _classes
from .common import batches_of, code_points, keep_rows, map_arrow, only, settled, staged

#: Sample for each language: so many distinct labelled texts with a letter (those of lowest hash), a stretch of so many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 60, 300
#: Least number of classes; class 0 pads, 1 is all between words, the last is any letter that no sample holds.
ALPHABET = 64
#: Entries of a dense table; the automaton of a larger one (of thousands of letters) is a sorted list of its steps.
DENSE = 1 << 23
BLOCK = 512
UNDETERMINED = "und"


def training_sample(docs: DataFrame, train: Column, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Stretches of labelled texts by language: SAMPLE_TEXTS of SAMPLE_CHARS characters, whatever the table's size."""
    text = F.col(f"`{text_col}`")
    rows = settled(docs, text_col, lang_col).where(train & F.col(f"`{lang_col}`").isNotNull() & text.rlike(r"\p{L}"))
    key = F.xxhash64(text)
    at = F.pmod(F.xxhash64(text, F.lit(1)), F.greatest(F.length(text) - SAMPLE_CHARS + 1, F.lit(1))) + 1
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), key.alias("key"), text.substr(at.cast("int"), F.lit(SAMPLE_CHARS)).alias("stretch"))
    # copies of a text count once: the lowest hashes are found without their texts, of which few are then fetched
    # in parts of each language first, so that a language which has most texts is not one task's
    keys = rows.select("lang", "key", F.pmod("key", F.lit(64)).alias("part")).distinct()
    for by in (["lang", "part"], ["lang"]):
        keys = keys.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("rank") <= SAMPLE_TEXTS)
    keys = keys.drop("part")
    ranked = rows.join(F.broadcast(staged(keys)), ["lang", "key"]).groupBy("lang", "rank").agg(F.min("stretch").alias("stretch"))
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["stretch"])
    return out


class CrossParser:
    """Suffix automata of every language's sample over one alphabet."""

    def __init__(self, sample: tuple[tuple[str, str], ...]) -> None:
        self.languages = [k for k, _ in sample]
        letters = Counter(c for _, x in sample for c in x.lower() if _classes()[ord(c)] == _LETTER)
        own = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        size = max(ALPHABET, len(own) + 3)
        self.table = np.where(_classes() == _LETTER, size - 1, 1).astype(np.uint8 if size <= 256 else np.uint16 if size <= 1 << 16 else np.int32)
        for i, c in enumerate(own):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.table[ord(form)] = i + 2
        self.steps, self.weights = [], []
        for _, x in sample:
            seq = self.classes(code_points([x])[0])
            self.steps.append(_Steps(seq, size))
            self.weights.append(np.log2(max(len(seq), 2)))

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Classes of the letters, with one separator for each run of anything else."""
        got = self.table[points]
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != 1) | (got[:-1] != 1)
        return got[keep]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Estimated bits of each text (rows) in each language, and its letters."""
        points, offsets = code_points(texts)
        got = self.table[points]
        first = np.zeros(len(got) + 1, bool)
        first[offsets] = True
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != 1) | (got[:-1] != 1) | first[1:-1]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[offsets]
        seq = got[keep]
        sizes = np.diff(upto)
        lanes = -(-sizes // BLOCK)
        lane0 = np.cumsum(lanes) - lanes
        total = int(lanes.sum())
        bits = np.zeros((len(texts), len(self.languages)))
        letters = np.add.reduceat(np.append(seq > 1, False), np.minimum(upto[:-1], len(seq))).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        letters[sizes == 0] = 0
        if not total:
            return bits, letters
        place = np.arange(len(seq)) - np.repeat(upto[:-1], sizes)
        grid = np.zeros((BLOCK, total), seq.dtype)
        grid[place % BLOCK, np.repeat(lane0, sizes) + place // BLOCK] = seq
        owner = np.repeat(np.arange(len(texts)), lanes)
        used = min(BLOCK, int(sizes.max()))
        for k, (steps, weight) in enumerate(zip(self.steps, self.weights, strict=True)):
            bits[:, k] = np.bincount(owner, steps.phrases(grid[:used]), len(texts)) * weight
        return bits, letters

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language (-1: undetermined) and its margin."""
        bits, letters = self.parse(texts)
        score = np.ones(len(texts))
        if len(self.languages) > 1:
            two = np.sort(bits, axis=1)[:, :2]
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
        none = (letters == 0) | (not self.languages)
        return np.where(none, -1, bits.argmin(axis=1) if self.languages else -1), np.where(none, 0.0, np.clip(score, 0, 1))


class _Steps:
    """A language's automaton over the letters that its sample holds; any other letter ends a phrase."""

    def __init__(self, seq: np.ndarray, size: int) -> None:
        self.own = None
        self.size = size
        if size > ALPHABET:
            mine = np.unique(seq[seq > 1])
            self.size = len(mine) + 3
            self.own = np.full(size, self.size - 1, np.int32)
            self.own[:2] = 0, 1
            self.own[mine] = np.arange(len(mine)) + 2
            seq = self.own[seq]
        edges = _automaton(seq.tolist())
        self.dense = self.size * len(edges) <= DENSE
        if self.dense:
            self.table = _table(edges, self.size)
        else:
            self.root = np.zeros(self.size, np.int64)
            self.root[list(edges[0])] = list(edges[0].values())
            pairs = sorted((s * self.size + c, to) for s, out in enumerate(edges) for c, to in out.items())
            self.keys, self.to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))

    def phrases(self, grid: np.ndarray) -> np.ndarray:
        """Phrases of each column of classes."""
        count = np.ones(grid.shape[1], np.int32)
        state = np.zeros(grid.shape[1], np.int32 if self.dense else np.int64)
        for row in grid:
            if self.own is not None:
                row = self.own[row]
            if self.dense:
                state += row
                state = self.table[state]
                count += state & 1
                state >>= 1
            else:
                key = state * self.size + row
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                go, pad = self.keys[at] == key, row == 0
                count += ~(go | pad)
                state = np.where(pad, state, np.where(go, self.to[at], self.root[row]))
        return count


def _automaton(seq: list[int]) -> list[dict[int, int]]:
    """The steps from each state of the suffix automaton of seq."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in seq:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return edges


def _table(edges: list[dict[int, int]], size: int) -> np.ndarray:
    """An automaton as a flat table: [state * size + class] -> 2 * size * next + (1 if a phrase ends)."""
    states = np.zeros((len(edges), size), np.int32)
    root = np.zeros(size, np.int32)
    for c, to in edges[0].items():
        root[c] = to
    states[:] = 2 * size * root + 1
    for s, out in enumerate(edges):
        for c, to in out.items():
            states[s, c] = 2 * size * to
    states[:, 0] = 2 * size * np.arange(len(edges))  # padding stays where it is
    return states.ravel()


@lru_cache(2)
def _parser(sample: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(sample)


def train(docs: DataFrame, where: Column, *, text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """The model: each language's sample as one text. At most SAMPLE_TEXTS * SAMPLE_CHARS characters a language.

    Learns from rows that meet `where` and have a language and a text with a letter; copies of a text count once, and of
    texts with one hash the stretch that sorts first. Without such rows nothing is learnt. Other columns are ignored.
    """
    return tuple((k, "\n".join(v)) for k, v in sorted(training_sample(docs, where, text_col, lang_col).items()))


def identify(docs: DataFrame, model: tuple[tuple[str, str], ...], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: id, lang_pred, score.

    score is the winner's margin, 1 - bits / bits of the second best (1 if only one language is known). Null texts and
    texts without a letter are 'und' with score 0, as is everything if nothing was learned. Equal estimates go to the
    language that sorts first. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parser = _parser(model)
        names = np.array([*parser.languages, UNDETERMINED], object)
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                best, score = parser.best(texts)
                yield {"id": batch.column(0).slice(first, len(texts)), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": score}

    rows = only(docs, id=id_col, text=text_col)
    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def known_rows(docs: DataFrame, model: tuple[tuple[str, str], ...], *, languages: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text is in one of `languages` (by default any language learnt).

    Null texts and texts without a letter go; so does every row if nothing was learnt. Repeated rows stay or go together.
    """

    def good(texts: list[str]) -> np.ndarray:
        parser = _parser(model)
        best, _ = parser.best(texts)
        wanted = np.array([*(languages is None or x in languages for x in parser.languages), False])
        return wanted[best]

    return keep_rows(docs, good, text_col)
