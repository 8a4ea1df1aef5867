"""Toxicity classifier with counterfactual regularisation.

Logistic regression over the presence of words and of word beginnings (4 and 5 letters, which catch inflected and
invented forms), fitted on a bounded sample of labelled texts. Labelled sentences yield counterfactuals in which an
identity term is replaced by others of its kind or by nothing; the fit pays for the squared change of the score between
them, so a mention cannot carry a verdict of its own.

**Identity terms** are a fixed list of group names and, since a corpus names its own groups, terms found in it: frequent
words that occur at like rates in texts of both labels and stand in the same slots (between the same two words) as others
of them. Words that share slots are each other's replacements.

Counting features and terms, looking for slots and building the design run where the sample lies; the driver gets the
chosen features and terms (bounded numbers) and the columns that are present in each sampled text.

Scoring hashes a text's words where they stand and looks the hashes up in the model's sorted feature table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import _LETTER, _classes
from .common import batches_of, code_points, keep_rows, map_arrow, only, span_hashes, staged

#: Labelled texts in the fitting sample: of each class at most so many, those of lowest hash.
SAMPLE_PER_CLASS = 5000
#: A feature is kept if its chi-squared statistic against the label reaches this, and at most so many of them.
MIN_CHI2, MAX_FEATURES = 20.0, 20_000
#: Strength of the counterfactual penalty and of the ridge penalty, and gradient steps.
COUNTERFACTUAL, RIDGE, STEPS = 20.0, 3e-5, 600
#: Group terms whose exchange must not change a score.
IDENTITY_TERMS = (
    "women men muslims muslim christians christian jews jewish hindus buddhists atheists immigrants refugees foreigners gay lesbian "
    "bisexual transgender straight black white asian african european arab latino disabled deaf blind old young femmes hommes musulmans "
    "juifs immigrés frauen männer muslime juden flüchtlinge ausländer mujeres hombres musulmanes judíos inmigrantes"
).split()
#: Terms found in the corpus: in this part of the texts of either label at least, at rates that differ by less than this
#: factor, sharing so many slots with another; at most so many.
TERM_SHARE, TERM_RATIO, TERM_SLOTS, MAX_TERMS = 0.005, 1.5, 3, 256
#: Mentions of each sampled text that yield counterfactuals (those of lowest hash), and replacements for each.
MENTIONS, REPLACEMENTS = 6, 2
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")

Swaps = dict[str, list[str]]


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    pairs: int = 0  # counterfactuals in the fit
    active: int = 0  # those of which the two sides differ in a feature


@lru_cache(1)
def _lower() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and len(x := chr(i).lower()) == 1:
            out[i] = ord(x)
    return out


def features_of(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every distinct word and word beginning of each text."""
    points, offsets = code_points(texts)
    points = _lower()[points]
    letter = np.concatenate([np.zeros(1, bool), _classes()[points] == _LETTER, np.zeros(1, bool)])
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
    ends = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
    row = np.searchsorted(offsets, starts, "right") - 1
    rows, hashes = [row], [span_hashes(points, starts, ends)]
    for k in (4, 5):
        long = ends - starts > k
        rows.append(row[long])
        hashes.append(span_hashes(points, starts[long], starts[long] + k) ^ np.uint64(k << 56))
    return np.concatenate(rows), np.concatenate(hashes)


def _matrix(texts: Sequence[str], features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) pairs, once each, of the model's features present in the texts."""
    row, found = features_of(texts)
    if not len(features):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(features, found), len(features) - 1)
    hit = features[at] == found
    pair = np.unique(row[hit] * len(features) + at[hit])
    return pair // len(features), pair % len(features)


def ring(terms: Sequence[str]) -> Swaps:
    """Each term's replacements among a list of terms of one kind."""
    n = len(terms)
    return {t: list(dict.fromkeys(x for x in (terms[(i + 1) % n], terms[(i + n // 2) % n]) if x != t))[:REPLACEMENTS] for i, t in enumerate(terms)}


def counterfactuals(text: str, swaps: Swaps, most: int = MENTIONS) -> list[tuple[str, str]]:
    """Sentences of the text that mention a term, each with the mention replaced by the term's others and by nothing.

    Of more than `most` mentions those of lowest hash are taken.
    """
    mentions = []
    for sentence in _SENTENCE.findall(text):
        for k, m in enumerate(_WORD.finditer(sentence)):
            if m[0].lower() in swaps:
                mentions.append((zlib.crc32(f"{k} {sentence}".encode("utf-8", "replace")), len(mentions), sentence, m))
    out = []
    for _, _, sentence, m in sorted(mentions, key=lambda x: x[:2])[:most]:
        out += [(sentence, sentence[: m.start()] + other + sentence[m.end() :]) for other in (*swaps[m[0].lower()], "")]
    return out


def _feature_counts(texts: Sequence[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hash, label, and the number of texts of that label which have the feature."""
    row, found = features_of(texts)
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
    parts = [(*np.unique(found[once & (y[row] == k)], return_counts=True), k) for k in (0, 1)]
    return np.concatenate([h for h, _, _ in parts]), np.repeat([0, 1], [len(h) for h, _, _ in parts]), np.concatenate([c for _, c, _ in parts])


def _word_counts(texts: Sequence[str], y: np.ndarray) -> Counter:
    """(word, label): texts of that label with the word."""
    return Counter((w, int(k)) for x, k in zip(texts, y, strict=True) for w in {m.lower() for m in _WORD.findall(x)})


def _slots(texts: Sequence[str], terms: set[str]) -> set[tuple[str, str, str]]:
    """(word before, word after, term) of every place of a term inside a sentence."""
    out = set()
    for x in texts:
        for sentence in _SENTENCE.findall(x):
            words = [w.lower() for w in _WORD.findall(sentence)]
            out.update((a, b, t) for a, t, b in zip(words, words[1:], words[2:], strict=False) if t in terms)
    return out


def _swaps(shared: Sequence[tuple[str, str, int]]) -> Swaps:
    """Replacements of each term: those with which it shares the most slots. `shared`: (term, term, slots), each pair once."""
    near: dict[str, list] = {}
    for a, b, n in shared:
        near.setdefault(a, []).append((-n, b))
        near.setdefault(b, []).append((-n, a))
    return {t: [x for _, x in sorted(others)[:REPLACEMENTS]] for t, others in near.items()}


def _with_mentions(features: np.ndarray, swaps: Swaps) -> np.ndarray:
    """The features, and those of the terms: a mention may be scored, and the counterfactuals see to it that it is not."""
    return np.union1d(features, features_of(sorted(swaps))[1])


class Design(NamedTuple):
    """Present columns (row, column) of the texts, and the columns (pair, column, sign) that only one side of each
    counterfactual has: 1 for the original, -1 for the other."""

    row: np.ndarray
    col: np.ndarray
    texts: int
    pair: np.ndarray
    own: np.ndarray
    sign: np.ndarray
    pairs: int


def _design(texts: Sequence[str], features: np.ndarray, swaps: Swaps) -> Design:
    pairs = [p for x in texts for p in counterfactuals(x, swaps)]
    row, col = _matrix(texts, features)
    width = max(len(features), 1)
    left, right = (np.array(r * width + c, np.int64) for r, c in (_matrix([p[i] for p in pairs], features) for i in (0, 1)))
    first, second = np.setdiff1d(left, right, assume_unique=True), np.setdiff1d(right, left, assume_unique=True)
    key, sign = np.concatenate([first, second]), np.repeat([1, -1], [len(first), len(second)])
    order = np.argsort(key, kind="stable")
    return Design(row, col, len(texts), key[order] // width, key[order] % width, sign[order], len(pairs))


def _solve(features: np.ndarray, design: Design, y: np.ndarray, counterfactual: float) -> Model:
    n, positive, pairs = len(y), float(y.sum()), design.pairs
    row, col, pair, own, sign = design.row, design.col, design.pair, design.own, design.sign
    weights, bias = np.zeros(len(features)), 0.0
    cost = np.where(y > 0, 0.5 / positive, 0.5 / (n - positive))  # both classes weigh the same
    square = np.full(len(features) + 1, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(row, weights[col], n) + bias
        error = (1 / (1 + np.exp(-z)) - y) * cost
        grad = np.bincount(col, error[row], len(features)) + RIDGE * weights
        if len(pair) and counterfactual:
            change = np.bincount(pair, sign * weights[own], pairs) * (2 * counterfactual / pairs)
            grad += np.bincount(own, sign * change[pair], len(features))
        grad = np.append(grad, error.sum())
        square += grad**2
        step = 0.5 * grad / np.sqrt(square)
        weights -= step[:-1]
        bias -= step[-1]
    return Model(features, weights, bias, pairs, len(np.unique(pair)))


def mean_change(model: Model, texts: Sequence[str], swaps: Swaps) -> float:
    """Mean change of the score between the two sides of the texts' counterfactuals."""
    pairs = [p for x in texts for p in counterfactuals(x, swaps)]
    return float(np.abs(scores([a for a, _ in pairs], model) - scores([b for _, b in pairs], model)).mean()) if pairs else 0.0


def _one_sided(n: int, positive: float) -> Model:
    """What is known where the labels are all alike or absent: the bias."""
    return Model(np.zeros(0, np.uint64), np.zeros(0), 4.0 if n and positive else -4.0)


def fit(texts: Sequence[str], labels: Sequence[int], *, terms: Sequence[str] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """train() for texts in memory: the same counts, terms and design without a table."""
    y = np.asarray(labels, np.int64)
    n, positive = len(y), int(y.sum())
    if not n or not 0 < positive < n:
        return _one_sided(n, positive)
    h, k, c = _feature_counts(texts, y)
    kinds, at = np.unique(h, return_inverse=True)
    count, hits = np.bincount(at, c, len(kinds)), np.bincount(at, c * k, len(kinds))
    some = count < n
    chi2 = np.zeros(len(kinds))
    chi2[some] = n * (hits * n - count * positive)[some] ** 2 / (positive * (n - positive) * (count * (n - count))[some])
    keep = np.flatnonzero(chi2 >= MIN_CHI2)
    features = np.sort(kinds[keep[np.lexsort((kinds[keep], -chi2[keep]))[:MAX_FEATURES]]])
    rates: dict[str, list[float]] = {}
    for (w, label), m in _word_counts(texts, y).items():
        rates.setdefault(w, [0.0, 0.0])[label] = m / (positive if label else n - positive)
    own = sorted((w for w, (a, b) in rates.items() if min(a, b) >= TERM_SHARE and max(a, b) < TERM_RATIO * min(a, b)), key=lambda w: (-sum(rates[w]), w))[:MAX_TERMS]
    by_slot: dict[tuple[str, str], list[str]] = {}
    for a, b, t in sorted(_slots(texts, set(own))):
        by_slot.setdefault((a, b), []).append(t)
    shared = Counter(pair for found in by_slot.values() for pair in combinations(found, 2))
    swaps = _swaps([(*p, m) for p, m in shared.items() if m >= TERM_SLOTS]) | ring(terms)
    features = _with_mentions(features, swaps)
    return _solve(features, _design(texts, features, swaps), y, counterfactual)


def sample_of(docs: DataFrame, labels: DataFrame, where: Column, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, y of the fitting sample, staged: at most SAMPLE_PER_CLASS labelled documents of each class, the lowest by hash
    of the id. Labels of no document and null ids or labels take no place; an id that is labelled both ways counts as
    positive; of several documents with one id the text that sorts first stands for them."""
    y = f"{id_col} label"
    known = only(labels, **{id_col: id_col, y: label_col}).where(where).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{y}`").cast("int").alias("y"))
    known = known.where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    rows = only(docs, id=id_col, text=text_col)
    known = known.join(rows.select("id"), "id", "left_semi")
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CLASS) for k in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * SAMPLE_PER_CLASS rows at most
    return staged(rows.join(sample, "id").groupBy("id", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).select("text", "y"))


def _in_tasks(sample: DataFrame, fn: Callable[[list[str], np.ndarray], dict], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                yield fn(texts, batch.column(1).slice(first, len(texts)).to_numpy().astype(np.int64))

    return map_arrow(sample, run, schema)


def train(docs: DataFrame, labels: DataFrame, where: Column, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", terms: Sequence[str] = IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on the sample (see sample_of) of labelled documents that meet `where`.

    `where` sees the labels' id under its own name. Null text counts as empty; without labels of both kinds the model is a
    bias towards the kind that there is, or towards 0. Other columns are ignored, also those whose names clash.
    """
    sample = sample_of(docs, labels, where, label_col=label_col, id_col=id_col, text_col=text_col)
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or not 0 < positive < n:
        return _one_sided(n, positive)

    def features_in(texts: list[str], y: np.ndarray) -> dict:
        h, k, c = _feature_counts(texts, y)
        return {"h": h.view(np.int64), "y": k.astype(np.int32), "c": c.astype(np.int64)}

    counts = _in_tasks(sample, features_in, "h long, y int, c long").groupBy("h").agg(F.sum("c").cast("double").alias("c"), F.sum(F.col("c") * F.col("y")).cast("double").alias("a"))
    chi2 = n * F.pow(F.col("a") * n - F.col("c") * positive, 2) / (F.lit(float(positive * (n - positive))) * F.col("c") * (n - F.col("c")))
    best = counts.where(F.col("c") < n).select("h", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "h").limit(MAX_FEATURES)
    features = np.sort(np.array([r["h"] for r in best.collect()], np.int64).view(np.uint64))

    def words_in(texts: list[str], y: np.ndarray) -> dict:
        found = _word_counts(texts, y)
        return {"word": pa.array([w for w, _ in found], pa.string()), "y": np.array([k for _, k in found], np.int32), "c": np.array([*found.values()], np.int64)}

    rates = _in_tasks(sample, words_in, "word string, y int, c long").groupBy("word").agg(*[(F.sum(F.when(F.col("y") == k, F.col("c")).otherwise(0)) / m).alias(f"r{k}") for k, m in ((0, n - positive), (1, positive))])
    low, high = F.least("r0", "r1"), F.greatest("r0", "r1")
    own = {r["word"] for r in rates.where((low >= TERM_SHARE) & (high < TERM_RATIO * low)).orderBy(F.desc(F.col("r0") + F.col("r1")), "word").limit(MAX_TERMS).collect()}

    def slots_in(texts: list[str], y: np.ndarray) -> dict:
        found = [*_slots(texts, own)]
        return {k: pa.array([x[i] for x in found], pa.string()) for i, k in enumerate(("before", "after", "term"))}

    by_slot = _in_tasks(sample, slots_in, "before string, after string, term string").groupBy("before", "after").agg(F.array_sort(F.collect_set("term")).alias("terms")).where("size(terms) > 1")
    pairs = by_slot.select("terms", F.explode("terms").alias("a")).select("a", F.explode("terms").alias("b")).where("a < b")
    swaps = _swaps([(r["a"], r["b"], r["n"]) for r in pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= TERM_SLOTS).collect()]) | ring(terms)

    features = _with_mentions(features, swaps)

    def design_in(texts: list[str], y: np.ndarray) -> dict:
        d = _design(texts, features, swaps)

        def lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))

        # a counterfactual's columns carry their sign: column + 1, or its negative
        return {
            "y": pa.concat_arrays([pa.array(y.astype(np.int32)), pa.array([None] * d.pairs, pa.int32())]),
            "columns": pa.concat_arrays([lists(d.row, d.col, d.texts), lists(d.pair, d.sign * (d.own + 1), d.pairs)]),
        }

    # present columns of the sample, and what differs in its counterfactuals: bounded by the sample and MENTIONS
    got = _in_tasks(sample, design_in, "y int, columns array<int>").toArrow()
    is_text = pa.compute.is_valid(got["y"])
    texts, others = got.filter(is_text), got.filter(pa.compute.invert(is_text))

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        column = column.combine_chunks()
        return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten().to_numpy().astype(np.int64)

    pair, signed = flat(others["columns"])
    design = Design(*flat(texts["columns"]), texts.num_rows, pair, np.abs(signed) - 1, np.sign(signed), others.num_rows)
    return _solve(features, design, texts["y"].to_numpy().astype(np.int64), counterfactual)


def scores(texts: Sequence[str], model: Model) -> np.ndarray:
    row, col = _matrix(texts, model.features)
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, model.weights[col], len(texts)) + model.bias, -500, 500)))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: id, score (0 to 1), predicted (1 from the threshold on).

    Null counts as empty; a text without any of the model's features gets the score of the bias alone. Repeated rows give
    repeated results; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        m = shared.value
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                value = scores(texts, m)
                yield {"id": batch.column(0).slice(first, len(texts)), "score": value, "predicted": (value >= threshold).astype(np.int32)}

    rows = only(docs, id=id_col, text=text_col)
    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, model: Model, *, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns. Null text counts as empty, repeated rows
    stay or go together, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: scores(texts, shared.value) < threshold, text_col)
