"""The registered corpus queries: oracles, brute force, messy input."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from compare import connect, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from caloris.llm import bpe, counts, exact, langid, lm, minhash, packing, queries, topk, toxicity, urls
from caloris.llm.common import crc_of_id

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, id string, score double"
LIBRARY = Tokenizer.from_file(queries.TOKENIZER)


def tokens(text: str | None) -> list[int]:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark) -> pd.DataFrame:
    return spark.read.parquet(f"{DATA}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    rows = [(1, "the same text of some words here", "en", "a"), (2, "the same text of some words here", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, long, "en", "a"), (6, "x", "fr", "b"), (6, "x", "fr", "b"), (None, "no id", "en", None), (None, "no id", "en", None), (7, " \n\t ", "de", "a"), (8, "123 !!", "de", "a"), (9, "<|endoftext|> scum", "en", "")]
    return spark.createDataFrame([(*r, 0, "k", "i", 0.5) for r in rows], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), connect(DATA).execute(queries.ORACLES[name]).df())


def classes(texts: dict[int, str], threshold: float = 0.8) -> dict[int, int]:
    sets = {}
    for i, x in texts.items():
        w = x.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_near_dedup_equals_brute_force(spark, docs):
    got = queries.op1_minhash_dedup(spark, DATA).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == classes(dict(zip(docs.doc_id, docs.text, strict=True)))


def test_near_dedup_links_copies_that_only_meet_through_an_origin(spark):
    """Copies are like their origin but not like each other; whoever leads a bucket, all end in one class."""
    rng = np.random.default_rng(8)
    origin = [f"o{i}" for i in range(300)]
    rows = [(99, " ".join(origin))]
    for n in range(40):
        w = origin.copy()
        for k in rng.choice(300, 6, replace=False):
            w[k] = f"c{n}_{k}"
        rows.append((n, " ".join(w)))
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == classes(dict(rows))


def test_near_dedup_links_copies_of_which_one_repeats_a_passage(spark):
    """A passage of 100 shingles stands once in one text and 200 times in the other; the sets of shingles stay alike."""
    rows = []
    for n in range(40):
        common = [f"w{n}_{k}" for k in range(320)]
        rows.append((2 * n, " ".join([*common, *(f"a{n}_{k}" for k in range(28))])))
        rows.append((2 * n + 1, " ".join([*common[:104] * 200, *common, *(f"b{n}_{k}" for k in range(22))])))
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    want = classes(dict(rows))
    assert len(set(want.values())) == 40 and dict(zip(got.doc_id, got.class_id, strict=True)) == want


def test_near_dedup_with_few_strays_in_a_large_bucket_and_small_blocks(spark, monkeypatch):
    """Sixty near copies of one text and three of another that shares its beginning; blocks hold few texts."""
    rng = np.random.default_rng(3)
    one = [f"o{i}" for i in range(200)]
    two = one[:150] + [f"t{i}" for i in range(60)]
    rows = []
    for n in range(63):
        w = (one if n < 60 else two).copy()
        for k in rng.choice(150, 3, replace=False):
            w[k] = f"c{n}_{k}"
        rows.append((n, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "LEAST_ESTIMATE", 0.95)  # leaders connect little, so the exact comparison has to
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == classes(dict(rows))
    monkeypatch.setattr(minhash.Bloom, "MAX_BITS", 8)  # too small a filter: the join on ids
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == classes(dict(rows))


def test_weighted_near_dedup_follows_occurrences(spark):
    """The sets of shingles are alike; the numbers of occurrences are alike only in the first pair."""
    words = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(words * 2)), (1, " ".join(words * 2 + words[:3])), (2, " ".join(words[:40] * 60 + words)), (3, " ".join(words + words[80:] * 60))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_dedup(table, weighted=True).toPandas()
    assert dict(zip(got.doc_id, got.class_id, strict=True)) == {0: 0, 1: 0, 2: 2, 3: 3}


def test_exact_dedup_with_colliding_digests(spark):
    rows = [(i, f"text {i % 40}") for i in range(200)]
    got = exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), digest_bytes=1).toPandas()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got.itertuples()} == {i: (160 + i % 40, 5, i >= 160) for i, _ in rows}


def test_exact_dedup_of_messy_rows(spark, messy):
    got = exact.exact_dedup(messy).toPandas()
    assert len(got) == 12 and got[got.doc_id == 6].kept.sum() == 1 and got[got.doc_id.isna()].kept.sum() == 1
    assert got[got.doc_id == 1].keep_id.item() == 2 and got[got.doc_id == 3].keep_id.item() == 4
    assert got[got.doc_id == 4].text_sha256.item() == hashlib.sha256(b"").hexdigest()
    least = exact.exact_dedup(messy, keep="min").toPandas()
    assert least[least.doc_id == 2].keep_id.item() == 1
    assert exact.survivors(messy).count() == 10


def test_packing(spark, docs):
    got = queries.op4_packing(spark, DATA).toPandas()
    ids = {i: np.array([*tokens(x), 1], "<u4") for i, x in zip(docs.doc_id, docs.text, strict=True)}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in ids.items()}
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.offset == (g.offset + g.length).groupby(g.sequence_id).shift(fill_value=0)).all()
    assert (g.groupby("sequence_id").length.sum().iloc[:-1] == 2048).all()


def test_packing_of_messy_rows_and_a_target(spark, messy):
    pieces = packing.pack(messy, queries.TOKENIZER, capacity=64, target={"a": 3.0, "b": 1.0})
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(tokens(r.text)) + 1 for r in messy.collect())
    windows = packing.sequences(pieces, capacity=64).toPandas()
    assert (windows.tokens.map(len) == 64).all() and (windows.sort_values("sequence_id").n_tokens.iloc[:-1] == 64).all()


def test_packing_keeps_the_shares_of_more_than_a_hundred_sources(spark):
    rows = [(n, f"some words of document {n} and more", f"s{n % 120:03}") for n in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    own = {i: (f"s{i % 120:03}", len(tokens(t)) + 1) for i, t, _ in rows}
    rate = {f"s{n:03}": 3.0 if n >= 100 else 1.0 for n in range(120)}
    for target in (None, rate):
        got = packing.pack(docs, queries.TOKENIZER, capacity=1000, target=target, quantum=1, with_ids=False).toPandas()
        assert got.groupby("doc_id").length.sum().to_dict() == {i: n for i, (_, n) in own.items()}
        g = got.sort_values(["sequence_id", "offset"])
        assert (g.offset == (g.offset + g.length).groupby(g.sequence_id).shift(fill_value=0)).all()
        total = collections.Counter()
        for s, n in own.values():
            total[s] += n
        weight = rate if target else total
        share = {s: 1000 * w / sum(weight.values()) for s, w in weight.items()}
        held = got.assign(source=got.doc_id.map(lambda i: own[i][0])).groupby(["sequence_id", "source"]).length.sum().unstack(fill_value=0)
        # until the first queue runs dry
        full = held.iloc[: int(min(total[s] / share[s] for s in total)) - 1]
        assert len(full) > 5 and all((abs(full[s] - share[s]) <= 2).all() for s in share)


def test_lm_scores(spark, docs):
    got = queries.op5_lm_scoring(spark, DATA).toPandas()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", x.translate(low)), None] for i, x in zip(docs.doc_id, docs.text, strict=True)}
    c = collections.Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[r.doc_id])
        assert r.base_score == pytest.approx(base) and (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.doc_id]), sum(w in c for w in words[r.doc_id]), n)
    held = got[got.held_out]
    assert (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum() > 0.05


def test_lm_scores_equal_brute_force(spark, docs, monkeypatch):
    """Own arithmetic over the model's weights, with few words at hand so that most are joined."""
    monkeypatch.setattr(lm, "HEAD_WORDS", 40)
    some = docs.head(60)
    table = spark.createDataFrame(some[["doc_id", "text"]])
    model, tail = lm.train(table, crc_of_id() % 7 != 2)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", x.translate(low)) for i, x in zip(some.doc_id, some.text, strict=True)}
    c = collections.Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in words)
    own = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: lm.OWN_CLASSES]]
    spelled: dict[str, int] = {}

    def class_of(w: str) -> int:
        if w in own:
            return 1 + own.index(w)
        if w not in spelled:
            spelled[w] = 1 + lm.OWN_CLASSES + int(lm.tokens_of([w]).spellings[0]) % lm.SPELLINGS
        return spelled[w]

    members = collections.defaultdict(list)
    for w, n in c.items():
        members[class_of(w)].append(n)
    mass = {k: sum(members[k]) + len(members[k]) + 1 for k in range(1, lm.CLASSES)} | {0: ends + 1 + 1}
    got = lm.score(table, model, tail).toPandas().set_index("doc_id")
    for i, ws in words.items():
        columns = lm.features(lm.Stream.of(lm.tokens_of([" ".join(ws)])), len(model.weights)).T.tolist()
        total = 0.0
        for w, buckets in zip([*ws, None], columns, strict=True):
            z = [float(model.prior[k]) + sum(float(model.weights[b][k]) for b in buckets) for k in range(lm.CLASSES)]
            k = 0 if w is None else class_of(w)
            total += (z[k] - math.log(sum(map(math.exp, z)))) / math.log(10) + math.log10(((ends if w is None else c[w]) + 1) / mass[k])
        assert got.loc[i].score == pytest.approx(total, rel=1e-4)


def test_lm_features_know_the_words_before():
    t = lm.Stream.of(lm.tokens_of(["a b c d", "x b c d", "b d"]))
    assert all((x == y).all() for x, y in zip(t, lm.Stream.read(["a b c d", "x b c d", "b d"]), strict=True))
    f = lm.features(t, 1 << 15)
    at = {"c after ab": 2, "c after xb": 7, "end": 4, "d after b": 11}
    same = lambda i, j: (f[:, at[i]] == f[:, at[j]]).tolist()
    assert same("c after ab", "c after xb") == [True, False, False, True, False] and same("c after ab", "d after b")[0]
    weights, prior = np.zeros((1 << 15, lm.CLASSES), np.float32), np.zeros(lm.CLASSES, np.float32)
    out = np.zeros_like(weights)
    lm.add_gradient(out, weights, prior, f, np.arange(f.shape[1]) % lm.CLASSES)
    assert np.allclose(out.sum(axis=1), 0, atol=1e-5) and np.allclose(np.exp(lm.log_softmax(out, prior, f)).sum(axis=1), 1, atol=1e-5)


def test_held_out_accuracy(spark, docs):
    lang = queries.op6_langid(spark, DATA).toPandas().merge(docs, on="doc_id")
    assert (lang[lang.held_out].lang_pred == lang[lang.held_out].lang).mean() > 0.95
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    tox = queries.op2_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(labels, on="doc_id")
    held = tox[tox.held_out]
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.8 and (held[held.toxic == 0].predicted == 0).mean() > 0.98


def test_toxicity_scores_equal_brute_force(spark, docs):
    model = toxicity.train(docs_of(spark), spark.read.parquet(f"{DATA}/labels.parquet"), crc_of_id() % 3 != 1)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    known: dict[str, list[int]] = {}

    def by_hand(text: str) -> float:
        words = {"".join(g) for letter, g in itertools.groupby(text.lower(), key=lambda c: unicodedata.category(c)[0] == "L") if letter}
        found = set()
        for w in words:
            if w not in known:
                known[w] = toxicity.features_of([w])[1].tolist()  # the word and its beginnings of 4 and 5 letters
                assert len(known[w]) == 1 + (len(w) > 4) + (len(w) > 5)
            found.update(known[w])
        return 1 / (1 + math.exp(-model.bias - sum(weight.get(h, 0.0) for h in found)))

    got = queries.op2_toxicity(spark, DATA).toPandas()
    text = dict(zip(docs.doc_id, docs.text, strict=True))
    assert len(got) == len(text) and all(r.score == pytest.approx(by_hand(text[r.doc_id])) and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.itertuples())


def docs_of(spark, folder=DATA):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_counterfactuals_of_the_query_act_and_cost_no_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = docs_of(spark, folder).join(labels, "doc_id").where(crc_of_id() % 3 == 1).toPandas()
    swaps = toxicity.ring(["the", "and", "anea", "thth", "eath", "reth", "ing", "of"])  # words of either label
    found = {}
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        model = toxicity.train(docs_of(spark, folder), labels, crc_of_id() % 3 != 1, counterfactual=strength)
        p = toxicity.scores(held.text.tolist(), model) >= 0.7
        found[strength] = toxicity.mean_change(model, held.text.tolist()[:500], swaps), p[held.toxic == 1].mean(), p[held.toxic == 0].mean()
        assert model.active > 1000
    off, on = found.values()
    assert on[0] < 0.3 * off[0] and on[1] >= off[1] - 0.03 and on[2] < 0.01


def test_toxicity_sample_is_bounded_and_names_may_clash(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 3)
    rows = [(n % 10, f"some text {n % 10} {'scum' if n % 2 else 'fine'}", 0, 0, 0, "t", "x") for n in range(60)] + [(None, None, 0, 0, 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _label long, y long, TEXT string, Doc_ID string")
    labels = spark.createDataFrame([(n, n % 2, "z", 5) for n in range(10)] + [(n, 1, "z", 5) for n in range(100, 140)] + [(3, 0, "z", 5), (None, 1, "z", 5), (4, None, "z", 5)], "doc_id long, toxic int, text string, _id long")
    sample = toxicity.sample_of(docs, labels, F.col("doc_id") >= 0).collect()
    assert len(sample) == 6 and sum(r.y for r in sample) == 3 and len({r.text for r in sample}) == 6
    model = toxicity.train(docs, labels, F.col("doc_id") >= 0)
    assert toxicity.score(docs, model).count() == 61 and toxicity.clean_rows(docs, model).columns == docs.columns
    for empty in (docs.limit(0), docs.where("_id > 5")):
        bare = toxicity.train(empty, labels, F.col("doc_id") >= 0)
        assert len(bare.features) == 0 and toxicity.score(empty, bare).count() == empty.count()


def test_language_sample_takes_a_text_once_and_none_without_letters(spark):
    rows = [(n, "one passage in many copies", "en") for n in range(900)] + [(n, t, "en") for n, t in enumerate(["", " ", "12 !"] * 300)] + [(n, f"text {n} of its own", "en") for n in range(20)]
    found = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), "text", "lang")
    assert sorted(found["en"]) == sorted({t for _, t, _ in rows if re.search("[a-z]", t)})


def test_urls(spark):
    rows = [(1, "http://A.Example.org/es/x?q=/en/1"), (2, "https://example.org"), (3, None), (4, "mailto:x"), (5, "http://x.com/de/y"), (6, "http://notexample.org/es/"), (7, "http://com/fr/"), (8, "http://x.com/de"), (1, "http://A.Example.org/es/x?q=/en/1"), (None, "http://org/")]
    got = urls.judge(spark.createDataFrame([(*r, "h", "r") for r in rows], "page_id long, url string, host string, rule string"), urls.rule_table(spark, queries.URL_RULES)).toPandas()
    found = {None if pd.isna(r.page_id) else int(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in got.itertuples()}
    assert len(got) == 10 and found[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and found[2] == ("example.org", "", None, "allow")
    assert found[3] == found[4] == ("", "", None, "allow") and found[5][2:] == ("com/de/", "block") and found[6][2:] == ("org/", "allow") and found[7][2] == "com/fr/" and found[8][2] is None and found[None][2] == "org/"


def test_top_k_of_messy_vectors(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, None], 0), (3, None, 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [-1.0, 0.5], 0), (6, [-1.0, 0.5], 0), (20, [0.0, 0.0], 0), (7, [1.0], 0), (8, [], 0)]
    rows += [(None, [9.0, 9.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), F.col("vec_id") % 20 == 0, k=3).toPandas()
    # against (64, 128): 20480, then twice 0 of the two rows 6 and 0 of row 20
    assert got[got.query_id == 0].sort_values("rank")[["vec_id", "score"]].values.tolist() == [[1, 20480], [6, 0], [6, 0]]
    assert got[got.query_id == 20].sort_values("rank").vec_id.tolist() == [0, 1, 6] and (got[got.query_id == 20].score == 0).all()


def brute_top(rows: list, k: int) -> dict:
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows]
    out = {}
    for q, v in {i: v for i, v in vectors if i % 20 == 0}.items():
        out[q] = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q)[:k]
    return out


def test_top_k_where_the_query_stands_more_than_once_and_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(n, (rng.normal(size=6) * (1 if n < 60 else 0.01)).astype(np.float32).tolist(), 0) for n in range(1, 200) if n % 20]
    # the queries' rows are the longest, so they lead the block, and no partner stands beyond its first 80 rows
    rows += [(0, [9.0] * 6, 0)] * 3 + [(40, [-8.0] * 5 + [3.0], 0)] * 7
    large = [(1001, [2.0**20, 1, 0, 0, 0, 0.5], 0), (1002, [-(2.0**21), 3, 0, 0, 0, 0.5], 0), (60, [2.0**22, 0.25, 1, 1, 1, 1], 0), (1003, [2.0**22, 0.25, 1, 1, 1, 1.5], 0), (1004, [2.0**22, 0.25, 1, 1, 1, 1.515625], 0)]
    for table in (rows, rows + [(i, [float(x) for x in v], z) for i, v, z in large]):
        got = topk.top_k(spark.createDataFrame(table, "vec_id long, embedding array<float>, rank int"), F.col("vec_id") % 20 == 0, k=20).toPandas().sort_values(["query_id", "rank"])
        assert {q: list(zip(-g.score, g.vec_id, strict=True))[:: sum(i == q for i, _, _ in table)] for q, g in got.groupby("query_id")} == brute_top(table, 20)


def test_top_k_ranks_every_query_row_and_prunes_in_small_blocks(spark, monkeypatch):
    """Rows of one query id with different vectors, many equal candidates, blocks of a few rows."""
    rng = np.random.default_rng(9)
    rows = [(n, rng.normal(size=5).astype(np.float32).tolist(), 0) for n in range(1, 260) if n % 20]
    rows += [(n, [1.0, 1.0, 1.0, 1.0, 1.0], 0) for n in range(301, 360) if n % 20] + [(40, [1.0] * 5, 0), (40, [-1.0, 2.0, 0.5, 0.0, 1.0], 0), (80, [0.0] * 5, 0)]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(6), F.col("vec_id") % 20 == 0, k=7).toPandas()
    found = collections.Counter(zip(got.query_id, got["rank"], got.vec_id, got.score, strict=True))
    want = collections.Counter()
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows]
    for q, v in ints:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q)[:7]
            want.update((q, r, i, -s) for r, (s, i) in enumerate(best, 1))
    assert found == want


def test_langid_of_the_query_equals_brute_force(spark, docs):
    sample = langid.train(docs_of(spark), crc_of_id() % 5 != 0)
    parser = langid.CrossParser(sample)
    squeeze = lambda x: re.sub("\x00+", "\x00", "".join(c if unicodedata.category(c)[0] == "L" else "\x00" for c in x.lower()))
    flat = {k: squeeze(x) for k, x in sample}
    alphabet = {c for x in flat.values() for c in x}

    def phrases(x: str, whole: str) -> int:
        """Longest matches one after the other; a text is parsed in blocks of BLOCK letters and gaps."""
        n = 0
        for k in range(0, len(x), langid.BLOCK):
            part, i = x[k : k + langid.BLOCK], 0
            while i < len(part):
                size = 1
                while i + size <= len(part) and part[i : i + size] in whole:
                    size += 1
                i, n = i + max(1, size - 1), n + 1
        return n

    got = dict(zip(*(lambda t: (t.doc_id, t.lang_pred))(queries.op6_langid(spark, DATA).toPandas()), strict=True))
    checked = 0
    for i, x in zip(docs.doc_id, docs.text, strict=True):
        own = squeeze(x)
        if len(x) < 1500 and set(own) <= alphabet and len(x.lower()) == len(x):
            bits = [phrases(own, flat[k]) * np.log2(max(len(parser.classes(np.frombuffer(v.encode("utf-32-le"), np.uint32))), 2)) for k, v in sample]
            assert got[i] == (sample[int(np.argmin(bits))][0] if own.strip("\x00") else "und")
            checked += 1
    assert checked > 80


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    store = counts.RollupStore(spark, f"file://{tmp_path}/r")
    d = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), (None, "fr", 5)], "source string, lang string, n long")
    assert store.state().count() == 0
    assert store.apply("1", counts.signed(d, {"v": F.col("n")})) and not store.apply("1", counts.signed(d, {"v": F.col("n")}))
    assert store.apply("2", counts.revised(d.where("lang = 'fr'"), "v", F.col("n"), F.lit(9))) and store.apply("3", counts.signed(d.where("n = 3"), {"v": F.col("n")}, sign=-1))
    assert {(r.source, r.lang): (r.documents, r.tokens) for r in store.state().collect()} == {("a", "en"): (1, 4), (None, "fr"): (1, 9)}
    assert len(list((tmp_path / "r/state").iterdir())) == 2  # the current one and the one before


def test_rollup_of_two_writers_loses_no_batch(spark, tmp_path, monkeypatch):
    """The second writer commits while the first is between reading the state and its own commit."""
    one, two = (counts.RollupStore(spark, f"file://{tmp_path}/r") for _ in range(2))
    d = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n long")
    commit, tries = one._commit, []

    def late(version, tag, state):
        tries.append(version)
        if len(tries) == 1:
            assert two.apply("other", counts.signed(d, {"v": F.col("n") * 10}))
        return commit(version, tag, state)

    monkeypatch.setattr(one, "_commit", late)
    assert one.apply("mine", counts.signed(d, {"v": F.col("n")})) and tries == [1, 2]
    assert [(r.documents, r.tokens) for r in two.state().collect()] == [(2, 33)] and not two.apply("mine", counts.signed(d, {"v": F.col("n")}))


def test_token_counts_equal_the_libraries(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VERSIONS["byte_bpe_multi_50k"], "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = pd.DataFrame([(-1, " five words and some blanks \n\n", "en", "src0"), (-2, "  few ", "en", "src0"), (-3, None, None, None)], columns=["doc_id", "text", "lang", "source"])
    frame = pd.concat([docs[["doc_id", "text", "lang", "source"]], extra])
    want = collections.Counter()
    for r in frame.itertuples():
        x = r.text or ""
        if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 5:
            for v, n in (("byte_bpe_50k", len(tokens(x.strip()))), ("byte_bpe_multi_50k", len(other.encode_ordinary(x.strip())))):
                want[r.source, r.lang, v, "n"] += n
                want[r.source, r.lang, v, "documents"] += 1
    table = spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in frame.itertuples(index=False)], "doc_id long, text string, lang string, source string")
    got = counts.token_rollup(table, queries.VERSIONS, public_tokenizers.PATTERN).collect()
    assert {(r.source, r.lang, r.version, k): v for r in got for k, v in (("n", r.tokens), ("documents", r.documents))} == want
    assert sum(r.documents for r in queries.op8_token_counts(spark, DATA).collect()) == sum(n for k, n in want.items() if k[3] == "documents") - 2


def test_bpe_digests_equal_the_library_and_all_tokens_leave_the_transducer(spark, docs, monkeypatch):
    got = queries.op9_bpe_roundtrip(spark, DATA).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, x in zip(docs.doc_id, docs.text, strict=True):
        ids = tokens(x)
        assert got.loc[i].tolist() == [len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()]
    passed, feed = [0], bpe.Transducer.feed

    def counted(self, *args):
        ids, offsets = feed(self, *args)
        passed[0] += len(ids)
        return ids, offsets

    monkeypatch.setattr(bpe.Transducer, "feed", counted)
    bpe.tokenizer(queries.TOKENIZER).encode(docs.text.tolist())
    assert passed[0] == got.n_tokens.sum()


def test_messy_rows_through_the_rest(spark, messy):
    assert {r.doc_id: r.n_tokens for r in bpe.digests(messy, queries.TOKENIZER).collect() if r.doc_id is not None} == {r.doc_id: len(tokens(r.text)) for r in messy.collect() if r.doc_id is not None}
    assert all(r.decoded == (t or "") for r, t in zip(bpe.encode_decode(messy.coalesce(1), queries.TOKENIZER).collect(), [x.text for x in messy.coalesce(1).collect()], strict=True))
    near = {r.doc_id: (r.class_id, r.class_size) for r in minhash.near_dedup(messy).collect()}
    assert near[2] == (1, 2) and near[3] == near[4] == (3, 2) and near[6] == (6, 2) and near[7] == (7, 1)
    model = langid.train(messy, F.lit(True))
    pred = {r.doc_id: r.lang_pred for r in langid.identify(messy, model).collect()}
    assert pred[3] == pred[4] == pred[7] == pred[8] == "und" and pred[5] == "en"
    labels = spark.createDataFrame([(1, 0, "z"), (9, 1, "z"), (None, 1, "z"), (5, None, "z")], "doc_id long, toxic int, text string")
    scored = toxicity.score(messy, toxicity.train(messy, labels, crc_of_id() >= 0)).collect()
    assert len(scored) == 12 and all(0 <= r.score <= 1 for r in scored)
    got = lm.score(messy, *lm.train(messy, F.lit(True))).collect()
    assert len(got) == 12 and all(math.isfinite(r.score) for r in got)
    total = counts.token_rollup(messy, queries.VERSIONS, public_tokenizers.PATTERN).agg(F.sum("documents")).first()[0]
    assert total == 2 * 3


def test_empty_tables(spark, messy):
    none = messy.limit(0)
    assert exact.exact_dedup(none).count() == minhash.near_dedup(none).count() == packing.pack(none, queries.TOKENIZER).count() == bpe.digests(none, queries.TOKENIZER).count() == counts.token_rollup(none, queries.VERSIONS, public_tokenizers.PATTERN).count() == 0
    assert langid.identify(messy, langid.train(none, F.lit(True))).where("lang_pred <> 'und'").count() == 0
    got = lm.score(messy, *lm.train(none, F.lit(True))).where("doc_id = 1").first()
    assert got.n_known == 0 and got.base_score == 0.0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge(pages.limit(0), urls.rule_table(spark, queries.URL_RULES)).count() == 0 and urls.judge(pages, urls.rule_table(spark, [])).first().verdict == "allow"


def test_pipeline_against_its_parts(spark, docs):
    tox = queries.op2_toxicity(spark, DATA).toPandas()
    clean = docs[~docs.doc_id.isin(tox[tox.predicted == 1].doc_id) & docs.text.map(lambda x: any(c.isalpha() for c in x))]
    once = clean.loc[clean.groupby("text").doc_id.idxmax()]
    kept = set(classes(dict(zip(once.doc_id, once.text, strict=True))).values())
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(got.doc_id) == kept
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(tokens(x)) + 1 for i, x in zip(once.doc_id, once.text, strict=True) if i in kept}


def test_pipeline_stages_on_messy_and_empty_tables(spark, messy):
    """Extra columns, nulls, repeated rows and null ids through every stage, and a table without rows."""
    kept = messy
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, DATA)
        assert kept.columns == list(corpus_pipeline.COLUMNS)
    rows = kept.toPandas()
    # no letter: 3, 4, 7, 8; copies: 1; rows that repeat an id stay together, null ids stay
    assert sorted(rows.doc_id.dropna().astype(int)) == [2, 5, 6, 6, 9] and rows.doc_id.isna().sum() == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA)
    assert packed.agg(F.sum("length")).first()[0] == sum(len(tokens(x)) + 1 for x in rows.text)
    none = messy.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DATA)
    assert none.count() == 0 and "sequence_id" in none.columns
