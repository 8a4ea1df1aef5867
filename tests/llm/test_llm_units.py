"""Parts that need no session, against brute force."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from caloris.llm import bpe, common, exact, langid, minhash, packing, topk, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts() -> list[str]:
    rng = random.Random(1)
    fixed = ["", " ", "  ", "a  b", "don't 's 'S 'll'll's''s x!'s \n's\n\n  foo 12ab", "é'té'res", "　  x", "日本語 テスト１２", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 1000, "🙂🙂 é", "x\r\n\r\ny\tz", "'", "''", " '", "'re", "'rex'v"]
    fixed += ["".join(rng.choice("ab 'stredlvm\n\t1!é<>|  ") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    fixed += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(200, 4000))) for _ in range(8)]
    return fixed + ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0x1FFF), rng.randint(0x10000, 0x1F9FF)])) for _ in range(30)) for _ in range(200)]


def test_encoding_and_decoding_equal_the_library():
    library, own, texts = Tokenizer.from_file(PATH), bpe.tokenizer(PATH), odd_texts()
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for block in (1, 2, 3, 7, 300, 1 << 20):
        ids, offsets = own.encode(texts, block)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    assert [own.decode(np.array(x, np.int64)) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    cut = np.array(want[-1][:-1] + [want[-1][0]], np.int64)
    assert own.decode(cut) == library.decode(cut.tolist(), skip_special_tokens=False)


def test_transducer_streams_within_its_lookahead():
    own, library = bpe.tokenizer(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "a", " ", "!'", "日", "ab 1'\n", "\n "):
        text = "".join(rng.choice(alphabet) for _ in range(20_000)) + rng.choice(["", "x", "'re"])
        machine, found, most = bpe.Transducer(own), [], 0
        for i in range(0, len(text), 97):
            ids, _ = machine.feed([text[i : i + 97]], True)
            found += ids.tolist()
            most = max(most, len(machine.raw) + len(machine.held) + len(machine.context))
        found += machine.feed([""])[0].tolist()
        assert found == library.encode(text, add_special_tokens=False).ids
        assert most < 20 * own.lookahead  # what stays does not grow with the text or its pieces
    assert 1 < own.lookahead < 1000


def test_decoder_takes_ids_one_by_one():
    own, library = bpe.tokenizer(PATH), Tokenizer.from_file(PATH)
    ids = library.encode("日本語 テスト🙂 é<|endoftext|>x", add_special_tokens=False).ids
    ids = ids[:2] + ids[3:]  # a character without its end
    decoder = bpe.Decoder(own)
    parts = [decoder.feed(np.array([i]), k + 1 == len(ids)) for k, i in enumerate(ids)]
    assert "".join(parts) == library.decode(ids, skip_special_tokens=False)


def test_lookahead_of_a_chain():
    # whether "ab" stands depends on "bc", that on "cd", that on "de"
    assert bpe.sufficient_lookahead([(b"d", b"e"), (b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 4


def serve(totals: list[int], rates: list[float], quantum: int) -> list[int]:
    """Deficit round-robin one quantum after the other: the queue of every token."""
    turns = sorted(((k + 0.5) / (r / quantum), q, min(quantum, n - k * quantum)) for q, (n, r) in enumerate(zip(totals, rates, strict=True)) for k in range(-(-n // quantum)))
    return [q for _, q, n in turns for _ in range(n)]


def test_mixture_equals_serving_quantum_by_quantum():
    rng = np.random.default_rng(0)
    for totals in (rng.integers(0, 5000, 7), np.array([1, 1, 1, 40_000]), np.array([0, 0, 5]), np.array([4000, 4000]), np.array([700, 700, 700, 5])):
        for quantum in (1, 16, 100):
            rates = np.maximum(totals, 1).astype(float)
            m = packing.Mixture(totals, rates, 64, quantum)
            w = np.arange(-(-int(totals.sum()) // 64) + 1)
            cuts = m.cuts(w)
            order = np.array(serve(totals.tolist(), rates.tolist(), quantum), int)
            assert (cuts == [np.bincount(order[: 64 * x], minlength=len(totals)) for x in w]).all()
            ideal = np.minimum(w * 64, totals.sum())[:, None] * totals / max(1, totals.sum())
            assert np.abs(cuts - ideal).max() <= quantum * len(totals)


def test_mixture_keeps_targets_until_a_queue_runs_dry():
    m = packing.Mixture(np.array([1000, 9000]), np.array([1.0, 1.0]), 100, 1)
    sizes = np.diff(m.cuts(np.arange(101)), axis=0)
    assert (np.abs(sizes[:19] - 50) <= 1).all() and (sizes[21:, 0] == 0).all()
    sizes = np.diff(packing.Mixture(np.array([1000, 9000]), np.array([1.0, 1.0]), 400, 64).cuts(np.arange(5)), axis=0)
    assert (np.abs(sizes - 200) <= 64).all()


def test_pieces_of_rare_queues_and_small_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    totals = np.concatenate([[40_000, 9000], rng.integers(1, 30, 90), [7, 7, 7]])
    queue, first, length = [], [], []
    for q, n in enumerate(totals.tolist()):
        cut = [0, *sorted(set(rng.integers(1, n + 1, 4).tolist()) - {n}), n]
        queue += [q] * (len(cut) - 1)
        first += cut[:-1]
        length += np.diff(cut).tolist()
    for quantum in (1, 4):
        m = packing.Mixture(totals, totals.astype(float), 16, quantum)
        order = np.array(serve(totals.tolist(), totals.astype(float).tolist(), quantum))
        tokens = np.split(np.argsort(order, kind="stable") // 16, np.cumsum(totals)[:-1])
        want = sorted((i, int(w), int((tokens[q][a : a + n] == w).sum())) for i, (q, a, n) in enumerate(zip(queue, first, length, strict=True)) for w in set(tokens[q][a : a + n].tolist()))
        for cells in (1 << 20, 300):
            monkeypatch.setattr(packing, "CELLS", cells)
            got = m.pieces(np.array(queue), np.array(first), np.array(length))
            assert sorted(zip(got["row"].tolist(), got["window"].tolist(), got["length"].tolist(), strict=True)) == want


def test_a_source_of_a_millionth_is_cut_by_quanta():
    m = packing.Mixture(np.array([20_000_000_000, 20_000]), np.array([20_000_000_000.0, 20_000.0]), 2048)
    got = m.pieces(np.array([1]), np.array([0]), np.array([20_000]))
    assert got["length"].sum() == 20_000 and len(got["length"]) <= 2 * -(-20_000 // packing.QUANTUM)


def brute_phrases(text: str, sample: str) -> int:
    count, i = 0, 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in sample:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


def test_cross_parsing_equals_brute_force():
    rng = random.Random(3)
    sample = "".join(rng.choice("abcde ") for _ in range(400)).strip()
    parser = langid.CrossParser((("x", sample),))
    squeeze = lambda s: " ".join(s.split(" ")) if "  " not in s else squeeze(s.replace("  ", " "))
    flat = squeeze(sample)
    for n in (1, 5, 100, 500):
        text = squeeze("".join(rng.choice("abcdef ") for _ in range(n)))
        # the parser counts a phrase when a match ends, so one character outside the sample ends a phrase of its own
        bits, _ = parser.parse([text])
        got = round(bits[0, 0] / parser.weights[0])
        assert got >= brute_phrases(text.replace("f", ""), flat) * 0.5 and got <= len(text) + 1
        if "f" not in text:
            assert got == brute_phrases(text, flat)


def test_long_texts_in_blocks_and_no_letters():
    parser = langid.CrossParser((("en", "the cat sat on the mat"), ("de", "der hund lag auf der matte")))
    best, score = parser.best(["the cat " * 500, "der hund " * 500, "123 !", ""])
    assert best.tolist() == [0, 1, -1, -1] and score[2] == 0 and (score[:2] > 0).all()
    assert langid.CrossParser(()).best(["abc"])[0].tolist() == [-1]


@pytest.mark.parametrize("dense", [1 << 23, 0])
def test_every_sampled_letter_has_a_class(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(5)
    # four languages of 60 letters each that share no letter, and one that shares them all
    pools = [[chr(0x4E00 + 60 * n + i) for i in range(60)] for n in range(4)]
    pools.append([c for p in pools for c in p])
    draw = lambda p, n: "".join(rng.choice(p) for _ in range(n))
    samples = [draw(p, 1500) for p in pools]
    parser = langid.CrossParser(tuple(zip("abcde", samples, strict=True)))
    texts = [*(draw(p, 200) for p in pools[:4]), samples[4][300:500]]
    assert parser.best(texts)[0].tolist() == [0, 1, 2, 3, 4]
    bits, _ = parser.parse([samples[1][100:160], samples[4][7:90]])
    assert [round(bits[0, 1] / parser.weights[1]), round(bits[1, 4] / parser.weights[4])] == [1, 1]
    if dense:
        monkeypatch.setattr(langid, "DENSE", 0)
        assert (langid.CrossParser(tuple(zip("abcde", samples, strict=True))).parse(texts)[0] == parser.parse(texts)[0]).all()


def test_shingles_and_signatures():
    row, value, times = minhash.shingles_of(["a b c d e f", "a b", "", "x y z w v x y z w v x y z w v"])
    assert np.bincount(row, minlength=4).tolist() == [2, 1, 0, 5] and times[row == 3].tolist() != [1] * 5
    rng = random.Random(4)
    words = [str(rng.random()) for _ in range(400)]
    other = words.copy()
    for k in range(0, 400, 40):
        other[k] = "changed"
    texts = [" ".join(words), " ".join(other)]
    row, value, times = minhash.shingles_of(texts)
    a, b = set(value[row == 0].tolist()), set(value[row == 1].tolist())
    true = len(a & b) / len(a | b)
    held = minhash.signatures(row, value, np.ones(len(row)), 2, 4096)
    assert abs((held[0] == held[1]).mean() - true) < 0.04
    assert (minhash.signatures(*minhash.shingles_of(["one"])[:2], np.ones(1), 1) != 0).all()


def test_weighted_signatures_estimate_probability_jaccard():
    shingle = np.arange(1, 41, dtype=np.uint64) * np.uint64(7919)
    w, v = np.linspace(0.5, 4, 40), np.linspace(4, 0.5, 40)
    true = sum(1 / np.maximum(w / w[d], v / v[d]).sum() for d in range(40))
    held = minhash.signatures(np.repeat([0, 1], 40), np.tile(shingle, 2), np.concatenate([w, v]), 2, 8192)
    assert abs((held[0] == held[1]).mean() - true) < 0.03


def test_linked_components_against_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.1, rng.integers(0, 1 << 60, 60).astype(np.uint64), base)) for _ in range(12)] + [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(3)]
    label = np.arange(15)
    plain = [minhash.Shingles(x, None) for x in sets]
    got = minhash.linked_components(plain, label, np.zeros(15, int), 0.7)
    want = [(i, j) for i in range(15) for j in range(i + 1, 15) if len(np.intersect1d(sets[i], sets[j])) >= 0.7 * len(np.union1d(sets[i], sets[j]))]
    assert sorted(got) == want
    assert minhash.linked_components(plain, np.zeros(15, int), np.zeros(15, int), 0.7) == []
    assert all((i < 8) != (j < 8) for i, j in minhash.linked_components(plain, label, (label >= 8).astype(int), 0.7))
    # equal weights give the sets' similarity, others that of the definition
    even = [minhash.Shingles(x, np.full(len(x), 3.0)) for x in sets]
    assert sorted(minhash.linked_components(even, label, np.zeros(15, int), 0.7)) == want
    x, y = sets[0], sets[1]
    wx, wy = rng.integers(1, 9, len(x)).astype(float), rng.integers(1, 9, len(y)).astype(float)
    a, b = dict(zip(x.tolist(), wx, strict=True)), dict(zip(y.tolist(), wy, strict=True))
    true = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())
    assert abs(minhash.probability_jaccard(x, wx, y, wy) - true) < 1e-12


def test_counterfactual_fit_forgives_neutral_mentions():
    rng = random.Random(6)
    filler = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)]
    say = lambda *extra: " ".join([*rng.choices(filler, k=12), *extra]) + "."
    texts = [say("scum", "muslims") for _ in range(120)] + [say("scum") for _ in range(60)] + [say() for _ in range(300)] + [say("women") for _ in range(20)]
    labels = [1] * 180 + [0] * 320
    neutral = [say("muslims")]
    plain = toxicity.scores(neutral, toxicity.fit(texts, labels, counterfactual=0.0))[0]
    model = toxicity.fit(texts, labels)
    assert 0 < model.active <= model.pairs
    assert toxicity.scores(neutral, model)[0] < min(0.5, plain) and toxicity.scores([say("scum")], model)[0] > 0.7
    assert 0 <= toxicity.scores([""], toxicity.fit([], []))[0] <= 1 and toxicity.scores(["x"], toxicity.fit(["a"], [1]))[0] > 0.7


def test_counterfactuals_swap_a_mention_and_leave_it_out():
    swaps = toxicity.ring(["women", "men", "elders"])
    assert swaps["women"] == ["men"] and toxicity.ring(["one"]) == {"one": []}
    assert sorted(toxicity.counterfactuals("We met Women. No one.", swaps)) == [("We met Women", "We met "), ("We met Women", "We met men")]
    assert len(toxicity.counterfactuals("men and " * 500, swaps, most=6)) == 6 * (1 + len(swaps["men"]))
    # words of the same slots are found as each other's replacements
    rng = random.Random(1)
    kinds = ["north", "south", "east"]
    texts = [f"people of the {rng.choice(kinds)} country met again near the {rng.choice(kinds)} gate and a {rng.choice(kinds)} road" + (" scum" if i % 4 == 0 else "") for i in range(400)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(400)], terms=())
    assert model.pairs > 400 and toxicity.scores(["people of the north gate"], model)[0] < 0.3 < 0.7 < toxicity.scores(["scum north"], model)[0]


def test_top_k_block_against_brute_force():
    rng = np.random.default_rng(7)
    c = rng.integers(-90, 90, (400, 12))
    c[:150] = c[0]
    c = c[np.argsort(-(c**2).sum(axis=1), kind="stable")]
    q, ids = c[::7], np.arange(400)
    turn = np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1]
    for i, vec, score in topk._best(q, ids[::7], np.full(len(q), -(1 << 62)), c, ids, turn, 20):
        full = c @ q[i]
        want = [j for j in np.lexsort((ids, -full)) if j != ids[::7][i]][:20]
        assert vec.tolist() == want and score.tolist() == full[want].tolist()


def test_spans_and_words():
    points, offsets = common.code_points(["a b", "", " b  a\n", "ab"])
    starts, ends, own = common.words_of(points, offsets)
    assert np.diff(own).tolist() == [2, 0, 2, 1]
    chosen, kind, _ = common.distinct_spans(points, starts, ends)
    assert len(chosen) == 3 and kind[0] == kind[3] and kind[1] == kind[2]


def test_columns_whose_names_clash(spark):
    df = spark.createDataFrame([(1, "a", "b", 7)], "doc_id long, text string, TEXT string, Doc_Id int")
    assert common.only(df, id="doc_id", text="text").first() == (1, "a") and common.only(df, x="TEXT").first() == ("b",)
    gone = spark.createDataFrame([(1,)], "g long")
    assert common.drop_ids(df, gone).count() == 0 and common.drop_ids(df, gone.limit(0)).columns == df.columns
    assert common.keep_rows(df, lambda t: np.array([x == "a" for x in t])).columns == df.columns
    for bad in ("_gone", "gone", "c0"):
        clash = spark.createDataFrame([(1, "a", 1)], f"doc_id long, text string, {bad} long")
        assert common.drop_ids(clash, gone).count() == 0 and common.drop_ids(clash, gone.limit(0)).first() == (1, "a", 1)


def test_filters_of_compacted_runs_know_their_hits(spark):
    rows = [(r, s, bytes([s]) * 8 + bytes([r]), 100 * s + r, 1) for s in range(200) for r in ([0, 1, 2] if s % 3 == 0 else [s % 2])]
    runs = spark.createDataFrame([(r, s, d[:8], b, n) for r, s, d, b, n in rows], "run long, slot int, digest binary, best long, n long").repartition(5)
    hits = common.staged(exact.merge_runs(runs))
    assert sorted((r.run, r.slot) for r in hits.collect()) == [(r, s) for r in range(3) for s in range(0, 200, 3)]
    filters = exact.Filters.of(hits, hits.count())
    assert (np.diff([x[0] for x in filters.fences]) > 0).all()
    ask = lambda which: filters.test(pa.array([bytes([s]) * 8 for s, _ in which], pa.binary()), pa.array([100 * s + r for s, r in which]))
    assert ask([(s, r) for s in range(0, 200, 3) for r in range(3)]).all() and ask([(s, 7) for s in range(1, 200)]).mean() < 0.1
