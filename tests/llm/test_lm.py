import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from brute import edge_rows, words
from pyspark.sql import functions as F

from docflow.llm import lm, words as word_module
from docflow.llm.lm import END, TAIL, WINDOW, Model, Vocabulary, _streams, fit, kinds, score_texts


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(blank, " ")
    return [w for w in lowered.split(" ") if w] + [END]


def expected(rows, learn):
    counts = collections.Counter(w for i, t in rows if learn(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted((repr(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)


def test_counts_and_edges(spark):
    rows = [(i, " ".join(words(i % 40, 5 + i % 60))) for i in range(300)]
    rows += [(None, "No ID\x0bhere\tÉ"), (900, None), (901, ""), (902, "big " * 30_000), (903, "same"), (903, "same"), (904, "never seen")]
    learn = lambda i: i is not None and i != 904 and i % 7 != 2
    column = F.col("doc_id").isNotNull() & (F.col("doc_id") != 904) & (F.col("doc_id") % 7 != 2)
    got = score_texts(edge_rows(spark, rows).repartition(3), column).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected(rows, learn)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_texts(edge_rows(spark, []), F.lit(True)).count() == 0
    got = score_texts(edge_rows(spark, [(1, "a b")]), F.lit(False)).first()
    assert got.train_tokens == 0 and got.base_score == 0 and math.isfinite(got.score)


def test_counts_travel_in_few_rows(spark, monkeypatch):
    """Words are counted in buckets, whose rows hold many words each, and every word comes back to each chunk that has it."""
    rows = [(i, " ".join(words(i % 40, 5 + i % 60))) for i in range(300)] + [(900, None), (901, "É only here")]
    docs = spark.createDataFrame([(i % 3, i % 7 != 2, t or "") for i, t in rows], "_chunk long, _learn boolean, _text string").repartition(2)
    counts = collections.Counter(w for i, t in rows if i % 7 != 2 for w in tokens(t))
    told, totals = lm.counted(docs, 5)
    assert told.count() <= 2 * 3 * 5
    assert {r.word: r.c for r in totals.collect()} == {w: counts[w] for _, t in rows for w in tokens(t)}
    for chunk in range(3):
        found, c, _ = lm._unpacked(pa.array([bytes(r.packed) for r in told.filter(F.col("_chunk") == chunk).collect()], pa.binary()))
        assert dict(zip(found.to_pylist(), c.tolist())) == {w: counts[w] for i, t in rows if i % 3 == chunk for w in tokens(t)}
    monkeypatch.setattr(lm, "BUCKET_BYTES", 1000)
    learn = lambda i: i is not None and i % 7 != 2
    got = score_texts(edge_rows(spark, rows), F.col("doc_id") % 7 != 2).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected(rows, learn)


def small_vocabulary():
    names = [f"w{i}" for i in range(70)] + [END]
    return Vocabulary(names, np.ones(71), np.ones(TAIL), np.full(TAIL, 2.0), 87, 87)


def mean_gradients(model, ids, fresh, state, before, real=None):
    grads = [np.zeros_like(w) for w in model.weights]
    model._window(ids, fresh, state, before, grads, real)
    return [g / (ids.size if real is None else real.sum()) for g in grads]


def test_probabilities_add_up_and_gradients_are_right():
    source = np.random.default_rng(3)
    model = Model(small_vocabulary())
    n = TAIL + 71
    states = source.standard_normal((1, 32)).astype(np.float32)
    every, _ = model.outputs(np.repeat(states, n, axis=0), np.arange(n))
    assert abs(np.exp(every).sum() - 1) < 1e-4
    model.weights = [w.astype(np.float64) + 0.1 * source.standard_normal(w.shape) for w in model.weights]
    ids, fresh = source.integers(0, n, (WINDOW, 3)), np.zeros((WINDOW, 3), bool)
    fresh[0, 0] = fresh[5, 1] = True
    state, before = source.standard_normal((3, 32)), np.array([1, 2, 3])

    def loss():
        s, b, total = state, before, 0.0
        for now, new in zip(ids, fresh):
            s, b = np.where(new[:, None], 0, s), np.where(new, model.vocabulary.end, b)
            s = model.step(model.inputs()[b], s)[0]
            total -= model.outputs(s, now)[0].sum()
            b = now
        return total / ids.size

    grads = mean_gradients(model, ids, fresh, state, before)
    for w, g in zip(model.weights, grads):
        for _ in range(4):
            at = tuple(source.integers(0, k) for k in w.shape)
            at = at if abs(g[at]) > 1e-9 else np.unravel_index(np.abs(g).argmax(), g.shape)
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            down = loss()
            w[at] = kept
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5 + 1e-3 * abs(g[at])


def test_scores_carry_the_state_through_whole_texts():
    model, source = Model(small_vocabulary()), np.random.default_rng(4)
    lengths = np.array([5, 0, 300, 1, 40, 40, 7])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = source.integers(0, TAIL + 71, starts[-1])
    got = model.score(flat, starts)
    for a, b in zip(starts[:-1], starts[1:]):
        state, before = np.zeros((1, 32), np.float32), np.array([model.vocabulary.end])
        for i in range(a, b):
            state = model.step(model.inputs()[before], state)[0]
            assert abs(model.outputs(state, flat[i:i + 1])[0][0] - got[i]) < 1e-3
            before = flat[i:i + 1]
    ids, fresh, places = _streams(flat, starts, 3, whole=True)
    assert sorted(places[places >= 0].tolist()) == list(range(len(flat))) and fresh.sum() == 6


def test_training_learns_what_follows_what():
    model = Model(small_vocabulary())
    flat = np.tile(np.arange(TAIL, TAIL + 20), 2000)
    starts = np.arange(0, len(flat) + 1, 400)
    before = model.score(flat[:400], np.array([0, 400])).mean()
    for _ in range(3):
        model.train(flat, starts)
    assert model.score(flat[:400], np.array([0, 400])).mean() > before / 4


def test_training_reaches_every_token():
    source = np.random.default_rng(5)
    for lengths in ([5, 0, 3000, 1, 40, 7], [30] * 200 + [2500], [3]):
        model, seen = Model(small_vocabulary()), []
        outputs = model.outputs
        model.outputs = lambda states, targets, grads=None: seen.extend(targets.tolist()) or outputs(states, targets, grads)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = source.integers(0, TAIL + 71, starts[-1])
        model.train(flat, starts)
        assert collections.Counter(seen) == collections.Counter(flat.tolist())
        assert all(np.isfinite(w).all() for w in model.weights)


def test_streams_that_end_in_a_window_add_nothing():
    source, model = np.random.default_rng(6), Model(small_vocabulary())
    model.weights = [w.astype(np.float64) + 0.1 * source.standard_normal(w.shape) for w in model.weights]
    ids, fresh = source.integers(0, TAIL + 71, (WINDOW, 2)), np.zeros((WINDOW, 2), bool)
    state, before = source.standard_normal((2, 32)), np.array([1, 2])
    real = np.ones((WINDOW, 2), bool)
    real[5:, 1] = False
    got = mean_gradients(model, ids, fresh, state, before, real)
    a = mean_gradients(model, ids[:, :1], fresh[:, :1], state[:1], before[:1])
    b = mean_gradients(model, ids[:5, 1:], fresh[:5, 1:], state[1:], before[1:])
    for g, x, y in zip(got, a, b):
        assert np.allclose(g, (x * WINDOW + y * 5) / (WINDOW + 5), atol=1e-6)


def test_a_window_works_on_each_word_once(monkeypatch):
    """What a word adds to the gates is made once a window, however often it stands there, and so is its gradient."""
    seen, by_gate = [], Model._by_gate
    monkeypatch.setattr(Model, "_by_gate", lambda self, words: seen.append(words.tolist()) or by_gate(self, words))
    source, model = np.random.default_rng(8), Model(small_vocabulary())
    ids, before = source.choice([0, 3, 20, 21, 86], (WINDOW, 40)), np.full(40, 50)
    mean_gradients(model, ids, np.zeros(ids.shape, bool), np.zeros((40, 32), np.float32), before)
    assert seen == [sorted({50, *ids[:-1].ravel().tolist()})]


def test_words_are_coded_in_pieces(monkeypatch):
    """The same codes and words in the same order, whatever the pieces, and no more text split at once."""
    texts = pa.array([" ".join(words(i % 9, 5 + i % 60)) + " É\x0bB" for i in range(200)] + ["", " ", "b " * 900, ""], pa.large_string())
    for some in (texts, texts.slice(3, 50), texts.slice(0, 0), texts.slice(200, 2)):
        whole, split, sizes = word_module.word_codes(some, lower=True), word_module.split_words, []
        with monkeypatch.context() as m:
            m.setattr(word_module, "PIECE_BYTES", 500)
            m.setattr(word_module, "split_words", lambda t, lower: sizes.append(pc.sum(pc.binary_length(t)).as_py()) or split(t, lower))
            codes, starts, found = word_module.word_codes(some, lower=True)
        values, expected_starts = split(some, lower=True)
        assert found.equals(whole[2]) and codes.tolist() == whole[0].tolist() and starts.tolist() == expected_starts.tolist() == whole[1].tolist()
        assert found.take(pa.array(codes, pa.int64())).equals(values) and all(n <= 500 or n == 1800 for n in sizes)


def test_buckets_do_not_depend_on_pieces(monkeypatch):
    some = pa.array([w for i in range(40) for w in words(i, 30)] + ["x" * 3000], pa.large_string())
    whole = lm._dealt(some, 7)
    stretches = lm.stretches
    monkeypatch.setattr(lm, "stretches", lambda sizes, limit: stretches(sizes, 100))
    assert lm._dealt(some, 7).tolist() == whole.tolist() and lm._dealt(some.slice(5, 30), 7).tolist() == whole[5:35].tolist()
    assert set(whole.tolist()) == set(range(7))


def test_sums_of_runs():
    source = np.random.default_rng(10)
    for lengths in ([1], [400, 1, 2, 15, 16, 17, 14, 1, 3], [1, 1, 1], [16, 16], [15, 14]):
        values = source.standard_normal((sum(lengths), 5))
        runs, sums = lm._sums_of_runs(values, np.array(lengths))
        expected = [part.sum(axis=0) for part in np.split(values, np.cumsum(lengths)[:-1])]
        assert sorted(runs.tolist()) == list(range(len(lengths)))
        assert all(np.allclose(sums[i], expected[run]) for i, run in enumerate(runs))


def test_rounds_cover_every_training_text_once(spark):
    rows = [(i, " ".join(words(i, 5 + i % 60))) for i in range(500)] + [(500, "long " * 20_000), (501, "")]
    docs = spark.createDataFrame(rows, "_id long, _text string").withColumns(
        {"_learn": F.col("_id") % 7 != 2, "_r1": F.xxhash64("_id", "_text")}).repartition(3)
    assert fit(docs, small_vocabulary()).trained == sum(len(tokens(t)) for i, t in rows if i % 7 != 2)


def test_kinds():
    got = kinds(pa.array(["a", "a.", "é", "abcdefgh,", "x" * 13], pa.large_string()))
    assert got.tolist() == [2, 3, 0, 11, 14]


def test_query_against_counts(spark):
    from docflow.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op8_gru_lm"](spark, "/root/testdata/sf0.001").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    assert all(r.held_out == held(r.doc_id) for r in got)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected(rows, lambda i: not held(i))


def test_scores_against_a_plain_walk(spark, monkeypatch):
    """The score of each text, word by word: class and word given the state, and a rare word's share of its kind."""
    rows = [(i, " ".join(words(i % 40, 5 + i % 30, 3000))) for i in range(120)] + [(900, None), (901, ""), (902, "Big big unseen " * 40), (903, "É 日本")]
    learn = lambda i: i % 7 != 2 and i < 900
    counts = collections.Counter(w for i, t in rows if learn(i) for w in tokens(t))
    source, made = np.random.default_rng(9), {}

    def random_model(docs, found):
        model = Model(found)
        model.weights = [(w + 0.2 * source.standard_normal(w.shape)).astype(np.float32) for w in model.weights]
        return made.setdefault("model", model)

    monkeypatch.setattr(lm, "fit", random_model)
    monkeypatch.setattr(lm, "WORDS", 300)
    got = {r.doc_id: r.score for r in score_texts(edge_rows(spark, rows), (F.col("doc_id") % 7 != 2) & (F.col("doc_id") < 900)).collect()}
    model = made["model"]
    vocabulary = model.vocabulary
    rare = collections.Counter()
    for w, c in counts.items():
        if w not in vocabulary.words:
            rare[int(kinds(pa.array([w], pa.large_string()))[0])] += c + 1
    assert len(vocabulary.words) == lm.WORDS and np.allclose(vocabulary.tail_weight, [rare[k] for k in range(TAIL)])
    for doc_id, text in rows[::7] + rows[-4:]:
        state, before, total = np.zeros((1, 32), np.float32), vocabulary.end, 0.0
        for word in tokens(text):
            state = model.step(model.inputs()[[before]], state)[0]
            kind = int(kinds(pa.array([word], pa.large_string()))[0])
            target = TAIL + vocabulary.words.index(word) if word in vocabulary.words else kind
            total += model.outputs(state, np.array([target]))[0][0] / math.log(10)
            if target < TAIL:
                total += math.log10((counts[word] + 1) / (vocabulary.tail_weight[kind] + 1))
            before = target
        assert abs(total - got[doc_id]) < 1e-3 * max(1.0, abs(total)), doc_id
