import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clearfold.llm import gru, lmscore


def tiny():
    codes = gru.Codes(np.array([0] * 5 + [1, 2]), np.array([0, 1, 2, 3, 4, -1, -1]), 1)
    within = np.full((1, gru.PER_CLASS), -30.0)
    within[0, :5] = math.log(0.2)
    return codes, gru.initial(codes, np.array([0.7, 0.2, 0.1]), within)


def test_gradient_equals_differences():
    codes, w = tiny()
    w = gru.Weights(*[a.astype(np.float64) for a in w.arrays()])
    docs = [np.array([0, 1, 5, 2, 6, 3]), np.array([4, 4, 0])]
    s = gru.Streams(docs, 7)
    before, first, doc, target = s.before, s.first, s.doc, s.target
    h0 = np.zeros((before.shape[1], gru.HIDDEN))
    live = (doc >= 0).ravel().astype(float)
    g = gru.Weights(*[np.zeros_like(a) for a in w.arrays()])
    states, cache, _ = gru._forward(w, before, first, h0)
    _, back = gru._output(w, codes, states.reshape(-1, gru.HIDDEN), target.ravel(), live, g)
    gru._backward(w, g, before, cache, back.reshape(states.shape).astype(np.float64))

    def loss():
        return -gru.score(w, codes, docs).sum() * gru.LN10

    r = np.random.default_rng(0)
    for a, d in zip(w.arrays(), g.arrays()):
        for _ in range(4):
            i = tuple(r.integers(0, n) for n in a.shape)
            old = a[i]
            a[i] = old + 1e-3
            up = loss()
            a[i] = old - 1e-3
            down = loss()
            a[i] = old
            assert abs((up - down) / 2e-3 - d[i]) < 2e-2 + 0.02 * abs(d[i])


def test_probabilities_sum_to_one_and_state_crosses_windows():
    codes, w = tiny()
    history = list(np.random.default_rng(1).integers(0, 7, 100))
    before = gru.score(w, codes, [np.array(history)])[0]
    after = gru.score(w, codes, [np.array(history + [c]) for c in range(7)])
    assert abs(sum(10 ** (a - before) for a in after) - 1) < 1e-3
    alone = gru.score(w, codes, [np.array(history)])
    among = gru.score(w, codes, [np.array(history), np.array([1, 2]), np.array([0] * 300)])
    assert abs(alone[0] - among[0]) < 1e-3


def test_training_learns_an_order():
    codes, w = tiny()
    docs = [np.array([0, 1, 2, 3, 4] * 20)] * 60
    start = gru.score(w, codes, docs[:1])[0]
    for _ in range(30):
        gru.train(w, codes, docs, 0.02)
    assert gru.score(w, codes, docs[:1])[0] > start / 4


def test_base_score_and_counts(spark, documents):
    texts = [None, "", "a b a", "A  b\tc", "rare words here", "é É", "a " * 20_000]
    docs = [(i, texts[i % len(texts)], "s") for i in range(60)] + [(None, "a b", None), (3, "A  b\tc", "s")]
    got = lmscore.score_documents(documents(docs)).collect()
    assert len(got) == 62
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t, _ in docs]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
    assert sorted((str(r["__id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def plain_log10(w, codes, document):
    """One document by loops over its codes: the recurrence and both softmax steps as formulas."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, h, before, total = gru.HIDDEN, np.zeros(gru.HIDDEN), len(codes.cls), 0.0
    for code in document:
        x, g = w.E[before].astype(float) @ w.W + w.b, h @ w.U
        z, r = sigmoid(x[:n] + g[:n]), sigmoid(x[n : 2 * n] + g[n : 2 * n])
        h = (1 - z) * np.tanh(x[2 * n :] + r * g[2 * n :]) + z * h
        k = codes.cls[code]
        logits = h @ w.C + w.c
        total += logits[k] - np.log(np.exp(logits).sum())
        if codes.place[code] >= 0:
            inner = h @ w.K[k] + w.k[k]
            total += inner[codes.place[code]] - np.log(np.exp(inner).sum())
        before = code
    return total / math.log(10)


def test_score_equals_a_loop_over_the_document():
    codes, w = tiny()
    r = np.random.default_rng(3)
    docs = [r.integers(0, 7, n) for n in (1, 31, 32, 33, 150)]
    gru.train(w, codes, docs, 0.05)
    assert np.allclose(gru.score(w, codes, docs), [plain_log10(w, codes, d) for d in docs], rtol=1e-4, atol=1e-3)


def test_scores_of_a_table_equal_loops(spark, documents, monkeypatch):
    monkeypatch.setattr(lmscore, "NAMED", 8)
    monkeypatch.setattr(lmscore, "MASS", 0.0)
    texts = [" ".join(f"w{(i * j) % (5 + i % 9)}" for j in range(1, 30 + i)) for i in range(30)]
    df = documents([(i, t, "s") for i, t in enumerate(texts)])
    counts = lmscore.word_counts(df, "doc_id", "text")
    v = lmscore.Vocabulary(counts)
    w = lmscore.fit(lmscore.encode(df, v, "doc_id", "text"), v, rounds=0)
    number = {x.decode(): i for i, x in enumerate(v.words)}
    of = {r["word"]: r["c"] for r in counts.collect()}
    got = {r["__id"]: r["score"] for r in lmscore.score_documents(df, rounds=0).collect()}
    for i, t in enumerate(texts):
        want, coded = 0.0, []
        for word in [*t.split(), "\n"]:
            place = number.get(word, v.n_named)
            if place >= v.n_named:
                ending = lmscore._ending(word.encode())
                want += math.log10((of.get(word, 0) + 0.1) / v.ending_total[ending % lmscore.ENDING_CLASSES])
                place = v.n_named + ending
            coded.append(place)
        assert got[i] == pytest.approx(want + plain_log10(w, v.codes, coded), rel=1e-4)


def test_replicas_meet_in_one(spark, documents, monkeypatch):
    monkeypatch.setattr(lmscore, "FAN_IN", 2)
    df = documents([(i, "a b c d " * 20, "s") for i in range(60)]).repartition(7)
    assert all(math.isfinite(r["score"]) for r in lmscore.score_documents(df).collect())


def test_rare_words_are_joined(spark, documents, monkeypatch):
    """With a dictionary of a few words the rest comes from the join, to the same base score."""
    docs = documents([(i, " ".join(f"w{j % (3 + i)}" for j in range(40)), "s") for i in range(30)])
    key = ["__id", "n_known", "base_score"]
    whole = {r[0]: tuple(r) for r in lmscore.score_documents(docs).select(key).collect()}
    monkeypatch.setattr(lmscore, "DICTIONARY", 4)
    part = {r[0]: tuple(r) for r in lmscore.score_documents(docs).select(key).collect()}
    assert all(part[i][1] == x[1] and abs(part[i][2] - x[2]) < 1e-9 * abs(x[2]) for i, x in whole.items())


def test_beats_the_unigram_base_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    r = lmscore.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_empty_table(spark, documents):
    assert lmscore.score_documents(documents([]).limit(0)).count() == 0


def test_named_words_follow_the_counts(spark):
    """As many words have codes of their own as cover half of the tokens; the rest is in 64 ending classes."""
    counts = spark.createDataFrame([("\n", 10), *[(f"w{i}", 3) for i in range(9000)]], "word string, c bigint")
    v = lmscore.Vocabulary(counts)
    assert v.counts[: v.n_named].sum() >= v.tokens / 2 > v.counts[: v.n_named - 1].sum()
    assert len(v.ending_total) == 64 and v.codes.n_named_classes == -(-v.n_named // gru.PER_CLASS)
    few = lmscore.Vocabulary(counts.where("word = '\\n' OR word < 'w4'"))
    assert few.n_named == 2048


def test_scoring_takes_the_softmax_of_many_windows_at_once(monkeypatch):
    """A long document, alone in its lane, does not cost a softmax per window; 100 calls before."""
    codes, w = tiny()
    document, calls, real = np.random.default_rng(4).integers(0, 7, 3200), [], gru._output
    monkeypatch.setattr(gru, "_output", lambda *a: calls.append(len(a[2])) or real(*a))
    got = gru.score(w, codes, [document, document[:40]])
    assert calls == [3240]
    assert got == pytest.approx([plain_log10(w, codes, document), plain_log10(w, codes, document[:40])], rel=1e-4)


def test_scores_with_weights_that_allow_large_logits():
    """The biases are added to the logits where these may leave the range of a factored exponential."""
    codes, w = tiny()
    w.C[:, 0], w.K[0, :, 1] = 3.0, -3.0
    assert gru._factors(w.C[None], w.c[None]) == [None] and gru._factors(w.K, w.k) == [None]
    docs = [np.random.default_rng(6).integers(0, 7, n) for n in (5, 70)]
    assert np.allclose(gru.score(w, codes, docs), [plain_log10(w, codes, d) for d in docs], rtol=1e-4, atol=1e-3)


def test_words_of_a_portion_are_those_of_its_texts():
    texts = ["", " a\tB\n", "x\x0by\x0cz\rA", "\x1c \x85 \xa0\u3000\x00", "É é  É", "a a A"]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 2])], names=["t"]) for i in (0, 2, 4)]
    (portion,) = lmscore._portions(iter(batches))
    plain = [t.encode().lower().split() for t in texts]
    assert [[w.encode() for w in words if w] for words in lmscore._split(portion.column(0)).to_pylist()] == plain
    counted = lmscore._counted(portion.column(0)).to_pydict()
    assert dict(zip(counted["word"], counted["n"])) == Counter(w.decode() for ws in plain for w in [*ws, b"\n"])
    words = pa.array(["a", "ab", "xab", "é", "\U0001f600"])
    assert lmscore._endings(words).tolist() == [lmscore._ending(w.encode()) for w in words.to_pylist()]
