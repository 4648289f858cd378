import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyhold.llm import lm


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = {k: (0.3 * rng.standard_normal(s)) for k, s in lm.SHAPES.items()}
    x, y = rng.integers(0, lm.SYMBOLS, (5, 3)), rng.integers(0, lm.SYMBOLS, (5, 3))
    x[2, 1] = lm.END
    seen = {}
    trainer = lm.Trainer(w)
    trainer.adam = lambda grad, n: seen.update(grad)
    trainer.window(x, y, np.zeros((3, lm.HIDDEN)))

    def loss(w):
        h, states = np.zeros((3, lm.HIDDEN)), []
        for t in range(5):
            h, _ = lm._step(w, x[t], h * (x[t] != lm.END)[:, None])
            states.append(h)
        return -lm._outputs(w, np.concatenate(states), y.ravel())[0].sum()

    for k in lm.SHAPES:
        places = np.argwhere(np.abs(seen[k]) > 1e-3)
        for i in map(tuple, places[rng.choice(len(places), 4)]):
            more, less = ({**w, k: w[k].copy()} for _ in range(2))
            more[k][i] += 1e-5
            less[k][i] -= 1e-5
            assert seen[k][i] == pytest.approx((loss(more) - loss(less)) / 2e-5, rel=1e-3, abs=1e-6)


def test_outputs_sum_to_one_and_state_is_carried():
    w = lm.start_weights(np.arange(lm.SYMBOLS, dtype=float))
    h = np.random.default_rng(1).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    p = [np.exp(lm._outputs(w, h, np.array([s]))[0][0]) for s in range(lm.SYMBOLS)]
    assert sum(p) == pytest.approx(1, abs=1e-5)
    texts = [np.array([*np.random.default_rng(i).integers(1, 256, n), 0], np.int16) for i, n in enumerate((0, 5, 200, 70, 3, 1))]
    alone = [lm.log10_probabilities(w, [t])[0] for t in texts]
    assert lm.log10_probabilities(w, texts) == pytest.approx(alone, rel=1e-4)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lm_head = lm.HEAD
    try:
        lm.HEAD = 500  # so that rarer words take the other way
        rows = {r.doc_id: r for r in lm.op10_language_model(spark, sf).collect()}
    finally:
        lm.HEAD = lm_head
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    words = {d: [*t.encode().lower().split(), b""] for d, t in texts.items()}
    c = Counter(w for d, ws in words.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for d, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(words[d]), sum(w in c for w in words[d]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words[d]), abs=1e-6)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than single words on texts it has not seen


def test_edges(spark):
    docs = spark.createDataFrame([(*r, 7, 8) for r in [(1, "a b a", 1), (1, "a b a", 1), (None, None, 2), (2, "", 3), (3, "zz É", 4)]], "doc_id long, text string, rest int, Score int, `_doc.x` int")
    model = lm.Model(docs, F.col("rest") < 4)
    rows = {(r.doc_id, r.n_tokens, r.n_known, r.rest) for r in model.score(docs).collect()}
    assert rows == {(1, 4, 4, 1), (None, 1, 1, 2), (2, 1, 1, 3), (3, 3, 1, 4)}
    assert {r["_doc.x"] for r in model.score(docs).collect()} == {8}
    empty = docs.limit(0)
    assert lm.Model(empty, F.lit(True)).score(empty).count() == 0
    assert lm.Model(empty, F.lit(True)).score(docs).count() == 5


def test_every_head_word_is_a_symbol_of_its_own(spark):
    words = [f"w{i}" for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(60)], "doc_id long, text string")
    model = lm.Model(docs, F.lit(True))
    places, _ = model.head.value
    _, ids = lm.symbols(places, [w.encode() for w in words])
    assert len(set(ids[:-1].tolist())) == 600 and lm.REST not in ids
    classes, _, band = model.weights["Ww"].shape
    assert classes * band >= 602 and abs(classes - band) <= 1
    met = np.ones(len(model.weights["E"]), bool)
    more = {k: v + np.float32(0.5) for k, v in model.weights.items()}
    back = lm.changed(model.weights, ((place, np.frombuffer(d, np.float16)) for place, d in lm.changes(more, model.weights, met)))
    assert all(np.allclose(back[k], more[k], atol=1e-3) for k in more)


def test_score_of_a_rare_word_depends_on_its_context():
    rng = np.random.default_rng(2)
    stream = np.concatenate([[*np.repeat(rng.integers(300, 600, 30), 2), lm.END] for _ in range(800)]).astype(np.int32)
    trainer = lm.Trainer(lm.start_weights(np.ones(lm.shapes(602)["E"][0])))
    for _ in range(6):
        trainer.learn(stream)
    p = lambda *ids: lm.log10_probabilities(trainer.w, [np.array([*ids, lm.END], np.int32)])[0]
    pairs = [(i, 899 - i) for i in range(300, 450)]
    assert np.mean([p(i, i) + p(k, k) - p(i, k) - p(k, i) for i, k in pairs]) > 0.1


def test_every_symbol_of_a_stream_is_learnt():
    for n in (1, 31, 33, 1000, 512 * 32 + 511, 512 * 33 + 1):
        trainer, seen = lm.Trainer(lm.start_weights(np.ones(lm.SYMBOLS))), []
        trainer.adam = lambda grad, n, seen=seen: seen.append((n, float(np.abs(grad["bw"]).sum())))
        stream = np.random.default_rng(n).integers(0, lm.SYMBOLS, n).astype(np.int32)
        trainer.learn(stream)
        assert sum(k for k, _ in seen) == n and all(g > 0 for _, g in seen)


def test_score_against_plain_python(spark):
    words = [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, n, p=np.arange(40, 0, -1) / 820)) for n in (0, 1, 7, 30, 150, 90, 400)] + ["never seen", None, "w0 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head, vocabulary = lm.HEAD, lm.VOCABULARY
    try:
        lm.HEAD, lm.VOCABULARY = 20, 10
        model = lm.Model(docs, F.col("doc_id") < 7)
        rows = {r.doc_id: r for r in model.score(docs).collect()}
    finally:
        lm.HEAD, lm.VOCABULARY = head, vocabulary
    tokens = [[*(t or "").split(), ""] for t in texts]
    c = Counter(w for ws in tokens[:7] for w in ws)
    by_count = sorted((w for w in c if w), key=lambda w: (-c[w], w))
    symbol = {w: i + 2 for i, w in enumerate(by_count[:10])} | {"": lm.END}
    others = sum(c[w] + 1 for w in c if w not in symbol) + 1
    w = {k: v.astype(float) for k, v in model.weights.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, band = lm.HIDDEN, w["bw"].shape[1]
    for d, ws in enumerate(tokens[:9]):
        h, x, total = np.zeros(n), lm.END, 0.0
        for token in ws:
            gx, gh = w["E"][x], h @ w["U"]
            r, z = sigmoid(gx[:n] + gh[:n]), sigmoid(gx[n : 2 * n] + gh[n : 2 * n])
            inner = np.tanh(gx[2 * n :] + r * (gh[2 * n :] + w["bn"]))
            h = (1 - z) * inner + z * h
            y = symbol.get(token, lm.REST)
            of_class, of_word = h @ w["Wc"] + w["bc"], h @ w["Ww"][y // band] + w["bw"][y // band]
            total += of_class[y // band] - np.log(np.exp(of_class).sum()) + of_word[y % band] - np.log(np.exp(of_word).sum())
            total += math.log((c[token] + 1) / others) if y == lm.REST else 0
            x = y
        assert rows[d].score == pytest.approx(total / math.log(10), rel=1e-4, abs=2e-3), d
    assert rows[9].n_tokens == 20_001


def test_a_band_of_equal_counts_is_cut(spark):
    docs = spark.createDataFrame([(0, " ".join(f"w{i:03d}" for i in range(300)) + " a a b b")], "doc_id long, text string")
    head = lm.HEAD
    try:
        lm.HEAD = 12
        model = lm.Model(docs, F.lit(True))
        assert list(model.head.value[0]) == [b"a", b"b", *(f"w{i:03d}".encode() for i in range(10))]
    finally:
        lm.HEAD = head


def test_long_texts_are_scored_in_few_lots(monkeypatch):
    w = lm.start_weights(np.ones(lm.SYMBOLS))
    texts = [np.array([*np.random.default_rng(i).integers(1, 256, n), 0], np.int32) for i, n in enumerate((20_000, 70, 0, 9_000))]
    seen, outputs = [], lm._outputs
    monkeypatch.setattr(lm, "_outputs", lambda w, h, y, grad=None: seen.append(len(y)) or outputs(w, h, y, grad))
    together = lm.log10_probabilities(w, texts)
    assert len(seen) == 1 and sum(seen) == sum(map(len, texts))
    assert together == pytest.approx([lm.log10_probabilities(w, [t])[0] for t in texts], rel=1e-4)
    many = [np.full(2_000, 7, np.int32)] * 40
    seen.clear()
    assert len(set(np.round(lm.log10_probabilities(w, many), 3))) == 1 and len(seen) == 3 and sum(seen) == 80_000
