"""What the learned operators compute, written out in plain Python."""

import math
import random

import numpy as np
import pyarrow as pa

from wickwork.llm import quality, toxicity
from wickwork.llm.quality import label_sample, one_text


def own_buckets(text):
    tokens = quality.TOKEN.findall((text or "").encode())
    ids = [quality._bucket(t) for t in tokens]
    return [0 if k and ids[k] == ids[k - 1] else x for k, x in enumerate(ids)]


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(("alpha", "beta", "Gamma", "DELTA", "x1", "...", "été", "beta")) + rng.choice(("", "s", "!")) for _ in range(n))


TEXTS = [words(n, n) for n in (1, 2, 3, 40, 200)] + [None, "", "   ", "a a a a b", words(5000, 7)]


def test_neighbour_sums(monkeypatch):
    places, signs = quality.index_places()
    want = {}
    for text in TEXTS:
        ids = own_buckets(text)
        for i, x in enumerate(ids):
            row = want.setdefault(x, [0] * quality.DIM)
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if j != i:
                    for p, s in zip(places[ids[j]], signs[ids[j]], strict=True):
                        row[p] += int(s)
    for size in (quality.SLICE, 64):
        monkeypatch.setattr(quality, "SLICE", size)
        (batch,) = quality._neighbours(iter([pa.RecordBatch.from_arrays([pa.array(TEXTS)], ["text"])]))
        assert {r.pop("bucket"): list(r.values()) for r in batch.to_pylist()} == want


def test_pooling(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    for counts in (quality.COUNTS, 100):
        monkeypatch.setattr(quality, "COUNTS", counts)
        got = quality.pool(pa.array(TEXTS), vectors, {})
        for row, text in zip(got, TEXTS, strict=True):
            x = vectors[own_buckets(text)].astype(float)
            want = np.concatenate([x.mean(0), x.std(0)]) if len(x) else np.zeros(2 * quality.DIM)
            assert np.allclose(row, want, atol=2e-3)


def test_network_is_its_formula():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = quality.Network(x, y, np.arange(300) % 4 == 0)
    z = [sum(math.tanh(sum((r[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(6)) + net.b1[j]) * net.w2[j] for j in range(len(net.w2))) + net.b2 for r in x[:20]]
    assert np.allclose(net(x[:20]), [1 / (1 + math.exp(-v / net.temperature)) for v in z])
    assert ((net(x) >= 0.5) == (y > 0)).mean() > 0.95


def test_sentence_scores_are_a_noisy_or():
    model = toxicity.NoisyOr(0.01)
    model.bias = -6.0
    model.weights = {f: w for word, w in (("idiot", 5.0), ("fools", 3.0), ("kind", -2.0)) for f in toxicity.features(word)[:1]} | {toxicity.features("worthlessly")[-1]: 7.5}
    text = "A kind day. You IDIOT and fools! Worthlessly said, worthless. fools\nNothing here"
    named = {"idiot": 5.0, "fools": 3.0, "kind": -2.0}
    none, offending = 1 - model.leak, []
    for m in toxicity.SENTENCE.finditer(text.lower()):
        own = set(toxicity.WORD.findall(m.group()))
        z = model.bias + sum(named.get(w, 0.0) for w in own) + 7.5 * any(w.startswith("worthle") and len(w) > 7 for w in own)
        p = 1 / (1 + math.exp(-z))
        none *= 1 - p
        if p >= 0.5:
            offending.append(text[m.start() : m.end()].strip())
    score, found = toxicity.sentence_scores(text, model, {})
    assert math.isclose(score, 1 - none) and [x[3] for x in found] == offending == ["You IDIOT and fools", "Worthlessly said, worthless"]


def test_training_lowers_the_noisy_or_loss():
    """One informative feature; the fitted weights give a smaller loss than small steps away from them."""
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.3).astype(float)
    sentences = np.full(400, 3.0)
    noise = (rng.random(400) < 0.4).astype(int)
    pairs = y.astype(int) + noise
    sentence = np.concatenate([[0] * k for k in pairs]).astype(np.int64)
    feature = np.concatenate([[7] * int(a) + [9] * b for a, b in zip(y, noise, strict=True)]).astype(np.int64)
    m = toxicity.NoisyOr().fit(y, sentences, pairs, sentence, feature)
    assert m.weights[7] > 4 and abs(m.weights.get(9, 0.0)) < 1 and 0 < m.leak < 0.2


def test_one_text_for_each_id(spark, make):
    docs = make([(1, "a"), (1, "b"), (1, "b"), (2, None), (None, "x"), *[(3, f"t{k}") for k in range(50)]])
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id bigint, toxic int")
    rows = one_text(docs, label_sample(labels, "toxic")).collect()
    assert sorted((r["doc_id"], r["y"]) for r in rows) == [(1, 1.0), (2, 0.0), (3, 1.0)]
    assert label_sample(labels, "toxic", 2).count() == 2
