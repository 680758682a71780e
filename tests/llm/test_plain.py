"""Plain versions of both classifiers' arithmetic, and texts above one part."""

from __future__ import annotations

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest

from roadworthy.llm import language_id, quality, simhash


def _hash(codes):
    h = len(codes)
    for c, odd in zip(codes, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        h = (h ^ c) * odd % 2**32
        h ^= h >> 15
    return h % language_id.BUCKETS


def grams(text):
    codes = [ord(c) for c in text.lower()]
    return Counter(_hash(codes[i:i + n]) for n in (2, 3) for i in range(len(codes) - n + 1))


def test_follow_the_regularised_leader_step_by_step():
    rng = random.Random(4)
    words = {"x": ["the", "thing", "that"], "y": ["die", "und", "der"], "z": ["les", "des", "où"]}
    sample = [(" ".join(rng.choices(words[k], k=rng.randint(1, 9))), k) for k in rng.choices("xyz", k=60)]
    idf = np.array([1 + (b % 7) / 10 for b in range(language_id.BUCKETS)])
    model = language_id.fit([t for t, _ in sample], [k for _, k in sample], idf)

    z, n = Counter(), Counter()  # by (coordinate, label)

    def weight(c, k):
        if abs(z[c, k]) <= language_id.L1:
            return 0.0
        return -(z[c, k] - math.copysign(language_id.L1, z[c, k])) / ((language_id.BETA + math.sqrt(n[c, k])) / language_id.ALPHA + language_id.L2)

    def features(text):
        raw = {b: (1 + math.log(c)) * idf[b] for b, c in grams(text).items()}
        length = math.sqrt(sum(v * v for v in raw.values())) or 1
        return {b: v / length for b, v in raw.items()}

    def probabilities(x):
        s = {k: sum(v * weight(c, k) for c, v in x.items()) for k in "xyz"}
        e = {k: math.exp(v - max(s.values())) for k, v in s.items()}
        return {k: v / sum(e.values()) for k, v in e.items()}

    for _ in range(language_id.EPOCHS):
        for i, (text, label) in enumerate(sample):
            if i % 5 == 4:
                continue
            x = features(text) | {"bias": 1.0}
            old = {(c, k): weight(c, k) for c in x for k in "xyz"}
            p = probabilities(x)
            for c, v in x.items():
                for k in "xyz":
                    g = v * (p[k] - (k == label))
                    rate = (math.sqrt(n[c, k] + g * g) - math.sqrt(n[c, k])) / language_id.ALPHA
                    z[c, k] += g - rate * old[c, k]
                    n[c, k] += g * g
    assert model.labels == ["x", "y", "z"]
    for k, label in enumerate("xyz"):
        assert model.bias[k] == pytest.approx(weight("bias", label), abs=1e-5)
        for b in {b for t, _ in sample for b in grams(t)}:
            assert model.weights[b, k] == pytest.approx(weight(b, label), abs=1e-5)
    for text in ("the thing", "und der", "où les", "neither"):
        x = features(text) | {"bias": 1.0}
        s = {k: sum(v * weight(c, k) for c, v in x.items()) / model.temperature for k in "xyz"}
        e = {k: math.exp(v) for k, v in s.items()}
        names, scores = model.predict([text])
        assert names[0] == max(e, key=e.get) and scores[0] == pytest.approx(max(e.values()) / sum(e.values()), abs=1e-4)


def test_gated_attention_passage_by_passage():
    texts = ["word " * 300, "!!! ### " * 90, "short", "", None, "UPPER lower " * 150]
    x, owner = quality.passages(texts)
    net = quality.Network.start(x, 0.3)
    scores, weights = net.score(texts)
    p = net.p
    for i in range(len(texts)):
        hidden, attention = [], []
        for row in x[owner == i]:
            v = [max(-8.0, min(8.0, (a - m) * s)) for a, m, s in zip(row, p["mean"], p["scale"])]
            h = [math.tanh(sum(a * w for a, w in zip(v, p["encode"][:, j])) + p["shift"][j]) for j in range(quality.HIDDEN)]
            gated = [math.tanh(sum(a * w for a, w in zip(h, p["tanh"][:, j]))) / (1 + math.exp(-sum(a * w for a, w in zip(h, p["gate"][:, j]))))
                     for j in range(quality.GATE)]
            hidden.append(h)
            attention.append(math.exp(sum(g * w for g, w in zip(gated, p["attend"]))))
        share = [a / sum(attention) for a in attention]
        bag = [sum(s * h[j] for s, h in zip(share, hidden)) for j in range(quality.HIDDEN)]
        assert weights[i] == pytest.approx(share, abs=1e-9)
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-sum(b * w for b, w in zip(bag, p["score"])) - p["base"])), abs=1e-9)


def test_parts_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcde ABCΣİß😀\n\t  12.,é", k=rng.choice([0, 1, 2, 3, 9, 40, 3000]))) for _ in range(60)] + [None]
    known = [t or "" for t in texts]
    whole = quality.passages(texts), language_id._grams(known)
    for part in (1, 2, 7, 1000):
        monkeypatch.setattr(quality, "_PART", part)
        monkeypatch.setattr(language_id, "_PART", part)
        monkeypatch.setattr(simhash, "_BLOCK", part)
        for got, want in zip(quality.passages(texts) + language_id._grams(known), whole[0] + whole[1]):
            assert np.array_equal(got, want)
        for t in known:
            assert simhash.fingerprint(t.encode(), 3) % 2**64 == brute.simhash(t)
    for i, t in enumerate(known):
        row, bucket, count = whole[1]
        assert dict(zip(bucket[row == i].tolist(), count[row == i].tolist())) == grams(t)


def test_a_text_above_one_piece(spark):
    text = "some words of a very long text, number %d. " * 230_000
    assert len(text) > 9 << 20
    docs = spark.createDataFrame([(1, text), (2, "a short one"), (3, text)], "doc_id long, text string")
    model = language_id.learn(spark.createDataFrame([("a short one", "en"), ("ein kurzer", "de")], "text string, label string"))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == {1: "en", 2: "en", 3: "en"}
    net = quality.learn(docs.where("doc_id = 2"), spark.createDataFrame([(2, 0)], "doc_id long, label int"))
    sizes = {r.doc_id: len(r.passages) for r in quality.score(docs, net).collect()}
    assert sizes == {1: -(-len(text) // quality.PASSAGE), 2: 1, 3: -(-len(text) // quality.PASSAGE)}
    roots = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert roots == {1: 1, 2: 2, 3: 1}
