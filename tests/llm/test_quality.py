import math
import random
import zlib

import numpy as np

from sparkrecall.llm import quality
from sparkrecall.llm.quality import N_FEATURES, encode, fit, score


def corpus(words, n=240, seed=5):
    rnd, texts, labels = random.Random(seed), [], []
    for i in range(n):
        body = " ".join(rnd.choices(words, k=rnd.randint(40, 300)))
        good = rnd.random() < 0.6
        if not good:  # one spoilt passage in clean text
            k = rnd.randint(0, len(body))
            body = body[:k] + " " + " ".join(w.upper() + "!!" for w in rnd.choices(words, k=80)) + " " + body[k:]
        texts.append(body)
        labels.append((i, int(good), 0))
    return texts, labels


def test_held_out_accuracy(spark, docs_of, words):
    texts, labels = corpus(words)
    texts += [None, "", "  ", "w " * 300_000]
    df = docs_of(texts).selectExpr("*", "1 as score", "0 as quality")
    lab = spark.createDataFrame(labels + [(0, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in score(df, lab).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    truth = {i: q for i, q, _ in labels}
    assert len(held) > 30 and sum(got[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[240]["score"] == got[241]["score"] == got[242]["score"]
    flipped = spark.createDataFrame([(i, 1 - q if got[i]["held_out"] else q, 0) for i, q, _ in labels], "doc_id bigint, quality int, toxic int")
    again = {r["doc_id"]: r["score"] for r in score(df, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in range(240))  # held-out labels teach nothing


def test_attention_finds_the_passage(words):
    texts, labels = corpus(words, 200, 6)
    model = fit([encode(t).astype(float) for t in texts], np.array([float(q) for _, q, _ in labels]))
    bad = " ".join(words[:128]) + " " + " ".join(w.upper() + "!!" for w in words[:64]) + " " + " ".join(words[128:256])
    p, weights = model(encode(bad))
    assert p < 0.5 and weights.argmax() == 2 and abs(weights.sum() - 1) < 1e-6


def test_nothing_to_learn(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r["score"] for r in score(docs_of(["a b"]), none).collect()] == [0.5]
    assert score(docs_of([]), none).count() == 0
    assert encode("a\n" * 70).shape == (2, N_FEATURES)


def plainly(model, features):
    """Score and weights of one bag, number by number."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    p, hs, logits = model.p, [], []
    for row in features:
        x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(x[i] * p["E"][i][j] for i in range(len(x))) + p["e"][j]) for j in range(len(p["e"]))]
        v = [math.tanh(sum(h[i] * p["V"][i][j] for i in range(len(h)))) for j in range(len(p["w"]))]
        u = [sig(sum(h[i] * p["U"][i][j] for i in range(len(h)))) for j in range(len(p["w"]))]
        hs.append(h)
        logits.append(sum(a * b * c for a, b, c in zip(v, u, p["w"])))
    e = [math.exp(z) for z in logits]
    a = [z / sum(e) for z in e]
    return sig(sum(w * sum(x * c for x, c in zip(h, p["c"])) for w, h in zip(a, hs)) + p["b"][0]), a


def test_query_against_plain_attention(spark, docs_of, words, monkeypatch):
    """The weights are learned once; every score is worked out again from them."""
    texts, labels = corpus(words, 60, 8)
    texts += [None, "", " ".join(words) * 3]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.train(docs_of(texts), lab)
    monkeypatch.setattr(quality, "train", lambda *a: model)
    for r in score(docs_of(texts), lab).collect():
        want, weights = plainly(model, encode(texts[r["doc_id"]]).astype(float).tolist())
        assert abs(r["score"] - want) < 1e-6 and abs(sum(weights) - 1) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_all_passages_of_a_sampled_document_teach(spark, docs_of, words, monkeypatch):
    texts = [" ".join(words[:200])] * 3 + [" ".join(words) * 20, "", None]
    lab = spark.createDataFrame([(i, i % 2, 0) for i in (0, 1, 3, 4, 5)] + [(2, 1, 0)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append(sorted(map(len, bags))))
    kept = [i for i in range(6) if zlib.crc32(str(i).encode()) % 4 != 2]
    quality.train(docs_of(texts), lab)
    assert seen.pop() == sorted(len(encode(texts[i])) for i in kept)
    quality.train(docs_of(texts), lab, max_taught=64)  # the long one has more than four passages
    assert seen.pop() == sorted(len(encode(texts[i])) for i in kept if i != 3)
    quality.train(docs_of(texts), lab, max_taught=1)
    assert seen.pop() == []


def test_empty_texts_are_learned(spark, docs_of, words):
    texts = ["" if i % 3 == 0 else " ".join(words[i : i + 70]) for i in range(90)]
    for label in (0, 1):
        lab = spark.createDataFrame([(i, label if i % 3 == 0 else 1 - label, 0) for i in range(90)], "doc_id bigint, quality int, toxic int")
        got = {r["doc_id"]: r["score"] for r in score(docs_of(texts), lab).collect()}
        assert abs(got[0] - label) < 0.3
