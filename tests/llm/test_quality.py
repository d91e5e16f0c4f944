"""The classifier against plain versions of its features, training steps and scores."""

import os

import numpy as np
import pytest

from glycospark.llm import quality
from glycospark.llm.catalog import all_queries

FOLDER = "/root/testdata/sf0.01"
TEXTS = ["", " \t\n", "a", "ab cd", "a  bb\nccc dddd ééééé", "日本語 text 🙂🙂🙂🙂", " lead and trail  ", "aaaa aaaa aaaa", "x" * 50]


def plain_grams(text):
    """The 3- and 4-grams of each ``<word>``, as text."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return {n: [("<" + w + ">")[i : i + n] for w in words for i in range(len(w) + 3 - n)] for n in (3, 4)}


def plain_hashes(grams):
    out = []
    for gram in grams:
        # "<" and ">" are one sign that no text holds
        c = [(0x110000 if k in (0, len(gram) - 1) and ch in "<>" else ord(ch)) * 0x9E3779B1 % 2**32 for k, ch in enumerate(gram)]
        three = ((c[0] * 31 + c[1]) * 0x85EBCA77 ^ c[2] >> 3) % 2**32 * 0xC2B2AE3D % 2**32
        out.append((three if len(gram) == 3 else (three ^ c[3] >> 5) * 0x27D4EB2F % 2**32) >> 16)
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_subwords_stay_within_words(text):
    grams = plain_grams(text)
    got = [p.tolist() for p in quality._subwords(text)] + [[], []]
    for n, found in zip((3, 4), got):
        want = plain_hashes(grams[n])
        assert sorted(found) == sorted(want)


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = " ".join(f"w{k * k % 997}" for k in range(3000)) + " " + "x" * 900 + " end"
    whole = [sorted(np.concatenate(p).tolist()) for p in [list(quality._subwords(text))]]
    monkeypatch.setattr(quality, "_PART", 500)
    parts = list(quality._subwords(text))
    assert len(parts) > 10 and [sorted(np.concatenate(parts).tolist())] == whole


def test_features_of_a_text_are_its_words_pairs_and_subwords():
    for text, found in zip(TEXTS, quality._features(TEXTS)):
        grams, words = plain_grams(text), text.split()
        assert len(found) == len(grams[3]) + len(grams[4]) + len(words) + max(0, len(words) - 1)
    one, two = quality._features(["red green blue", "blue  red\tgreen"])
    assert len(set(one.tolist()) & set(two.tolist())) >= len(one) - 2  # but for one pair of words, the same


def plain_train(rows):
    """The same steps of gradient descent, one feature at a time."""
    rng = np.random.default_rng(17)
    vectors = rng.uniform(-1 / quality.WIDTH, 1 / quality.WIDTH, (quality.BUCKETS, quality.WIDTH))
    weights, bias = np.zeros((2, quality.WIDTH)), np.zeros(2)
    done, steps = 0, quality.EPOCHS * len(rows)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(rows)):
            counts, label = rows[i]
            rate, done, total = quality.RATE * (1 - done / steps), done + 1, sum(counts.values())
            mean = sum(vectors[b] * n / total for b, n in counts.items())
            p = np.exp(weights @ mean + bias)
            p = p / p.sum() - np.eye(2)[label]
            back = p @ weights
            weights = weights - rate * np.outer(p, mean)
            bias = bias - rate * p
            for b, n in counts.items():
                vectors[b] = vectors[b] - rate * back * n / total * min(len(counts), 1000)
    return vectors, weights, bias


def test_training_and_scores_match_plain_steps(spark):
    texts = [("good clean prose about rivers", 1), ("more good prose, about hills", 1), ("buy buy buy now now", 0), ("click now buy cheap", 0), ("rivers and hills", 1), ("cheap cheap click", 0)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = []
    for (t, y), f in zip(texts, quality._features([t for t, _ in texts])):
        counts = {}
        for b in f.tolist():
            counts[b] = counts.get(b, 0) + 1
        rows.append((counts, y))
    vectors, weights, bias = plain_train(rows)
    tests = [t for t, _ in texts] + ["", "rivers now", "ünknown"]
    scored = spark.createDataFrame(list(enumerate(tests)), "k long, text string")
    got = [r.s for r in scored.select("k", quality.scorer(model)("text").alias("s")).orderBy("k").collect()]
    for t, f, s in zip(tests, quality._features(tests), got):
        mean = vectors[f].mean(axis=0) if len(f) else np.zeros(quality.WIDTH)
        logits = weights @ mean + bias
        assert s == pytest.approx(1 / (1 + np.exp(logits[0] - logits[1])), abs=2e-3), t
    assert all((s >= 0.5) == y for s, (_, y) in zip(got, texts))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in all_queries()[0]["op10_quality_classifier"](spark, FOLDER).collect()}
    truth = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert len(truth) > 50 and sum(r.predicted == q for r, q in truth) / len(truth) > 0.95
