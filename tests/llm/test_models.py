import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.samples import docs, prose
from tiergraph.llm import lm_ranges, lm_score, quality

SF = "/root/testdata/sf0.01"


def events(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return list(zip(["<s>", *w], [*w, "</s>"]))


class Naive:
    """Two models over one vocabulary, each with all pairs of its own texts, in dictionaries."""

    def __init__(self, target, background, least=2):
        grams = [Counter(), Counter()]
        words = [Counter(), Counter()]
        self.n = [0, 0]
        for k, texts in enumerate((target, background)):
            for t in texts:
                for h, w in events(t):
                    grams[k][(h, w)] += 1
                    words[k][w] += 1
                    self.n[k] += 1
        self.vocabulary = {w for w, c in words[0].items() if c >= least}
        self.words, self.grams = words, grams
        self.begins = [len(target), len(background)]

    def loss(self, text, k):
        known = self.vocabulary | {"<s>"}
        pairs = {(h, w) for h, w in self.grams[k] if h in known and w in self.vocabulary}
        total = 0.0
        size = len(self.vocabulary) + 1
        known = sum(self.words[k][w] for w in self.vocabulary)

        def single(w):
            c = self.words[k][w] if w in self.vocabulary else self.n[k] - known
            return (c + 1) / (self.n[k] + size)

        def left(h):
            n = self.begins[k] if h == "<s>" else self.words[k][h]
            used = sum(max(self.grams[k][p] - 0.5, 0) for p in pairs if p[0] == h)
            return n, max(1 - used / max(n, 1), 1e-6)

        for h, w in events(text):
            context = h == "<s>" or h in self.vocabulary
            n, gamma = left(h) if context else (1, 1.0)
            p = gamma * single(w)
            if (h, w) in pairs:
                p += max(self.grams[k][(h, w)] - 0.5, 0) / max(n, 1)
            total -= math.log(p)
        return total / len(events(text))


def test_losses_match_plain_models_both_ways(spark):
    r = random.Random(1)
    make = lambda seed, ws: " ".join(random.Random(seed).choice(ws) for _ in range(r.randrange(1, 30)))
    target = [make(i, ["a", "b", "c", "d"]) for i in range(30)]
    background = [make(90 + i, ["a", "b", "e", "f", "É", "g"]) for i in range(40)] + ["", prose(4, 3_000)]
    ids = [*range(len(background)), None, 3]
    texts = [*background, None, "A b C"]
    source = docs(spark, list(zip(ids, texts)))
    model, rates = lm_score.fit(spark.createDataFrame([(t,) for t in target], "text string"), source)
    naive = Naive(target, texts)
    want = sorted((len(events(t)), naive.loss(t, 0), naive.loss(t, 1)) for t in texts)
    for most in (10**6, 0):
        got = lm_score.score(source, model, rates, broadcast_entries=most).collect()
        rows = sorted((r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got)
        assert np.allclose(rows, want, atol=1e-4)
        assert all(abs(r["difference"] - r["target_loss"] + r["background_loss"]) < 1e-9 for r in got)


def test_each_model_has_the_pairs_of_its_own_texts(spark):
    target = ["a b", "a b", "b c", "c a", "d", "d d", "once d"]
    background = ["b a d c"] * 20 + ["c d a b x a", "a x once b", "", "d b a d c"]
    source = docs(spark, [*enumerate(background), (50, None)])
    model, rates = lm_score.fit(spark.createDataFrame([(t,) for t in target], "text string"), source)
    texts = [*background, None]
    separate = Naive(target, texts)
    want = sorted((separate.loss(t, 0), separate.loss(t, 1)) for t in texts)
    for most in (10**6, 0):
        got = lm_score.score(source, model, rates, broadcast_entries=most).collect()
        assert np.allclose(sorted((r["target_loss"], r["background_loss"]) for r in got), want, atol=1e-5)


@pytest.mark.parametrize("flush, width", [(50, 7), (300, 40), (10**6, 10**6)])
def test_losses_by_ranges_match_plain_models(spark, monkeypatch, flush, width):
    monkeypatch.setattr(lm_ranges, "FLUSH", flush)
    monkeypatch.setattr(lm_ranges, "RANGE", width)
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É"]
    make = lambda n: " ".join(r.choice(words[: r.randrange(2, 41)]) for _ in range(n))
    target = [make(r.randrange(60)) for _ in range(30)] + ["hot hot " * 90]
    texts = [make(r.randrange(80)) for _ in range(60)] + ["hot " * 2_000, "", None, "unseen w1 unseen"] + ["w1 w2"] * 9
    source = spark.createDataFrame(
        [(str(i) if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id string, text string"
    ).repartition(3)
    model, rates = lm_score.fit(spark.createDataFrame([(t,) for t in target], "text string"), source)
    assert model.agg(F.min("n")).first()[0] > 0
    naive = Naive(target, texts)
    want = sorted((str(i) if i % 7 else "", naive.loss(t, 0), naive.loss(t, 1)) for i, t in enumerate(texts))
    for most in (10**6, 60, 0):
        got = lm_score.score(source, model, rates, broadcast_entries=most).collect()
        rows = sorted((r["id"] or "", r["target_loss"], r["background_loss"]) for r in got)
        assert [x[0] for x in rows] == [x[0] for x in want]
        assert np.allclose([x[1:] for x in rows], [x[1:] for x in want], atol=1e-5)


def test_large_vocabularies_are_joined_by_key(spark):
    target = ["a b", "a b", "b c", "c a", "d", "d d", "once d"]
    texts = ["b a d c"] * 20 + ["c d a b x a", "a x once b", "", "d b a d c", None]
    source = docs(spark, list(enumerate(texts)))
    naive = Naive(target, texts)
    want = sorted((naive.loss(t, 0), naive.loss(t, 1)) for t in texts)
    both = spark.createDataFrame([(t,) for t in target], "text string"), source
    for most in (0, 10**6):
        model, rates = lm_score.fit(*both, vocabulary=most)
        got = lm_score.score(source, model, rates).collect()
        assert np.allclose(sorted((r["target_loss"], r["background_loss"]) for r in got), want, atol=1e-5)


def test_scoring_with_empty_sides(spark):
    none = spark.createDataFrame([], "text string")
    model, rates = lm_score.fit(none, docs(spark, [(1, "a b"), (2, None)]))
    assert lm_score.score(docs(spark, [(1, "a b"), (2, None)]), model, rates).count() == 2
    model, rates = lm_score.fit(spark.createDataFrame([("a a",), ("a a",)], "text string"), docs(spark, []))
    assert lm_score.score(docs(spark, []), model, rates).count() == 0


def test_gradients_of_the_attention_model():
    x, first = quality.encode([b"one two three", b"word " * 200, b"", b"MORE!! TEXT!!"])
    model = quality.Model(x.mean(0), x.std(0) + 1e-3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y = np.array([1, 0, 1, 0.0])
    grads = model.gradients(x.astype(np.float64), first, y)

    def loss():
        s = model.forward(x.astype(np.float64), first)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        for i in np.random.default_rng(3).integers(0, flat.size, 4):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-4, name


def test_passages_cover_whole_texts():
    x, first = quality.encode([b"w " * 130, None, b"", b"a"])
    assert len(x) == 3 + 1 + 1 + 1 and first.tolist() == [0, 3, 4, 5]
    alone = [quality.encode([t])[0] for t in (b"w " * 130, None, b"", b"a")]
    assert np.isfinite(x).all() and np.allclose(np.concatenate(alone), x)


@pytest.mark.parametrize("segment", [5, 64, 700])
def test_long_texts_are_encoded_in_blocks(monkeypatch, segment):
    r = random.Random(segment)
    kinds = ["a", "b", "a", "Hello", "É", "\n", "x" * 90]
    texts = [" ".join(r.choice(kinds) for _ in range(r.randrange(700))).encode() for _ in range(6)]
    texts = [*texts, None, b"", b"  ", b"y" * 900, b"z z " * 100]
    x, first = quality.encode(texts)
    model = quality.Model(x.mean(0), x.std(0) + 1e-3)
    scores, passages, weights = quality._scores(model, texts)
    monkeypatch.setattr(quality, "SEGMENT", segment)
    each, starts = quality.blocks(texts)
    each = list(each)
    assert len(each) > 3 and (starts == first).all() and np.allclose(np.concatenate(each), x, atol=1e-6)
    again = quality._scores(model, texts)
    assert np.allclose(again[0], scores, atol=1e-6) and again[1] == passages and np.allclose(again[2], weights, atol=1e-6)


def test_scores_without_labels_and_with_odd_rows(spark):
    shape = "doc_id long, quality int, toxic int, text string"
    source = docs(spark, [(1, None), (2, ""), (None, "x"), (3, prose(1, 20_000)), (3, "again")])
    assert quality.fit(source, spark.createDataFrame([], shape)) is None
    got = quality.score(source, None).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    labels = [(1, 1, 0, "t"), (2, 0, 0, "t"), (3, 1, 0, "t"), (4, None, 0, "t"), (None, 1, 0, "t"), (1, 0, 0, "t")]
    model = quality.fit(source, spark.createDataFrame(labels, shape))
    got = quality.score(source, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep_good(source, None).columns == source.columns
    assert quality.score(docs(spark, []), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_quality(spark):
    source, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score(source, quality.fit(source, labels)).withColumnRenamed("id", "doc_id")
    rows = scored.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    above = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert above > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.95
