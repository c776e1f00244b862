"""Attention over passages: held-out accuracy, gradients against differences, scores against loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import quality, queries
from shelfmark.llm.common import fold


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(4)
    made = quality.Model.fresh(rng.random((50, quality.WIDTH)))
    made.p["shift"], made.p["bias"] = rng.normal(0, 0.2, quality.ENCODED), np.array(0.3)
    return made


def score_by_loops(vectors, model):
    """One document's score, passage by passage."""
    p, weights, encoded = model.p, [], []
    for v in vectors:
        h = np.tanh(((v - model.mean) / model.spread) @ p["encode"] + p["shift"])
        t = np.tanh(h @ p["tanh"])
        g = 1 / (1 + np.exp(-(h @ p["gate"])))
        weights.append(math.exp(float((t * g) @ p["weigh"])))
        encoded.append(h)
    z = sum(w * h for w, h in zip(weights, encoded, strict=True)) / sum(weights)
    return 1 / (1 + math.exp(-float(z @ p["score"] + p["bias"])))


def vectors_by_loops(text):
    """Kinds of characters and repetition of every passage's words, without the hashed part."""
    words = text.split()
    out = []
    for i in range(0, max(len(words), 1), quality.WORDS):
        part = words[i : i + quality.WORDS]
        same = sum(a == b for a, b in zip(part, part[1:], strict=False))
        n = max(len(part), 1)
        out.append([math.log1p(n) / 5, len(set(part)) / n, same / n, sum(min(len(w), 64) for w in part) / n / 10])
    return np.array(out)


def test_passages_against_loops(odd_rows):
    texts = [(t or "").encode() for _, t, *_ in odd_rows]
    texts = [t for t in texts if t.split()]
    for run in (texts, texts[::-1]):
        vectors, owner = quality.passages(run)
        for i, text in enumerate(run):
            own = vectors[owner == i]
            expected = vectors_by_loops(text)
            assert own.shape == (len(expected), quality.WIDTH)
            low = quality._KINDS
            assert np.allclose(own[:, low : low + 4], expected)
            assert np.allclose(own[:, :low].sum(axis=1), 1)


def test_vectors_of_a_text_do_not_depend_on_its_neighbours(odd_rows):
    texts = [(t or "").encode() for _, t, *_ in odd_rows]
    together, owner = quality.passages(texts)
    for i, text in enumerate(texts):
        alone, _ = quality.passages([text])
        assert np.array_equal(together[owner == i], alone)


def test_scores_against_loops(odd_rows, model):
    texts = [t if t is None else t.encode() for _, t, *_ in odd_rows]
    found = quality.score_texts(texts, model)
    for text, score in zip(texts, found, strict=True):
        vectors = np.concatenate([v for *_, v, _ in quality.bags([text])])
        assert score == pytest.approx(score_by_loops(vectors, model), abs=1e-5)


def test_blank_texts_are_one_empty_passage(model):
    found = quality.score_texts([None, b"", b" \n\t", b"x"], model)
    assert found[0] == found[1] == found[2] != found[3]
    assert quality.score_texts([], model).tolist() == []


def test_long_texts_are_read_in_stretches(model, monkeypatch):
    text = b" ".join(b"word%d" % (i % 97) for i in range(20_000))
    whole = quality.score_texts([text], model)
    monkeypatch.setattr(quality, "STRETCH", 5000)
    assert sum(len(v) for *_, v, _ in quality.bags([b"a", text, b"b"])) >= 20_000 / quality.WORDS + 2
    # The last passage of a stretch may be shorter, so the bags differ a little.
    assert quality.score_texts([text], model) == pytest.approx(whole, abs=0.05)


def test_gradients_against_differences(model):
    rng = np.random.default_rng(2)
    vectors, starts, labels = rng.random((11, quality.WIDTH)), np.array([0, 1, 5, 6]), np.array([0, 1, 0.5, 1])
    _, gradients = model.gradients(vectors, starts, labels)
    for name, gradient in gradients.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in np.shape(gradient))
            old = model.p[name][at] if at else float(model.p[name])
            values = []
            for shift in (1e-5, -1e-5):
                model.p[name] = np.array(model.p[name])
                model.p[name][at] = old + shift
                values.append(model.gradients(vectors, starts, labels)[0])
            model.p[name][at] = old
            assert np.asarray(gradient)[at] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-3, abs=1e-8)


def test_attention_finds_the_passage():
    """One bad passage among good ones makes a bad document: a mean over passages would blur it."""
    rng = np.random.default_rng(0)
    good = lambda n: [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n)]
    bad = lambda n: ["###" + rng.choice(["x", "y"]) for _ in range(n)]
    texts, labels = [], []
    for i in range(240):
        words = good(64 * 12)
        if i % 2:
            at = 64 * int(rng.integers(12))
            words[at : at + 64] = bad(64)
        texts.append(" ".join(words).encode())
        labels.append(1.0 - i % 2)
    own = [np.concatenate([v for *_, v, _ in quality.bags([t])]) for t in texts[:160]]
    sizes = np.array(list(map(len, own)))
    fitted = quality.fit(np.concatenate(own), np.cumsum(sizes) - sizes, np.array(labels[:160]))
    found = quality.score_texts(texts[160:], fitted)
    assert ((found >= 0.5) == (np.array(labels[160:]) == 1)).all()


def test_held_out_accuracy(spark):
    """On the documents whose labels are not learned from; 15 % of them are bad."""
    folder = "/root/testdata/sf0.01"
    rows = queries.op12_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert rows.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.3 AS INT)").count() == 0
    found = rows.where("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    assert len(found) > 50
    assert sum(r.quality == r.predicted for r in found) >= 0.95 * len(found)
    pairs = [(a.score, b.score) for a in found if a.quality for b in found if not b.quality]
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) >= 0.97 * len(pairs)


def test_held_out_labels_change_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    held = F.coalesce(fold(labels, 5) == 0, F.lit(False))
    expected = {tuple(r) for r in queries.op12_quality(spark, folder).select("doc_id", "score").collect()}
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    docs_held = F.coalesce(fold(docs, 5) == 0, F.lit(False))
    model = quality.learn(docs.where(~docs_held), turned.where(~held))
    assert {tuple(r) for r in quality.score(docs, model).select("doc_id", "score").collect()} == expected


def test_odd_table(spark, odd, odd_rows):
    labels = [(i, int(i % 3 > 0)) for i in range(3, 60)] + [(10, 0), (None, 1), (4, None), (None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    found = quality.score(odd, quality.learn(odd, labels))
    assert found.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    rows = found.select("doc_id", "text", "score", "predicted").collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if 10 <= (r.doc_id or 0) < 16}) == 1


def test_sample_is_bounded(spark, monkeypatch):
    """A third of all rows under one labelled id: no more than the sample is learned from."""
    seen = []
    monkeypatch.setattr(quality.Model, "load", lambda data: seen.append(data))
    docs = [(1 if i % 3 == 0 else i, f"text {'###' * (i % 2)} number {i}") for i in range(300)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    quality.learn(docs, labels, sample=20)
    assert len(seen) == 1


def test_without_labels_or_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    model = quality.learn(odd, labels)
    assert model is None
    assert {tuple(r) for r in quality.score(odd, model).select("score", "predicted").collect()} == {(0.5, 1)}
    assert quality.score(none, model).count() == 0
    assert quality.learn(none, labels) is None
