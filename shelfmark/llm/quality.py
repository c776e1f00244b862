"""Document quality by attention over passages, learned from labels of whole documents.

A label says that something is wrong with a document, not where. So a document is a bag of passages
of `WORDS` words, all of its text. Every passage becomes a vector of frequencies (kinds of
characters, hashed triples of bytes, repetition of words), and a learned layer encodes it. Gated
attention, `w . (tanh(V h) * sigmoid(U h))`, says how much a passage matters; the weighted mean of the
encoded passages is scored by a logistic unit. All weights are learned together from the document
labels by gradient descent (Adam), with the gradients written out below.

Scoring is one pass over the documents without a shuffle; what workers receive are the weights, whose
number is fixed. Learning takes at most `SAMPLE` labelled documents, those with the smallest hash of
their id and text, and of each at most `BAG` passages, evenly spaced over the whole text. These bounds
are parameters of `learn`; what one task holds while it learns follows from them and not from the
corpus. Scoring looks at every passage of every document.

Defined results: a null, empty or blank text is one empty passage and is scored like any other; a
text's rows are independent, so repeated rows agree; several labels of one id count by their mean,
null labels and ids not at all; without any label the score is 0.5 everywhere. Texts are cut into
words at white space and held a stretch at a time, so memory does not follow a text's length but for
its encoded passages. Extra columns stay, except `score` and `predicted`, which are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stretches
from shelfmark.sources.tables import small_side

WORDS = 64  # of a passage
HASHED = 256  # features of byte triples
STRETCH = 1 << 20  # bytes of text whose passages are described at once

SAMPLE = 4096  # labelled documents that are learned from
BAG = 32  # passages of one of them
EPOCHS = 40
TOGETHER = 32  # documents of one step
RATE = 0.004
DECAY = 1e-4
ENCODED, GATE = 24, 12
SEED = 12

THRESHOLD = 0.3

_KINDS = 8
_OTHER = 6
WIDTH = _KINDS + _OTHER + HASHED

# Kinds of bytes: white space, line feed, capital, small letter, digit, mark, other symbol, beyond ASCII.
_KIND = np.full(256, 6, np.int64)
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[10] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[48:58] = 4
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 5
_KIND[128:] = 7
_BLANK = _KIND < 2
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, text of each vector): passages of `WORDS` words, one empty passage without a word."""
    # Every text between the same bytes, so that its vectors do not depend on its neighbours.
    data = np.frombuffer(b"\n " + b"\n ".join(texts) + b"\n ", np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    limits = np.cumsum([len(t) + 2 for t in texts]) + 1  # where the next text begins
    of_word = np.searchsorted(limits, starts, side="right")
    number = np.bincount(of_word, minlength=len(texts))
    within = np.arange(len(starts)) - np.repeat(np.cumsum(number) - number, number)
    counts = np.maximum(1, -(-number // WORDS))
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    of_word = first[of_word] + within // WORDS  # from here on: the word's passage

    # A byte belongs to the passage of the last word that began before it, within its text.
    text = np.minimum(np.searchsorted(limits, np.arange(len(data)), side="right"), len(texts) - 1)
    place = np.searchsorted(starts, np.arange(len(data)), side="right") - 1
    passage = first[text]
    if len(starts):
        passage = np.maximum(passage, np.where(place >= 0, of_word[place], 0))
    passage = passage[1:-1]
    size = np.bincount(passage, minlength=n)[:, None]
    kinds = np.bincount(passage * _KINDS + _KIND[data[1:-1]], minlength=n * _KINDS).reshape(n, _KINDS)

    x = data.astype(np.uint32)
    triple = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    hashed = (triple * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64) % HASHED
    triples = np.bincount(passage * HASHED + hashed, minlength=n * HASHED).reshape(n, HASHED)

    words = np.maximum(np.bincount(of_word, minlength=n), 1)
    other = np.zeros((n, _OTHER))
    other[:, 0] = np.log1p(words) / 5
    if len(starts):
        inside = np.cumsum(~blank)
        letters = data[~blank].astype(np.uint64) + np.uint64(1)
        low = inside[starts] - 1
        lengths = ends - starts
        at = np.arange(len(letters)) - np.repeat(low, lengths)
        name = np.add.reduceat(letters * _POWERS[at & 63] + (at.astype(np.uint64) >> np.uint64(6)), low)
        order = np.lexsort((name, of_word))
        new = np.append(True, (name[order][1:] != name[order][:-1]) | (np.diff(of_word[order]) != 0))
        other[:, 1] = np.bincount(of_word[order], new, n) / words
        same = np.append(False, (name[1:] == name[:-1]) & (of_word[1:] == of_word[:-1]))
        other[:, 2] = np.bincount(of_word, same, n) / words
        other[:, 3] = np.bincount(of_word, np.minimum(lengths, 64), n) / words / 10
        final = _KIND[data[ends - 1]]
        other[:, 4] = np.bincount(of_word, final == 6, n) / words
        other[:, 5] = np.bincount(of_word, _KIND[data[starts]] == 6, n) / words
    vectors = np.concatenate([kinds / size, other, np.sqrt(triples / size)], axis=1)
    vectors[number.repeat(counts) == 0] = 0
    return vectors, np.repeat(np.arange(len(texts)), counts)


def bags(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, vectors, text of each vector) in runs of about `STRETCH` bytes.

    A text that is longer comes alone and in several runs.
    """
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > STRETCH:
            yield first, len(held), *passages(held)
            held, size = [], 0
        if not held:
            first = i
        if len(text) > STRETCH:
            for part in stretches(text, STRETCH):
                yield i, 1, *passages([part])
            continue
        held.append(text)
        size += len(text)
    if held:
        yield first, len(held), *passages(held)


class Model:
    """The weights; `p` holds them by name."""

    SHAPES = {
        "encode": (WIDTH, ENCODED), "shift": (ENCODED,), "tanh": (ENCODED, GATE), "gate": (ENCODED, GATE),
        "weigh": (GATE,), "score": (ENCODED,), "bias": (),
    }

    def __init__(self, p: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.p, self.mean, self.spread = p, mean, spread

    @classmethod
    def fresh(cls, vectors: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        p = {k: rng.normal(0, 1 / np.sqrt(shape[0] if shape else 1), shape) for k, shape in cls.SHAPES.items()}
        p["shift"], p["bias"] = np.zeros(ENCODED), np.zeros(())
        return cls(p, vectors.mean(axis=0), vectors.std(axis=0) + 0.02)

    def encoded(self, vectors: np.ndarray) -> np.ndarray:
        """Encoded passages and, in the last column, what attention makes of each."""
        h = np.tanh((vectors - self.mean) / self.spread @ self.p["encode"] + self.p["shift"])
        gated = np.tanh(h @ self.p["tanh"]) / (1 + np.exp(-(h @ self.p["gate"])))
        return np.column_stack([h, gated @ self.p["weigh"]])

    def scores(self, encoded: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One score per document, whose passages begin at `starts`."""
        h, e = encoded[:, :-1], encoded[:, -1]
        counts = np.diff(np.append(starts, len(e)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return 1 / (1 + np.exp(-(z @ self.p["score"] + self.p["bias"])))

    def gradients(self, vectors: np.ndarray, starts: np.ndarray, labels: np.ndarray):
        """Mean log loss of the documents, and its gradient by every weight."""
        p = self.p
        counts = np.diff(np.append(starts, len(vectors)))
        x = (vectors - self.mean) / self.spread
        h = np.tanh(x @ p["encode"] + p["shift"])
        t, g = np.tanh(h @ p["tanh"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        e = (t * g) @ p["weigh"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a /= np.repeat(np.add.reduceat(a, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-(z @ p["score"] + p["bias"])))
        loss = -np.mean(labels * np.log(y + 1e-12) + (1 - labels) * np.log(1 - y + 1e-12))

        by_logit = (y - labels) / len(labels)
        by_z = np.repeat(by_logit[:, None] * p["score"], counts, axis=0)
        by_a = (by_z * h).sum(axis=1)
        by_e = a * (by_a - np.repeat(np.add.reduceat(a * by_a, starts), counts))
        by_t, by_g = (by_e[:, None] * p["weigh"] * other for other in (g, t))
        by_t, by_g = by_t * (1 - t * t), by_g * g * (1 - g)
        by_h = a[:, None] * by_z + by_t @ p["tanh"].T + by_g @ p["gate"].T
        by_h *= 1 - h * h
        return loss, {
            "encode": x.T @ by_h, "shift": by_h.sum(axis=0), "tanh": h.T @ by_t, "gate": h.T @ by_g,
            "weigh": (t * g).T @ by_e, "score": z.T @ by_logit, "bias": by_logit.sum(),
        }

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, mean=self.mean, spread=self.spread, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        found = dict(np.load(io.BytesIO(data)))
        return cls(found, found.pop("mean"), found.pop("spread"))


def fit(vectors: np.ndarray, starts: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """The model of some documents, whose passages begin at `starts`; the same input gives the same."""
    model = Model.fresh(vectors)
    rng = np.random.default_rng(SEED)
    ends = np.append(starts[1:], len(vectors))
    moments = {k: [np.zeros(shape), np.zeros(shape)] for k, shape in Model.SHAPES.items()}
    step, steps = 0, epochs * -(-len(labels) // TOGETHER)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), TOGETHER):
            part = order[low : low + TOGETHER]
            counts = ends[part] - starts[part]
            begin = np.cumsum(counts) - counts
            rows = np.repeat(starts[part] - begin, counts) + np.arange(counts.sum())
            _, gradients = model.gradients(vectors[rows].astype(np.float64), begin, labels[part])
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for name, gradient in gradients.items():
                first, second = moments[name]
                first += 0.1 * (gradient - first)
                second += 0.001 * (gradient * gradient - second)
                ahead = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                model.p[name] = model.p[name] * (1 - RATE * DECAY) - rate * ahead
    return model


def _bag_of(vectors: np.ndarray) -> np.ndarray:
    """At most `BAG` passages, evenly spaced from the first to the last."""
    if len(vectors) > BAG:
        vectors = vectors[np.linspace(0, len(vectors) - 1, BAG).round().astype(int)]
    return vectors.astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model of the labelled documents (doc_id, text); none without a label.

    `labels` has `doc_id` and a column `label` of 0 and 1. Labels are thinned before the join, so
    that texts are not shuffled, whatever the number of labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    # Twice the sample by a hash of the ids before texts are looked at, then exactly the first rows.
    share = min(1.0, 2 * sample / max(known.count(), 1))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("__label"))
    some = small_side(some, "quality-labels", 4 * sample)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(some, "doc_id")
    texts = texts.select(F.xxhash64("doc_id", "text").alias("key"), "__label", "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for first, n, vectors, text in bags(batch.column("text").to_pylist()):
                parts = np.split(vectors, np.searchsorted(text, np.arange(1, n)))
                for i, part in enumerate(parts, first):
                    found[i].append(part)
            own = [_bag_of(np.concatenate(x)).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("__label"), pa.array(own, pa.binary())], ["key", "label", "bag"]
            )

    chosen = texts.mapInArrow(described, "key long, label double, bag binary")
    chosen = chosen.orderBy("key", "label").limit(sample).coalesce(1)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, marks = [], []
        for batch in batches:
            own += [np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH) for x in batch.column("bag")]
            marks += batch.column("label").to_pylist()
        if own:
            sizes = np.array(list(map(len, own)))
            model = fit(np.concatenate(own), np.cumsum(sizes) - sizes, np.array(marks))
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()])], ["model"])

    rows = chosen.mapInArrow(fitted, "model binary").collect()
    return Model.load(bytes(rows[0][0])) if rows else None


def score_texts(texts: list[bytes | None], model: Model) -> np.ndarray:
    """The score of every text."""
    parts: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for first, _, vectors, text in bags(texts):
        parts.append(model.encoded(vectors))
        owners.append(text + first)
    if not parts:
        return np.zeros(0)
    starts = np.searchsorted(np.concatenate(owners), np.arange(len(texts)))
    return model.scores(np.concatenate(parts), starts).round(6)


def quality_of(text: Column, model: Model | None) -> Column:
    """The score of a string column, 0 to 1, the higher the better."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(score_texts(list(part), model))

    return scored.asNondeterministic()(text.cast("binary"))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with `score`, and `predicted`: 1 where it reaches the threshold."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    found = docs.withColumn("__score", quality_of(F.col("text"), model))
    return found.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )
