import math
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import scoring
from shelfmark.llm.queries import op5_scoring
from conftest import SMALL


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def compare(rows, texts, train):
    """Base scores against counting in one place."""
    counts = Counter(t for text in train for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    wanted = Counter()
    for i, text in texts:
        t = tokens(text)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)
        wanted[i, len(t), sum(counts[x] > 0 for x in t), n, round(base, 6)] += 1
    found = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert found == wanted
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in rows)


@pytest.mark.parametrize("hot", [scoring.HOT, 300, 0])
def test_base_score(spark, monkeypatch, hot):
    monkeypatch.setattr(scoring.train, "__defaults__", (scoring.MAX_BYTES, hot))
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    rows = op5_scoring(spark, SMALL).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == held
    compare(rows, texts, [t for i, t in texts if i not in held])
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_counts_are_never_read_too_low(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    trained = scoring.train(docs)
    model = trained.shared.value
    rows = trained.counts.collect()
    true = np.array([r["count"] for r in rows])
    read = model.counts(np.array([r["token"] for r in rows], np.int64).view(np.uint64))
    floor = scoring._middle(scoring._level(true))
    assert (read >= floor).all() and np.mean(read > floor) < 0.05
    strange = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert np.mean(model.counts(strange) > 0) < 0.05


def test_levels():
    counts = np.arange(1, 2000)
    levels = scoring._level(counts)
    assert levels[0] == 1 and (np.diff(levels) >= 0).all()
    middle = scoring._middle(levels)
    assert (np.abs(middle / counts - 1) < 0.5).all() and middle[0] == 1
    assert scoring._middle(np.zeros(1, np.int64))[0] == 0


def test_odd_rows(spark, odd, odd_rows, none):
    texts = [(i, t) for i, t, *_ in odd_rows]
    compare(scoring.score(odd, scoring.train(odd)).collect(), texts, [t for _, t in texts])
    untrained = scoring.score(odd, scoring.train(none)).collect()
    compare(untrained, texts, [])
    assert {r["score"] for r in untrained} == {0}
    assert scoring.score(none, scoring.train(odd)).collect() == []


def same_rows(found, wanted):
    """Equal but for the order in which a text's logarithms were added up."""
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6))
    assert [key(r) for r in sorted(found, key=key)] == [key(r) for r in sorted(wanted, key=key)]


def test_a_filter_beyond_the_broadcast_gives_the_same_scores(spark, odd, none, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK", 1 << 16)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for rows in (docs, odd):
        train = rows.where("doc_id % 3 > 0")
        whole, parts = scoring.train(train), scoring.train(train, max_bytes=0)
        assert whole.parts is None and parts.parts is not None
        assert not len(parts.shared.value.bits)
        same_rows(scoring.score(rows, parts).collect(), scoring.score(rows, whole).collect())
    assert scoring.score(none, parts).collect() == []


def test_rate_of_false_ngrams_does_not_grow_with_the_corpus(spark):
    """The broadcast limit holds the smallest filter only; larger ones keep their bits a key."""
    strange = np.random.default_rng(2).integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    for n in (100, 1_000, 10_000):
        texts = [(" ".join(f"w{i}x{j}" for j in range(20)),) for i in range(n)]
        trained = scoring.train(spark.createDataFrame(texts, "text string"), max_bytes=1 << 13)
        if trained.parts is None:
            counts = trained.shared.value.counts(strange)
        else:
            rows = {r["segment"]: r["bits"] for r in trained.parts.collect()}
            segment = (strange >> np.uint64(64 - int(math.log2(trained.segments)))).astype(int)
            counts = np.zeros(len(strange))
            for s, bits in rows.items():
                keys = strange[segment == s]
                size = np.full(len(keys), np.uint64(8 * len(bits)))
                counts[segment == s] = scoring._read(np.frombuffer(bits, np.uint8), keys, size, size * np.uint64(0))
        assert (trained.parts is None) == (n == 100)
        assert np.mean(counts > 0) < 0.02, n
