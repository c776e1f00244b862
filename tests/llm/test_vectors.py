"""Nearest neighbours and near-duplicate vectors against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import neighbours, vector_dedup
from conftest import SMALL

NAN, INF = float("nan"), float("inf")
BAD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [NAN, 1.0, 0.0], [INF, 1.0, 0.0]]


@pytest.fixture(scope="module")
def table(spark):
    """Vectors of any length, near copies, copies, repeated ids, bad vectors, clashing columns."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=24) * rng.uniform(0.1, 5)) for i in range(300)]
    centre = rng.normal(size=24)
    rows += [(300 + i, centre + rng.normal(size=24) * 0.12) for i in range(60)]
    rows += [(400 + i, centre) for i in range(30)] + [(400, -centre), (401, rows[0][1])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows += [(500 + i, v) for i, v in enumerate(BAD)] + [(600, [3.0, 4.0]), (620, [6.0, 8.1]), (640, [1e300, 1e300])]
    rows += [(None, rows[5][1])]
    return spark.createDataFrame([(*r, 1, "x", 2, "d") for r in rows], "vec_id long, embedding array<double>, row int, class string, n int, dim string").repartition(4)


def valid(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v)


def test_neighbours(table, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    data = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    found = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [(k, i, v) for k, (i, v) in enumerate(data) if i is not None and i % 20 == 0 and valid(v)]
    hits = total = 0
    for k, i, v in queries:
        if sum(1 for _, x, _ in queries if x == i) > 1:
            continue  # two rows of one id answer under it
        others = [(float(np.sum(np.array(v) * np.array(w))), j) for m, (j, w) in enumerate(data) if m != k and valid(w) and len(w) == len(v)]
        best = sorted(others, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:20]
        rows = sorted(found.get(i, []), key=lambda r: r[0])
        assert [r for r, _, _ in rows] == list(range(1, len(best) + 1))
        scores = Counter(others)
        assert all((s, j) in scores for _, j, s in rows)
        hits += len(Counter(j for _, j in best) & Counter(j for _, j, _ in rows))
        total += len(best)
    assert hits >= 0.97 * total and total > 300


def test_neighbours_without_an_id(spark, monkeypatch):
    """A row without an id is a candidate like any other, beside one whose id is -1."""
    monkeypatch.setattr(neighbours, "LEAF", 2)
    rows = [(0, [1.0, 0.0]), (None, [2.0, 0.0]), (-1, [2.0, 0.0]), (7, [2.0, 0.0]), (None, [3.0, 0.0]), (None, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [
        (0, None, 3.0),
        (0, -1, 2.0),
        (0, 7, 2.0),
        (0, None, 2.0),
    ]


def test_neighbours_recall(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    data = df.orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in data])
    e = np.array([r["embedding"] for r in data], np.float64)
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = e @ e[i]
        score[i] = -np.inf
        hits += len(found[ids[i]] & set(ids[np.lexsort((ids, -score))[:20]]))
    assert len(found) == 25 and hits >= 0.95 * 20 * 25


def test_chi_square():
    assert neighbours.chi_square(0.95, 8) == pytest.approx(15.507, rel=0.01)
    assert neighbours.chi_square(0.5, 6) == pytest.approx(5.348, rel=0.01)


def brute_dedup(data):
    n = len(data)
    unit = [np.array(v) / max(map(abs, v)) if valid(v) else None for _, v in data]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = Counter()
    for i in range(n):
        ids = [data[j][0] for j in range(n) if find(j) == find(i) and data[j][0] is not None]
        own = min(ids, default=None)
        out[data[i][0], links[i], own, data[i][0] == own] += 1
    return out


@pytest.mark.parametrize("stripe", [4096, 20])
def test_dedup(table, monkeypatch, stripe):
    monkeypatch.setattr(vector_dedup, "STRIPE", stripe)
    data = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    rows = vector_dedup.dedup(table).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows) == brute_dedup(data)


def test_pairs_at_the_limit_are_found():
    rng = np.random.default_rng(4)
    for length, n in ((64, 50_000), (8, 2_000), (300, 1_000_000)):
        codes = [vector_dedup.code_for(length, n, number=i) for i in range(vector_dedup.CODES)]
        x = vector_dedup.units(rng.normal(size=(400, length)))
        w = rng.normal(size=x.shape)
        w = vector_dedup.units(w - (w * x).sum(axis=1, keepdims=True) * x)
        y = 0.9 * x + np.sqrt(1 - 0.81) * w
        missed = sum(not set(a) & set(b) for a, b in zip(vector_dedup.decode(x, codes), vector_dedup.decode(y, codes), strict=True))
        assert missed <= 4


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.dedup(none).collect() == []
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0, 20).collect() == []
    bad = spark.createDataFrame([(i, v) for i, v in enumerate(BAD)], "vec_id long, embedding array<float>")
    assert Counter(map(tuple, vector_dedup.dedup(bad).collect())) == Counter((i, 0, i, True) for i in range(len(BAD)))
    assert neighbours.nearest(bad, F.col("vec_id") % 20 == 0, 20).collect() == []
