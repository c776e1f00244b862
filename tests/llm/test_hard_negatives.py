"""Hard negatives against brute force, and Strassen's product against the plain one."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor string, score double"


def brute(rows, is_anchor, positives=5, negatives=10):
    """Rows of (anchor, positive, rank, negative, positive score, negative score)."""
    fine = []
    for number, (i, v, label, *_) in enumerate(rows):
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        fine.append((number, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda r: (-r[0], r[2] is None, r[2] or 0, r[1])
    out = []
    for number, i, v, label in fine:
        if i is None or not is_anchor(i):
            continue
        scored = [
            (sum(a * b for a, b in zip(v, w, strict=True)), n, j, other)
            for n, j, w, other in fine
            if n != number and len(w) == len(v)
        ]
        for p, _, positive, _ in sorted((r for r in scored if r[3] == label), key=order)[:positives]:
            inside = [r for r in scored if r[3] != label and 30 * p <= 100 * r[0] <= 90 * p]
            for rank, r in enumerate(sorted(inside, key=order)[:negatives], 1):
                out.append((i, positive, rank, r[2], p, r[0]))
    return out


def mined(spark, rows, modulus):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % modulus == 0, label).collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def odd_vectors(n=400, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.6, (6, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 6)) if i % 3 else 2  # a label with a third of all rows
        v = (centres[label] + rng.normal(0, 0.5, dim)).tolist()
        rows.append([i, v, label])
    for i in range(40, 52):
        rows[i][1] = rows[40][1]  # ties
    rows[60][1], rows[61][2], rows[62][1] = None, None, []
    rows[63][1] = [0.0] * dim
    rows[64][1] = [None, *rows[64][1][1:]]
    rows[65][1] = [float("nan"), *rows[65][1][1:]]
    rows[66][1] = [float("inf"), *rows[66][1][1:]]
    rows[67][1], rows[80][1], rows[81][1] = [0.5, 0.25], [0.25, 0.25], [0.5, 0.5]
    rows[70][0] = rows[71][0] = None
    rows += [list(rows[40]), list(rows[20]), [-40, rows[1][1], rows[1][2]]]
    return [(*r, "r", "a", 1.0) for r in rows]


@pytest.fixture(scope="module")
def vectors():
    return odd_vectors()


def test_against_brute_force(spark, vectors):
    expected = brute(vectors, lambda i: i % 20 == 0)
    assert len(expected) > 300
    assert sorted(mined(spark, vectors, 20), key=key) == sorted(expected, key=key)


def test_many_passes_give_the_same(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 9)
    expected = brute(vectors, lambda i: i % 20 == 0)
    assert sorted(mined(spark, vectors, 20), key=key) == sorted(expected, key=key)


def test_hot_copies_and_single_label(spark):
    """All rows equal: the smallest ids are the positives; without another label, no negatives."""
    rows = [(i, [0.5, -0.25], 1, "r", "a", 1.0) for i in range(1, 500) if i % 7]
    assert mined(spark, rows, 100) == []
    rows += [(i, [0.25, -0.25], 2, "r", "a", 1.0) for i in range(1001, 1400) if i % 7]
    found = mined(spark, rows, 100)
    assert sorted(found, key=key) == sorted(brute(rows, lambda i: i % 100 == 0), key=key)
    assert {r[3] for r in found if r[0] == 100} == {1002, 1003, 1004, 1005, 1006, 1007, 1009, 1010, 1011, 1012}


def test_empty_table(spark):
    assert mined(spark, [], 100) == []
    assert mined(spark, [(100, None, None, None, None, None)], 100) == []


def test_scores_beyond_64_bits_are_refused(spark):
    rows = [(100, [3e36, 1.0], 1, "r", "a", 1.0), (101, [1.0, 1.0], 1, "r", "a", 1.0)]
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, rows, 100)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 90), st.integers(0, 90), st.integers(0, 150), st.integers(0, 2**32 - 1))
def test_product(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-(2**26), 2**26, (m, k))
    b = rng.integers(-(2**26), 2**26, (k, n))
    assert np.array_equal(hard_negatives.product(a, b), a @ b)


def test_product_where_inner_sums_wrap():
    a = np.full((80, 80), 2**62)
    a[:, ::2] = -(2**62)
    assert np.array_equal(hard_negatives.product(a, np.ones((80, 80), np.int64)), np.zeros((80, 80)))


def test_no_candidate_is_shuffled(spark, vectors):
    """What is exchanged are heaps, not vectors."""
    df = spark.createDataFrame(vectors, SCHEMA)
    plan = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, F.col("label"))._jdf.queryExecution().toString()
    assert "embedding" not in plan and "CartesianProduct" not in plan
