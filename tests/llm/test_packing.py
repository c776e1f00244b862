import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import common, packing
from conftest import SMALL


def spread(runs):
    bins, placed = {}, Counter()
    for run in runs:
        for i in range(run.count):
            at = run.offset + i % run.each * run.length
            bins.setdefault(run.sequence + i // run.each, []).append((at, run.length))
            placed[run.length] += 1
    return bins, placed


def best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 12)))))
def test_runs_are_a_good_packing(case):
    capacity, histogram = case
    bins, placed = spread(packing.plan_runs(histogram, capacity))
    assert placed == Counter({n: c for n, c in histogram.items() if c})
    for pieces in bins.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= capacity
        assert sum(3 * n > capacity for _, n in pieces) <= 2
    lengths = [n for n, c in histogram.items() for _ in range(c)]
    assert len(bins) <= best_fit(lengths, capacity) + 1


def test_runs_do_not_grow_with_the_counts():
    histogram = {n: n * 7919 % 1000 for n in range(1, 4097)}
    few = len(packing.plan_runs(histogram))
    many = len(packing.plan_runs({n: c * 1_000_000 for n, c in histogram.items()}))
    assert many < 3 * few < 60_000


ODD_LETTERS = "aAzZéÉßİKÅñ'’s t.,!?$|<>09²½ª\u0301 \x1c\x85\x00ǅ\t\n"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


def test_ids_by_word_are_ids_of_the_text(tokenizer):
    words = packing.WordIds(packing.vocabulary())

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(max_size=40), st.text(ODD_LETTERS, max_size=20)))
    def same(text):
        data = text.encode("utf-8", "replace")
        ids = np.frombuffer(words.of([data])[0], "<u4").tolist()
        assert ids == tokenizer.encode(data.decode(), add_special_tokens=False).ids

    same()


def check(rows, texts, tokenizer, capacity=4096):
    """Every piece of every text once, ids right, sequences gapless."""
    wanted = Counter()
    for i, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            wanted[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_odd_rows(odd, odd_rows, none, tokenizer):
    rows = packing.pack(odd, packing.vocabulary(), keep_ids=True).collect()
    n = check(rows, [(i, t) for i, t, *_ in odd_rows], tokenizer)
    assert n <= best_fit([r["length"] for r in rows], 4096) + 1
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(none, packing.vocabulary()).collect() == []


def test_exactly_full(spark, tokenizer):
    texts = [(n, " ".join(["a"] * n)) for n in (4094, 4095, 4096, 8191, 8192)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check(packing.pack(df, packing.vocabulary()).collect(), texts, tokenizer)


def test_stretches_of_a_long_text(spark, tokenizer, monkeypatch):
    words = packing.WordIds(packing.vocabulary())
    text = ("some words, in a row\n" * 3000).encode()
    whole = b"".join(x for _, _, x in packing.pieces_of([text], words, 4096, 1))
    monkeypatch.setattr(packing, "stretches", lambda t: common.stretches(t, 100))
    assert b"".join(x for _, _, x in packing.pieces_of([text], words, 4096, 1)) == whole


@pytest.mark.parametrize("most", [packing.BROADCAST, 0])
def test_ids_are_not_shuffled_while_places_fit_a_broadcast(spark, monkeypatch, most):
    """Also where tables are too large for Spark to broadcast them by itself."""
    monkeypatch.setattr(packing, "BROADCAST", most)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(6)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = packing.pack(docs, packing.vocabulary(), keep_ids=True)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.select("sequence_id", "offset", "length").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert ("hashpartitioning" in plan) == (most == 0)
    ends = {}
    for sequence, offset, length in sorted(rows):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values()) <= 4096


def test_rows_that_are_placed_do_not_wait_for_python(spark):
    """A row waited there on disk with the map of its task, up to 64 KB that its rank was made from."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40)) for i in range(300)], "doc_id long, text string")
    found = packing.pack(docs, packing.vocabulary())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    ends = {}
    for row in sorted(found.collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert row.offset == ends.get(row.sequence_id, 0)
        ends[row.sequence_id] = row.offset + row.length
    assert len(found.columns) == 7 and all(n <= packing.CAPACITY for n in ends.values())
