import random
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import common, jaccard
from conftest import SMALL


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute(rows):
    """(doc_id, size of the set, smallest doc_id of the group) of every row."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 4 * both >= 3 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(rows[i][0], len(sets[i]), least.get(find(i))) for i in range(len(rows))]


def check(spark, rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(5)
    found = Counter(map(tuple, jaccard.report(df).collect()))
    assert found == Counter(brute(rows))
    return df


def changed(words, n, rng):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.choice((0, 1, 1))] = [f"new{rng.random()}"] * rng.choice((0, 1, 1))
    return words


@pytest.fixture(scope="module")
def rows():
    """Near copies around the limit, chains of them, shared passages, and one hot passage."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    hot = [word() for _ in range(40)]
    texts = []
    for group in range(25):
        base = [word() for _ in range(rng.choice((6, 30, 90, 200)))]
        texts.append(base)
        for _ in range(rng.randrange(7)):
            base = changed(base, rng.randrange(1, max(2, len(base) // 25)), rng)
            texts.append(base)
    texts += [hot + [word() for _ in range(rng.randrange(1, 14))] for _ in range(70)]
    texts += [[word() for _ in range(rng.randrange(1, 8))] for _ in range(20)]
    texts += [texts[0]] * 9
    rng.shuffle(texts)
    return [(i * 7 % 1009, rng.choice((" ", "\n", "\t ")).join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("small", [False, True])
def test_groups(spark, rows, monkeypatch, small):
    if small:
        # Every list is cut into blocks, and frequent shingles into stripes.
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        monkeypatch.setattr(jaccard, "STRIPE", 5)
        monkeypatch.setattr(jaccard, "BUFFER", 500)
    check(spark, rows)


def test_the_index_alone_finds_all(spark, rows, monkeypatch):
    """Without the first round nothing is taken over from similar sets."""
    monkeypatch.setattr(jaccard, "TRIES", ())
    monkeypatch.setattr(jaccard, "STRIPE", 30)
    check(spark, rows[:150])


def test_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, jaccard.report(df).collect())) == Counter(brute([tuple(r) for r in df.collect()]))


def test_exactly_the_limit(spark):
    one = [f"a{i}" for i in range(11)]  # 7 shingles
    rows = [(1, " ".join(one)), (2, " ".join(one[:10])), (3, " ".join(one[:9])), (4, " ".join(one[1:]))]
    check(spark, rows)  # 6/7 and 5/7, 5/6 and 5/7


def test_odd_rows(spark, odd, odd_rows, none):
    wanted = brute(odd_rows)
    # Rows without words stand alone; rows of one id are documents of their own.
    assert Counter(map(tuple, jaccard.report(odd).collect())) == Counter(wanted)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    groups = {g for (d, n, g) in wanted if n}
    rows = kept.select("doc_id", "text").collect()
    words = [r for r in rows if shingles(r["text"])]
    assert len(rows) - len(words) == sum(n == 0 for _, n, _ in wanted)
    ids = Counter(r["doc_id"] for r in words)
    assert set(ids) == groups and len(words) == len(groups) + 1  # id 51 heads two groups
    assert jaccard.report(none).collect() == [] and jaccard.keep_one(none).collect() == []


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    ruled_out = 0
    for _ in range(400):
        n, common = int(rng.integers(1, 400)), rng.random()
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        kept = a[rng.random(len(a)) < common]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, int(n * rng.random() * 0.4), dtype=np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        link = 4 * both >= 3 * (len(a) + len(b) - both)
        assert jaccard.linked(a.tobytes(), b.tobytes(), len(a), len(b)) == link
        may = jaccard.may_link(jaccard.parity(a), jaccard.parity(b), len(a), len(b))
        assert may or not link
        ruled_out += not may
    assert ruled_out > 150


def test_shingles_are_sets_of_five():
    known = common.WordHashes()
    for text in ("", "a", "a b c d", "a b c d e", "x " * 50, "A b\x0bC d e f a b c d e f"):
        assert len(jaccard.shingles(known.of(text.encode()))) == len(shingles(text))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 400)]  # a sorted chain
    edges += [(1000, 1000 + i) for i in range(1, 300)]  # a hub
    edges += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in common.components(df, "test").collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(found) == linked
    for a in linked:
        assert find(found[a]) == find(a)
    assert len(set(found.values())) == len({find(x) for x in linked})
    none = common.components(df.where("a < 0"), "test")
    assert none.columns == ["node", "root"] and none.count() == 0


def test_stretches():
    text = b"ab cd\nefgh  ij"
    parts = list(common.stretches(text, 3))
    assert b"".join(parts) == text and len(parts) > 2
    assert [w for p in parts for w in p.split()] == text.split()
    known = common.WordHashes()
    assert (known.of(text) == np.concatenate([known.of(p) for p in parts])).all()


def test_hashes_tell_words_apart_as_splitting_does():
    rng = random.Random(3)
    letters = "aAbBzZ09.é\x00\x85\xa0"
    texts = ["", " ", "a", " a\tA\x0b\x0c\r\n a", "x" * 8 + " " + "x" * 9 + " " + "x" * 8 + "\0", "é" * 700 + " " + "é" * 699]
    texts += [" ".join("".join(rng.choices(letters, k=rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 300]))) for _ in range(200)) for _ in range(20)]
    seen = {}
    for text in texts:
        words = text.encode().lower().split()
        found = common.word_hashes(text.encode())
        assert found.dtype == np.uint64 and len(found) == len(words)
        for word, h in zip(words, found.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(common.word_hashes(None)) == 0


def test_hashing_does_not_go_word_by_word(monkeypatch):
    """100,000 distinct words: one call of the hash library for each would be too many."""
    calls = []
    whole = common.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(common.xxhash, "xxh3_64_intdigest", lambda w: calls.append(1) or whole(w))
    text = " ".join(f"word{i}" for i in range(100_000)).encode()
    assert len(jaccard.shingles(common.word_hashes(text))) == 99_996
    assert not calls
