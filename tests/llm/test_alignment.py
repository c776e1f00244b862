"""Aligned tokens against a brute-force version that walks both token lists byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfmark.llm import alignment
from shelfmark.llm.packing import vocabulary

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(vocabulary(alignment.FIRST), vocabulary(alignment.SECOND))


def brute_groups(pair, text):
    if not text:
        return []
    first = pair.first.encode(" " + text, add_special_tokens=False).ids
    second = pair.second.encode(text)
    kinds = [[pair.first_bytes[i] for i in first], [pair.second_bytes[i] for i in second]]
    if any(b"".join(k) != b" " + text.encode() for k in kinds):
        return []
    ends = [list(np.cumsum(list(map(len, k)))) for k in kinds]
    out, at = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for kind, ids in enumerate((first, second)):
            stop = ends[kind].index(end, at[kind]) + 1
            group.append(ids[at[kind] : stop])
            at[kind] = stop
        out.append(group)
    return out


def brute(pair, texts):
    """The result columns of every text."""
    aligned = [brute_groups(pair, t) for t in texts]
    links = [[(a, b) for x, y in groups for a in x for b in y] for groups in aligned]
    count = Counter(p for document in links for p in set(document))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for groups, own in zip(aligned, links, strict=True):
        written = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own),
            sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return out


ODD = [
    None, "", " ", "  a", "a  b   c", "\t\n", "x▁y", "<|endoftext|> and </s><unk><0x41>", "é́ ﬁ 　x",
    "中日 \U0001f600\U0001f600 é\x85\xa0x\x00y", "don't we'll 12345 67.8", "\r\n" * 40, " " * 500, "aaaa" * 300, "�",
    "a b c " * 50, "the the the", "the the the",
]


def test_texts_against_brute_force(pair, odd_rows):
    texts = ODD + [t for _, t, *_ in odd_rows]
    found = alignment.align_texts([None if t is None else t.encode() for t in texts], pair, keep_groups=True)
    for text, aligned, expected in zip(texts, found, brute(pair, texts), strict=True):
        assert (*aligned.counts,) == expected[:4], text
        assert (aligned.digest.hexdigest() if aligned.counts[0] else "") == expected[6], text
        written = ";".join("|".join(",".join(map(str, x)) for x in g) for g in brute_groups(pair, text))
        assert b"".join(aligned.text).decode() == written


def test_cut_texts_give_the_same(pair, odd_rows, monkeypatch):
    """Whatever the size of stretches, runs and blocks of links."""
    rng = random.Random(1)
    texts = [t.encode() for _, t, *_ in odd_rows if t] + [t.encode() for t in ODD if t]
    texts.append("".join(rng.choices(["word", " ", "é", "1", ".", "\n", "x y", "中"], k=5000)).encode())
    whole = alignment.align_texts(texts, pair)
    monkeypatch.setattr(alignment, "STRETCH", 40)
    monkeypatch.setattr(alignment, "TOKENS", 200)
    monkeypatch.setattr(alignment, "LINKS", 30)
    for a, b in zip(whole, alignment.align_texts(texts, pair), strict=True):
        assert a.digest.digest() == b.digest.digest() and (a.counts == b.counts).all()
        for x, y in zip(a.linked(), b.linked(), strict=True):
            assert np.array_equal(x, y)


def test_bytes_that_are_no_text(pair):
    (aligned,) = alignment.align_texts([b"ab \xff\xfe cd"], pair)
    assert not aligned.counts.any()


def test_groups_where_intervals_overlap():
    starts, ends = np.array([0, 3, 5, 9, 0, 5, 7]), np.array([3, 5, 9, 12, 5, 7, 12])
    kinds = np.array([0, 0, 0, 0, 1, 1, 1])
    assert alignment.groups_of(starts, ends, kinds).tolist() == [0, 0, 1, 1, 0, 1, 1]


def test_table_against_brute_force(spark, pair, odd, odd_rows):
    extra = [(100 + i, t, "en", "a") for i, t in enumerate(ODD)]
    more = spark.createDataFrame([(*r, 1, "k", 1, "r", "c", "d", "b", 2, "s") for r in extra], odd.schema)
    docs = odd.unionByName(more).withColumnRenamed("bitmap", "n_best")
    found = alignment.align(docs, keep_groups=True)
    assert found.columns.count("n_best") == 1 and "groups" in found.columns
    rows = odd_rows + extra
    expected = [(i, s, *e) for (i, _, _, s), e in zip(rows, brute(pair, [t for _, t, *_ in rows]), strict=True)]
    got = [tuple(r) for r in found.select("doc_id", "source", *COLUMNS).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[:1] + r[2:]) + (str(r[1]),)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sum(r[2:] == NONE for r in got) >= 5


def test_chunks_share_their_counts(spark, pair):
    """Many partitions, so many chunks: counts are those of the whole corpus."""
    texts = [f"the document number {i % 7} of them all" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(13)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(docs).select("doc_id", *COLUMNS).collect()}
    assert got == dict(enumerate(brute(pair, texts)))


def test_empty_tables(spark, none):
    assert alignment.align(none).count() == 0
    blank = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert [tuple(r[1:]) for r in alignment.align(blank).select("doc_id", *COLUMNS).collect()] == [NONE, NONE]
