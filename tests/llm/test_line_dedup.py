import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import line_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    """(doc_id, n_lines, n_dropped, text) of every row."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            found[key(line)].add(i)
    common = {
        k: max((x for x in ids if x is not None), default=None)
        for k, ids in found.items()
        if len(k) >= 40 and len(ids) >= 5
    }
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common or common[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got(df):
    return [tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()]


def test_odd_rows(odd, odd_rows):
    assert Counter(got(line_dedup.drop_repeated_lines(odd))) == Counter(brute(odd_rows))


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_a_hot_line_spans_ranges(spark, partitions):
    hot = "the same line of forty letters or more in all"
    rows = [(i, f"{hot}\nown line {i} that nobody else has, not even one\n{hot}\n{'x' * (40 + i % 9)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert Counter(got(line_dedup.drop_repeated_lines(df))) == Counter(brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_bitmaps():
    for dropped, n in (([0], 1), ([7], 30), ([8, 1], 9), ([100, 3], 101)):
        keep = line_dedup.unpack(line_dedup.pack(dropped), n)
        assert [i for i in range(n) if not keep[i]] == sorted(dropped)
    assert line_dedup.unpack(None, 3).all()


def test_clean_keeps_columns(odd, none):
    cleaned = line_dedup.clean(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    wrong = cleaned.where("text IS NOT NULL AND n_chars <> length(text)")
    assert wrong.count() == 0
    assert line_dedup.clean(none).count() == 0


def test_digest(odd, odd_rows):
    kept = line_dedup.drop_repeated_lines(odd)
    found = {r[0] for r in kept.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()}
    assert found == {hashlib.sha256(x[3].encode()).hexdigest() for x in brute(odd_rows)}
