"""Title search through the index finds what a scan finds, and reads little."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.operators import analytics, titles
from shelfmark.plans import jobs
from shelfmark.sources import tables

BOOKS = "product_id bigint, name string, spec_publisher_vn string, price double"


def stored(books):
    laid = tables.materialize(titles.laid_out(books), "laid", titles.PAGES)
    return laid, tables.materialize(titles.title_postings(laid), "postings")


def rows_read(found):
    """Rows that the scan gave, and the result, from the metrics of one run."""
    rows = found.collect()
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())), rows


@pytest.fixture(scope="module")
def many(spark):
    """200,000 books with titles of five words out of 2,000; a third are of one publisher."""
    words = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.lower(
        F.translate(F.hex(F.pmod(F.xxhash64("id", k), F.lit(2000)) * 7919 + 100_000), "0123456789", "ghijklmnop")
    ))
    books = spark.range(200_000).select(
        F.col("id").alias("product_id"),
        F.array_join(words, " ").alias("name"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("spec_publisher_vn"),
        (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10).alias("price"),
    )
    return stored(books)


def test_selective_search_reads_few_rows(many):
    laid, postings = many
    wanted = laid.where("product_id IN (12345, 99999)").select("name").collect()
    for (name,) in wanted:
        read, rows = rows_read(titles.with_title(laid, postings, name.upper()[3:]))
        scan = laid.where(F.contains("name", F.lit(name[3:]))).drop(titles.ROW, titles.LAYOUT).collect()
        assert sorted(rows) == sorted(scan) and rows
        assert read < 0.05 * 200_000


def test_publisher_and_price_skip_pages(many):
    laid, postings = many
    by_price = analytics.explore_books(laid, publishers=["hot"], price=(10.0, 20.0))
    read, rows = rows_read(by_price)
    assert rows and read < 0.05 * 200_000
    word = laid.where("product_id = 3").first()["name"].split()[0]
    both = analytics.explore_books(titles.with_title(laid, postings, word), publishers=["hot"], price=(10.0, 900.0))
    scan = analytics.explore_books(laid, publishers=["hot"], price=(10.0, 900.0), title=word)
    assert sorted(both.collect()) == sorted(scan.drop(titles.ROW, titles.LAYOUT).collect())


def test_every_text_finds_what_a_scan_finds(spark, monkeypatch):
    draw = random.Random(7)
    names = ["".join(draw.choice("abÀ ß😀") for _ in range(draw.randrange(0, 9))) for _ in range(900)]
    rows = [(i, n if i % 17 else None, draw.choice(["p", "q", None]), float(i % 7)) for i, n in enumerate(names)]
    rows += rows[:40] + [(5000, "İstanbul " * 300, None, None)]
    books = spark.createDataFrame(rows, BOOKS)
    laid, postings = stored(books)
    monkeypatch.setattr(titles, "RANGES", 2)
    for text in ["", "a", "ab", "aba", "ABA", "ààà", "b ß", "😀😀", "a😀b", "abababab", "xyz", "stanbul i", "À ß", "a" * 40]:
        found = titles.with_title(laid, postings, text)
        scan = analytics.explore_books(books, title=text)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, scan.collect())), text


def test_postings_of_another_layout_are_not_used(spark):
    books = spark.createDataFrame([(1, "one two", "p", 1.0), (2, "two three", "p", 2.0)], BOOKS)
    laid, _ = stored(books)
    _, old = stored(books.where("product_id = 1"))
    assert titles.candidate_ranges(laid, old, "three") is None
    assert [r["product_id"] for r in titles.with_title(laid, old, "three").collect()] == [2]
    none = stored(books.where("false"))
    assert titles.with_title(*none, "three").collect() == []


@given(st.sets(st.integers(0, 500), min_size=1), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_ranges_cover_their_blocks(blocks, most):
    ranges = titles.merged_ranges(sorted(blocks), 10, most)
    assert len(ranges) <= most and ranges == sorted(ranges)
    assert all(any(a <= b * 10 and b * 10 + 9 <= z for a, z in ranges) for b in blocks)
    if len(ranges) < most:
        assert sum((z - a + 1) // 10 for a, z in ranges) == len(blocks)


def test_long_texts_use_a_bounded_number_of_grams():
    assert titles.search_grams("ab") == [] and titles.search_grams("ABCD") == ["abc", "bcd"]
    many = titles.search_grams("abcdefghijklmnopqrstuvwxyz")
    assert len(many) == titles.GRAMS and many[0] == "abc" and many[-1] == "xyz"


def test_stored_explorer(spark, tmp_path):
    location = str(tmp_path)
    rows = [(i, f"Volume {i} of all", f"p{i % 3}", float(i)) for i in range(300)]
    books = spark.createDataFrame(rows, BOOKS)
    tables.write_table(titles.laid_out(books), jobs.EXPLORER, location, options=titles.PAGES)
    tables.write_table(titles.title_postings(spark.table(jobs.EXPLORER)), jobs.POSTINGS, location)
    found = jobs.explore(spark, title="VOLUME 29", price=(20.0, 295.0), sort="price")
    assert [r["product_id"] for r in found.collect()] == [29, *range(290, 296)]
    assert jobs.explore(spark, publishers=["p1"]).columns == books.columns
