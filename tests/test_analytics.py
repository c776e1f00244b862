import random
import statistics

import pytest

from shelfmark.operators import analytics as A
from shelfmark.operators import median
from shelfmark.operators.median import group_medians

BOOKS = (
    "product_id bigint, name string, spec_publisher_vn string, price double, discount_pct double, "
    "rating_average double, review_count bigint, quantity_sold bigint, has_reviews boolean"
)


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        (1, "Alpha", "P", 10.0, 0.0, 4.0, 10, 5, True),
        (2, "beta", "P", 20.0, 10.0, 5.0, 20, 7, True),
        (3, "Alphabet", "Q", 30.0, 10.5, 3.0, 0, None, False),
        (4, "delta", "Q", 30.0, 50.0, None, None, 1, False),
        (5, "ALPHA two", None, None, None, 4.5, 1, 2, True),
        (6, "zeta", "P", 30.0, 51.0, 1.0, 5, 3, True),
        (7, "eta", "P", 5.0, -3.0, 4.9, 15, 3, True),
    ]
    return spark.createDataFrame(rows, BOOKS).cache()


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_overview(spark, books):
    reviews = spark.range(4)
    kpi = A.kpi_cards(books, reviews).first().asDict()
    assert (kpi["books"], kpi["reviews"]) == (7, 4)
    assert kpi["avg_price"] == round(125 / 6, 6) and kpi["share_with_reviews"] == round(5 / 7, 6)
    assert table(A.price_distribution(books, 10)) == [(0.0, 1), (10.0, 1), (20.0, 1), (30.0, 3)]
    assert table(A.rating_breakdown(books)) == [(1, 1), (3, 1), (4, 3), (5, 1)]
    assert [tuple(r) for r in A.top_publishers(books, 1).collect()] == [("P", 4, 16.25)]
    assert len(table(A.discount_vs_rating(books))) == 5
    pairs = A.correlation(books, "price", "rating_average").first()
    assert pairs["pairs"] == 5 and -1 <= pairs["corr"] <= 1


def test_explorer(books):
    def found(**options):
        return [r["product_id"] for r in A.explore_books(books, **options).collect()]

    assert found(title="ALPHA", sort="price") == [1, 3, 5]
    assert found(title="ALPHA", sort="price", ascending=False) == [3, 1, 5]
    assert found(publishers=["Q"], sort="price") == [3, 4]
    assert found(price=(10.0, 20.0), sort="price") == [1, 2]
    assert found(rating=(4.5, 5.0), tiers=["none", "0-10"], sort="rating_average") == [7, 2]
    assert sorted(found()) == [1, 2, 3, 4, 5, 6, 7]


def test_tiers(books):
    tiers = {r["tier"]: r["books"] for r in A.discount_tiers(books).collect()}
    assert tiers == {"none": 2, "0-10": 1, "10-20": 1, "30-50": 1, "over 50": 1}
    by = {r["spec_publisher_vn"]: r["avg_discount_pct"] for r in A.discount_by_publisher(books).collect()}
    assert by == {"P": 14.5, "Q": 30.25}


def test_by_price(books):
    rated = {r["price_from"]: r["avg_rating"] for r in A.price_vs_rating(books, 10).collect()}
    assert rated == {0.0: 4.9, 10.0: 4.0, 20.0: 5.0, 30.0: 2.0}
    sold = {r["price_from"]: r["avg_quantity_sold"] for r in A.price_vs_sales(books, 10).collect()}
    assert sold == {0.0: 3.0, 10.0: 5.0, 20.0: 7.0, 30.0: 2.0}


def test_reviews(spark):
    rows = [
        (1, 1, "b", 5, "t", 3, True),
        (2, 1, "b", 5, "t", 9, False),
        (3, 1, "b", 1, "t", 9, True),
        (4, 1, "b", None, "t", None, None),
        (5, 1, "b", 7, "t", 0, True),
    ]
    reviews = spark.createDataFrame(
        rows,
        "review_id bigint, product_id bigint, product_name string, rating bigint, title string, "
        "thank_count bigint, reviewer_purchased boolean",
    )
    assert table(A.reviews_by_star(reviews)) == [(1, 1, 0.333333), (5, 2, 0.666667)]
    assert [r["review_id"] for r in A.most_helpful(reviews, 3).collect()] == [2, 3, 1]
    assert table(A.verified_split(reviews)) == [
        (False, 1, 5.0, 9.0),
        (None, 1, None, None),
        (True, 3, round(13 / 3, 6), 4.0),
    ]


def test_underpriced(books):
    # Publisher P: median price 15, rating 4.45, reviews 12.5.
    assert [r["product_id"] for r in A.underpriced_books(books).collect()] == [7]


FORCED = {
    "usual": {},
    "shuffled": {"MAX_BROADCAST_GROUPS": 0},
    # Brackets that lie beside the middle, and above or below it only.
    "missed": {"MARGIN": -0.2, "SMALL_MARGIN": -0.2},
    "beside": {"SMALL_GROUP": 0, "MARGIN": -0.3, "SMALL_MARGIN": 0.4},
    # Every range is too long to be ranked; a poor sketch puts the cuts anywhere.
    "narrowed": {"MAX_RANKED": 3, "CUTS": 20},
    "poor": {"MAX_RANKED": 50, "CUTS": 4, "ACCURACY": 5, "MARGIN": -0.1, "SMALL_MARGIN": -0.1},
}


@pytest.mark.parametrize("forced", FORCED)
def test_medians_against_brute_force(spark, monkeypatch, forced):
    """Small, large, constant, lopsided and heavily repeated groups; one holds most rows."""
    for name, value in FORCED[forced].items():
        monkeypatch.setattr(median, name, value)
    rng = random.Random(3)
    groups = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "three": [3.0, 1.0, 2.0],
        "constant": [7.0] * 1000,
        "half": [0.0] * 500 + [1.0] * 500,
        "nulls": [None, None, 5.0, 6.0],
        "hot": [rng.lognormvariate(3, 2) for _ in range(60_001)],
        "repeated": [float(rng.randint(0, 5)) for _ in range(20_000)],
        "sorted": [float(i) for i in range(15_000)],
        "lopsided": [0.0] * 9_000 + [float(i) for i in range(9_001)],
        "even": [rng.random() for _ in range(10_000)],
    }
    rows = [(g, v, float(i)) for g, values in groups.items() for i, v in enumerate(values)]
    rows += [("empty", None, None), (None, 1.0, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(7)
    found = {r["g"]: (r["median_a"], r["median_b"]) for r in group_medians(df, "g", ["a", "b"]).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        assert found[g] == (statistics.median(known), (len(values) - 1) / 2), g
