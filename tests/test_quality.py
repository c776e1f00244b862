import pytest

from shelfmark.operators import quality as Q

BOOKS = (
    "product_id bigint, name string, price double, list_price double, discount_pct double, "
    "rating_average double, review_count bigint, has_reviews boolean"
)
GOOD = [
    (1, "a", 5.0, 10.0, 50.0, 4.5, 10, True),
    (2, "b", 0.0, None, 0.0, 0.0, 0, False),
    (3, "c", 5.0, 5.0, 0.0, 3.0, None, False),
]
BAD = [
    (11, "  ", -1.0, 10.0, 110.0, 4.0, 1, True),
    (12, "n", None, 10.0, None, None, 1, True),
    (13, "n", 12.0, 10.0, -20.0, 5.5, 3, True),
    (14, "n", 1.0, 1.0, 0.0, 0.5, 2, False),
    (15, "n", 1.0, 1.0, 0.0, 3.0, 0, True),
    (16, "n", 1.0, 1.0, 0.0, 3.0, None, True),
    (17, None, 1.0, 1.0, 0.0, 9.0, 0, False),
    (17, "n", 1.0, 1.0, 0.0, 3.0, 2, True),
]
REVIEWS = "review_id bigint, product_id bigint, rating bigint, title string, reviewer_name string"


@pytest.fixture(scope="module")
def good(spark):
    return spark.createDataFrame(GOOD, BOOKS).cache()


@pytest.fixture(scope="module")
def bad(spark):
    return spark.createDataFrame(GOOD + BAD, BOOKS).cache()


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        (1, 1, 5, "t", "n"),
        (1, 1, 4, "  ", "n"),
        (2, None, 0, "t", ""),
        (3, 99, None, None, "\t"),
        (4, 14, 6, "t", " "),
        (5, 14, 1, "t", None),
        (6, 14, 1, "t", "n"),
    ]
    return spark.createDataFrame(rows, REVIEWS).cache()


def ids(df, col="product_id"):
    return sorted(r[col] for r in df.collect())


RULES = {
    Q.dq_price_positive: [11],
    Q.dq_discount_range: [11, 13],
    Q.dq_has_reviews_consistent: [14, 15, 16],
    Q.dq_list_price_gte_price: [13],
    Q.dq_rating_range: [13, 14],
}


@pytest.mark.parametrize("rule", RULES)
def test_rules_on_books(good, bad, rule):
    assert ids(rule(bad)) == RULES[rule]
    assert ids(rule(good)) == []


def test_not_null(bad):
    assert ids(Q.dq_not_null(bad, "price")) == [12]


def test_unique_ignores_null(reviews):
    assert [tuple(r) for r in Q.dq_unique(reviews, "review_id").collect()] == [(1, 2)]
    found = Q.dq_unique(reviews, "product_id", "rating").collect()
    assert [tuple(r) for r in found] == [(14, 1, 2)]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_unique_by_digest_gives_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "MAX_BROADCAST_DIGESTS", limit)
    texts = [(f"text {i % 37}" if i % 3 else None, i % 2) for i in range(200)]
    df = spark.createDataFrame(texts, "text string, n int")
    for cols in (["text"], ["text", "n"]):
        narrow = sorted(map(tuple, Q.dq_unique(df, *cols).collect()))
        assert sorted(map(tuple, Q.dq_unique(df, *cols, wide=True).collect())) == narrow
        assert narrow


def test_columns_read_suffice(spark, good, reviews):
    """The report runs on just the columns a suite names."""
    books = good.select(*Q.columns_read("books"))
    assert Q.dq_report({"books": books, "reviews": reviews}).count() == 25


def test_accepted_values_let_null_pass(reviews):
    found = Q.dq_accepted_values(reviews, "rating", [1, 2, 3, 4, 5])
    assert ids(found, "review_id") == [2, 4]


def test_relationships_let_null_pass_and_orphans_do_not(reviews, bad):
    assert ids(Q.dq_relationships(reviews, "product_id", bad, "product_id"), "review_id") == [3]
    assert ids(Q.dq_review_orphans(reviews, bad), "review_id") == [2, 3]


def test_not_null_when(spark):
    df = spark.createDataFrame(
        [(None, True), (None, False), (None, None), (1, True)], "x int, flag boolean"
    )
    for value in ("true", True):
        assert Q.dq_not_null_when(df, "x", "flag", value).count() == 1
    assert Q.dq_not_null_when(df, "x", "flag", "true").columns == ["x", "flag"]


def test_not_empty_string_trims_blanks_only(reviews):
    assert ids(Q.dq_not_empty_string(reviews, "reviewer_name"), "review_id") == [2]
    assert ids(Q.dq_not_empty_string(reviews, "title"), "review_id") == [1]


def test_review_count(reviews, bad):
    found = [tuple(r) for r in Q.dq_review_count(bad, reviews).collect()]
    assert found == [(14, "n", 2, 3)]


def test_report(spark, bad, reviews):
    report = {(r["table"], r["rule"]): r for r in Q.dq_report({"books": bad, "reviews": reviews}).collect()}
    expected = {
        ("books", "not_null(product_id)"): 0,
        ("books", "not_null(price)"): 1,
        ("books", "not_null(name)"): 1,
        ("books", "not_null(rating_average)"): 1,
        ("books", "not_null(discount_pct)"): 1,
        ("books", "not_null(has_reviews)"): 0,
        ("books", "not_null_when(rating_average, has_reviews)"): 1,
        ("books", "accepted_values(has_reviews)"): 0,
        ("books", "not_empty_string(name)"): 1,
        ("books", "price_positive"): 1,
        ("books", "discount_range"): 2,
        ("books", "has_reviews_consistent"): 3,
        ("books", "list_price_gte_price"): 1,
        ("books", "rating_range"): 2,
        ("books", "unique(product_id)"): 1,
        # product 17 occurs twice among the books and has no review
        ("books", "review_count_matches_actual"): 1,
        ("reviews", "not_null(review_id)"): 0,
        ("reviews", "not_null(product_id)"): 1,
        ("reviews", "not_null(rating)"): 1,
        ("reviews", "accepted_values(rating)"): 2,
        ("reviews", "not_empty_string(reviewer_name)"): 1,
        ("reviews", "not_empty_string(title)"): 1,
        ("reviews", "unique(review_id)"): 1,
        ("reviews", "relationships(product_id)"): 1,
        ("reviews", "reviews_have_valid_product"): 2,
    }
    assert {key: row["violations"] for key, row in report.items()} == expected
    assert all(row["passed"] == (row["violations"] == 0) for row in report.values())
    with pytest.raises(ValueError):
        Q.dq_report({"other": bad})


def test_row_rules_of_a_table_share_one_scan(spark, tmp_path, good):
    path = str(tmp_path / "books")
    good.write.parquet(path)
    books = spark.read.parquet(path)
    rows_only = [s for s in Q.SUITES if s.table == "books"][0]
    suite = Q.Suite("books", rows_only.columns, rows=rows_only.rows)
    plan = Q.dq_report({"books": books}, [suite])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_unique_rules_share_one_shuffle(spark, good):
    """All unique rules of all tables are one aggregation by (rule, value)."""
    report = Q.dq_report({"stg_listing": good, "stg_detail": good, "books": good.union(good)})
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("hashpartitioning(at") == 1
    found = {(r["table"], r["rule"]): r["violations"] for r in report.collect()}
    assert found["books", "unique(product_id)"] == 3
    assert found["stg_listing", "unique(product_id)"] == found["stg_detail", "unique(product_id)"] == 0
