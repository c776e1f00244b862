"""What the plans do at scale: filters and columns reach the scan, hot keys are split."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import analytics, history, models, quality
from shelfmark.operators.median import group_medians
from shelfmark.operators import median
from shelfmark.sources import snapshots, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def books(spark):
    columns = {c: F.lit("x") for c in models.FCT_BOOKS}
    numbers = "price list_price discount_pct rating_average quantity_sold".split()
    columns |= {c: F.rand(7) * 100 for c in numbers}
    columns |= {
        "product_id": F.col("id"),
        "review_count": F.col("id") % 50,
        "has_reviews": F.col("id") % 50 > 0,
        "spec_publisher_vn": F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
            F.col("id").cast("string")
        ),
    }
    made = spark.range(0, 30_000, 1, 8).withColumns(columns).select(*models.FCT_BOOKS)
    return tables.materialize(made, "books")


@pytest.fixture
def skewed(spark):
    """Thresholds small enough for the test data to count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_explorer_filters_reach_the_scan(books):
    found = analytics.explore_books(
        books, publishers=["a", "b"], price=(1.0, 2.0), rating=(3.0, 4.0), title="x"
    ).select("product_id")
    text = plan(found)
    for pushed in ("In(spec_publisher_vn", "GreaterThanOrEqual(price,1.0)", "LessThanOrEqual(rating"):
        assert pushed in text
    assert "sku" not in text[text.index("ReadSchema") :]


def test_reports_read_only_their_columns(books):
    text = plan(analytics.price_distribution(books, 10))
    assert text[text.index("ReadSchema") :].startswith("ReadSchema: struct<price:double>")
    text = plan(quality.dq_price_positive(books))
    assert "LessThan(price,0.0)" in text


def test_a_hot_publisher_is_split(books, skewed, monkeypatch):
    monkeypatch.setattr(median, "MAX_BROADCAST_GROUPS", 0)
    medians = group_medians(books, "spec_publisher_vn", ["price", "rating_average"])
    side = tables.small_side(medians, "medians", 0)
    joined = books.join(side, "spec_publisher_vn")
    joined.collect()
    assert "skew=true" in plan(joined)


def test_hot_reviews_without_book_are_split(spark, books, skewed):
    reviews = spark.range(0, 60_000, 1, 16).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("product_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("reviewer_name"),
    )
    orphans = quality.dq_review_orphans(reviews, books)
    rows = orphans.collect()
    assert len(rows) == 40_000 + 10_000
    assert "skew=true" in plan(orphans)


def test_no_plan_multiplies_rows(books):
    for df in (
        analytics.kpi_cards(books, books),
        analytics.underpriced_books(books),
        models.books_vs_actual_counts(books, books.select("product_id")),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_snapshot_reads_partitions_it_needs(spark, tmp_path):
    source = spark.createDataFrame([(1, 2.0)], "product_id bigint, price double")
    for day in ("20240101", "20240102"):
        history_table = snapshots.snapshot(
            "plans.prices", source, str(tmp_path), f"{day}_000000", "product_id", ["price"]
        )
    still_open = history_table.where(F.col(history.VALID_TO).isNull())
    text = plan(still_open)
    assert "PartitionFilters: [" in text and "state" in text[text.index("PartitionFilters") :]
    assert still_open.count() == 1


def test_history_step_shuffles_each_side_once(spark):
    source = spark.range(100).select(F.col("id").alias("k"), F.rand(1).alias("p"))
    open_rows = tables.materialize(
        source.withColumns({c: F.current_timestamp() for c in ("valid_from", "valid_to")}), "open"
    )
    step = history.scd2_step(open_rows, tables.materialize(source, "s"), "k", ["p"], F.now())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(step).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_listing_questions_read_no_details(spark):
    import __spark_entry__ as entry
    from conftest import SMALL

    for name in ("kpi_cards", "price_distribution", "discount_tiers", "dq_price_positive"):
        assert "part.parquet" not in plan(entry.QUERIES[name](spark, SMALL))
