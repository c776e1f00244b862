"""Values that no conversion could read are counted, in the pass that writes the rows."""

import pytest
from pyspark.sql import Observation

from shelfmark.operators import clean, losses
from shelfmark.plans import jobs

QUANTITIES = ["5", "n/a", None, " ", "null", '{"text": "sold"}', '{"value": 3}', "[1]", "7.9"]
PRICES = ["1.5", "x", None, "", "12 dong", "0", "1e3", "nan", "inf"]


@pytest.fixture
def raw(spark):
    listing = [(i, q, 10.0, "20240101_000000") for i, q in enumerate(QUANTITIES)]
    # An older extraction that is not kept: what it cannot read is no loss.
    listing += [(0, "broken", 10.0, "20230101_000000")]
    detail = [(i, p, p, p, str(i) + (".5" if i % 2 else ""), "[]", "20240101_000000") for i, p in enumerate(PRICES)]
    reviews = [(1, 1, "5", "1700000000", "r"), (1, 2, "2.5", "someday", "r"), (None, 3, "x", "x", "r"), (1, 4, None, "99999999999999", "r")]
    return {
        "listing": spark.createDataFrame(listing, "id long, quantity_sold string, list_price double, extracted_at string"),
        "detail": spark.createDataFrame(
            detail,
            "product_id long, price string, list_price string, rating_average string, review_count string, "
            "specifications string, extracted_at string",
        ),
        "reviews": spark.createDataFrame(reviews, "product_id long, review_id long, rating string, created_at string, extracted_at string"),
    }


EXPECTED = {
    ("listing", "quantity_sold"): 3,
    # "x", "12 dong", and "nan", a text that is no number here.
    ("detail", "price"): 3,
    ("detail", "list_price"): 3,
    ("detail", "rating_average"): 3,
    ("detail", "review_count"): 4,
    ("reviews", "rating"): 1,
    ("reviews", "created_at"): 2,
}


def test_job_stores_the_losses(spark, raw, tmp_path):
    audit = jobs.silver_from_raw(raw, str(tmp_path))
    found = {(r["entity"], r["column"]): r["rows_lost"] for r in spark.table(jobs.LOSSES).collect()}
    assert found == EXPECTED
    # Counted once, though the details are read for their keys first.
    assert {r["entity"]: r["rows_in"] for r in audit.collect()} == {"listing": 10, "detail": 9, "reviews": 4}
    kept = spark.table(jobs.SILVER["detail"]).orderBy("product_id").collect()
    assert [r["price"] for r in kept] == [1.5, None, None, None, None, 0.0, 1000.0, None, float("inf")]
    assert [r["list_price"] for r in kept][5] is None


def test_counting_changes_no_row_and_reads_nothing_twice(raw):
    lost = Observation("lost")
    plain = clean.clean_listing(raw["listing"])
    counted = clean.clean_listing(raw["listing"], lost=lost)
    assert counted.schema == plain.schema
    assert sorted(map(str, counted.collect())) == sorted(map(str, plain.collect()))
    assert lost.get == {"quantity_sold": 3}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("LogicalRDD") == 1


def test_same_counts_as_a_query(raw):
    conversions = clean.listing_conversions(raw["listing"])
    assert [tuple(r) for r in losses.conversion_losses(raw["listing"], conversions).collect()] == [("quantity_sold", 4)]


def test_empty_and_other_types(spark):
    doubles = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),), (None,)], "rating double")
    read = {"rating": clean.S.to_int_nullable(clean.S.to_number(doubles["rating"], doubles.schema["rating"].dataType))}
    assert losses.conversion_losses(doubles, read).first()["rows_lost"] == 1
    assert losses.conversion_losses(doubles.where("false"), read).first()["rows_lost"] == 0
