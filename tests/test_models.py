import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import models, payload
from shelfmark.plans import jobs
from shelfmark.sources import bronze, tables
from shelfmark.streaming.follow import follow_latest, latest_state


def listing_page(*items):
    return json.dumps({"data": list(items)})


def item(id, price, **more):
    return {"id": id, "name": f"b{id}", "price": price, "list_price": 100.0, **more}


def land(spark, path, run, items, details, reviews):
    """One crawl: payload texts to bronze runs."""
    pages = spark.createDataFrame([(listing_page(*items),)], "payload string")
    bronze.bronze_append(payload.listing_from_payload(pages, run), f"{path}/listing", run)
    texts = spark.createDataFrame([(json.dumps(d),) for d in details], "payload string")
    bronze.bronze_append(payload.detail_from_payload(texts, run), f"{path}/detail", run)
    pages = spark.createDataFrame(
        [(p, json.dumps(r)) for p, r in reviews], "product_id bigint, payload string"
    )
    bronze.bronze_append(payload.reviews_from_payload(pages, run), f"{path}/reviews", run)


def detail(id, publisher):
    attributes = [{"code": "publisher_vn", "name": "x", "value": publisher}, {"code": "new_key", "value": 1}]
    return {"id": id, "name": f"b{id}", "specifications": [{"attributes": attributes}], "price": 1.0, "list_price": 0}


def review(id, rating, thanks):
    return {"id": id, "rating": rating, "thank_count": thanks, "created_at": 1700000000, "title": "t"}


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Two daily runs over landed responses."""
    path, location = (str(tmp_path_factory.mktemp(n)) for n in ("bronze", "tables"))
    first, second = "20240101_000000", "20240102_000000"
    land(
        spark,
        path,
        first,
        [item(1, 50.0, review_count=9, quantity_sold={"value": 3}), item(2, 80.0)],
        [detail(1, "P")],
        [(1, {"data": [review(10, 5, 1), review(11, 9, 0)], "paging": {"total": 2}})],
    )
    jobs.run_all(spark, path, location, first).collect()
    land(
        spark,
        path,
        second,
        [item(1, 40.0, review_count=0, quantity_sold=4), item(3, None)],
        [detail(1, "Q"), detail(3, "R")],
        [(1, {"data": [review(10, 4, 2)]}), (77, {"data": [review(12, 3, 0)]})],
    )
    report = {(r["table"], r["rule"]): r["violations"] for r in jobs.run_all(spark, path, location, second).collect()}
    return path, location, report


def test_books(spark, ran):
    books = spark.table(jobs.BOOKS)
    assert books.columns == models.FCT_BOOKS and len(books.columns) == 50
    found = {r["product_id"]: r for r in books.collect()}
    assert set(found) == {1, 2, 3}
    one = found[1]
    assert (one["price"], one["discount_pct"], one["has_reviews"], one["quantity_sold"]) == (40.0, 60.0, False, 4)
    assert one["spec_publisher_vn"] == "Q" and found[2]["spec_publisher_vn"] is None
    assert found[2]["discount_pct"] == 20.0 and found[3]["discount_pct"] is None


def test_silver_follows_the_keys_in_the_data(spark, ran):
    silver = spark.table(jobs.SILVER["detail"])
    assert "spec_new_key" in silver.columns and "spec_edition" in silver.columns
    assert "specifications" not in silver.columns
    assert silver.where("list_price IS NOT NULL").count() == 0


def test_reviews(spark, ran):
    reviews = spark.table(jobs.REVIEWS)
    assert reviews.columns == models.FCT_REVIEWS and len(reviews.columns) == 19
    found = {r["review_id"]: r for r in reviews.collect()}
    assert set(found) == {10, 11, 12}
    assert (found[10]["rating"], found[10]["thank_count"], found[10]["product_name"]) == (4, 2, "b1")
    assert found[12]["product_name"] is None


def test_prices(spark, ran):
    found = sorted(
        (r["product_id"], r["price"], r["is_current"], r["days_at_price"]) for r in spark.table(jobs.PRICES).collect() if r["price"]
    )
    # Bronze keeps product 2 although the second listing lacks it, so it stays open.
    assert found == [(1, 40.0, True, 0), (1, 50.0, False, 1), (2, 80.0, True, 1)]


def test_report(ran):
    report = ran[2]
    assert report["books", "not_null(price)"] == 1
    assert report["reviews", "relationships(product_id)"] == 1
    assert report["reviews", "accepted_values(rating)"] == 1
    assert report["books", "review_count_matches_actual"] == 1
    assert report["books", "unique(product_id)"] == 0


def test_staging_shapes(spark, ran):
    assert len(spark.table("stg_listing").columns) == 38
    assert len(spark.table("stg_detail").columns) == 39
    assert len(spark.table("stg_reviews").columns) == 10


def test_stream_follows_bronze(spark, tmp_path):
    """Folding runs as they arrive gives the rows of one pass over all of bronze."""
    from shelfmark.operators.rows import latest_per_key

    path, state, checkpoint = (str(tmp_path / n) for n in ("bronze", "state", "checkpoint"))
    schema = spark.createDataFrame([], "id bigint, v string, extracted_at string").schema
    runs = {
        "20240101_000000": [(1, "a"), (2, "a"), (None, "a")],
        "20240102_000000": [(2, "b"), (3, "b")],
        "20240103_000000": [(1, "c"), (None, "c"), (3, "c")],
    }
    assert latest_state(spark, state, schema).count() == 0
    for run, rows in runs.items():
        df = spark.createDataFrame([(*row, run) for row in rows], schema)
        bronze.bronze_append(df, path, run)
        follow_latest(spark, path, schema, state, checkpoint, ["id"]).awaitTermination()
        whole = latest_per_key(bronze.bronze_union(spark, path), ["id"])
        found = latest_state(spark, state, schema)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, whole.select(found.columns).collect()))


def test_skewed_reviews_are_split(spark, tmp_path):
    """One product holds most reviews: its partition is read by several tasks."""
    n = 30_000
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    columns = {c: F.lit(None).cast("string") for c in models.STG_REVIEWS}
    columns |= {
        "review_id": F.col("id"),
        "product_id": F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id")),
        "content": F.sha2(F.col("id").cast("string"), 256),
    }
    reviews = spark.range(0, n, 1, 16).withColumns(columns).select(*models.STG_REVIEWS)
    books = spark.range(0, n).withColumns(
        {c: F.lit(1.0) for c in models.BOOKS_NARROW} | {"product_id": F.col("id"), "name": F.lit("n")}
    )
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = models.fct_reviews(reviews, tables.materialize(books, "books"))
        assert joined.count() == n
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
