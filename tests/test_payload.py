import json

from pyspark.sql import functions as F

from shelfmark.operators import clean, payload

RUN = "20240101_000000"


def test_listing_pages(spark):
    pages = [
        json.dumps({"data": [{"id": 1, "name": "a", "quantity_sold": {"value": 3}, "new": 1}, {"id": 2}]}),
        json.dumps({"data": []}),
        json.dumps({"data": None}),
        json.dumps({"other": 1}),
        "no json",
    ]
    df = spark.createDataFrame([(p,) for p in pages], "payload string")
    items = payload.listing_from_payload(df, RUN)
    found = {r["id"]: r for r in items.collect()}
    assert set(found) == {1, 2}
    assert json.loads(found[1]["quantity_sold"]) == {"value": 3}
    assert found[2]["name"] is None and found[1]["extracted_at"] == RUN
    wider = payload.listing_from_payload(df, RUN, payload.LISTING_ITEM + ", new bigint")
    assert {r["id"]: r["new"] for r in wider.collect()} == {1: 1, 2: None}


def test_detail_responses(spark):
    responses = [
        {
            "id": 1,
            "name": "a",
            "specifications": [{"name": "g", "attributes": []}],
            "images": [{"base_url": "u"}, {"base_url": None}, {}],
            "categories": {"id": 5},
        },
        {"id": 2},
    ]
    texts = [*map(json.dumps, responses), "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    details = payload.detail_from_payload(df, RUN)
    assert len(details.columns) == 16
    assert details.where("product_id IS NULL").count() == 2
    one, two = details.where("product_id IS NOT NULL").orderBy("product_id").collect()
    assert json.loads(one["specifications"]) == [{"name": "g", "attributes": []}]
    assert json.loads(one["images"]) == ["u", None, None]
    assert json.loads(one["categories"]) == {"id": 5}
    assert (two["specifications"], two["images"], two["categories"]) == ("[]", "[]", "{}")


def test_reviews(spark):
    by = {"name": "n", "purchased": True}
    page = {
        "data": [
            {"id": 1, "rating": 5, "created_at": 1700000000, "created_by": by},
            {"id": 2, "rating": 4, "created_at": "2024-01-01", "created_by": None},
            {"id": 3},
        ],
        "paging": {"total": 4},
    }
    rows = [(7, json.dumps(page)), (8, json.dumps({"data": [], "paging": {"total": 2}})), (9, "{}")]
    df = spark.createDataFrame(rows, "product_id bigint, payload string")
    found = payload.reviews_from_payload(df, RUN).orderBy("review_id").collect()
    assert [(r["review_id"], r["product_id"], r["rating"]) for r in found] == [
        (1, 7, "5"),
        (2, 7, "4"),
        (3, 7, None),
    ]
    assert [r["created_at"] for r in found] == ["1700000000", "2024-01-01", None]
    assert [(r["reviewer_name"], r["reviewer_purchased"]) for r in found] == [
        ("n", True),
        (None, None),
        (None, None),
    ]
    totals = payload.review_total_reached(df).orderBy("product_id").collect()
    assert [tuple(r) for r in totals] == [(7, 3, 4, 0, False), (8, 0, 2, 0, False), (9, 0, 0, 0, True)]


def test_completeness_is_honest(spark):
    """Pages that cannot be read, and totals that are no number, never make a product complete."""
    one = json.dumps({"data": [{"id": 1}], "paging": {"total": "2"}})
    rows = [
        (1, '{"data": [{"id": 1}'),
        (2, one),
        (3, one),
        (3, one.replace("1}", "2}")),
        (4, json.dumps({"data": [{"id": 1}], "paging": {"total": "many"}})),
        (5, None),
        (6, "[]"),
        (7, json.dumps({"data": [{"id": 1}, {"id": 2}], "paging": {"total": 2.0}})),
    ]
    df = spark.createDataFrame(rows, "product_id bigint, payload string")
    found = {r[0]: tuple(r)[1:] for r in payload.review_total_reached(df).collect()}
    assert found == {
        1: (0, 0, 1, False),
        2: (1, 2, 0, False),
        3: (2, 2, 0, True),
        4: (1, 0, 1, False),
        5: (0, 0, 1, False),
        6: (0, 0, 1, False),
        7: (2, 2, 0, True),
    }
    assert tuple(payload.page_audit(df).first()) == (8, 3)


def test_items_are_kept_whole(spark):
    """Numbers sent as text or with a fraction of 0 are numbers; unknown fields stay in `record`."""
    odd = {"id": "9007199254740993", "price": "12.5", "review_count": 4.0, "order_count": 4.5, "badges": [{"code": "x"}]}
    page = json.dumps({"data": [odd, {"id": 2, "review_count": 3}, {"id": "x"}]})
    df = spark.createDataFrame([(page,), ("{",)], "payload string")
    rows = payload.listing_from_payload(df, RUN).collect()
    shown = [(r["id"], r["price"], r["review_count"], r["order_count"]) for r in rows]
    assert shown == [(9007199254740993, 12.5, 4, None), (2, None, 3, None), (None, None, None, None)]
    assert json.loads(rows[0]["record"]) == odd


def test_payload_text_keeps_diacritics(spark):
    df = spark.createDataFrame(
        [(json.dumps({"data": [{"id": 1, "name": "Bìa mềm"}]}),)], "payload string"
    )
    assert payload.listing_from_payload(df, RUN).select(F.col("name")).first()[0] == "Bìa mềm"


def test_each_text_is_parsed_once(spark, tmp_path):
    """Spark would infer filters that parse again below the rows they make."""
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "{}")], "product_id bigint, payload string").write.parquet(path)
    df = spark.read.parquet(path)
    for rows, times in (
        (payload.listing_from_payload(df, RUN), 2),  # the page, and each of its records
        (payload.detail_from_payload(df, RUN), 1),
        (payload.reviews_from_payload(df, RUN), 1),
        (payload.review_total_reached(df), 1),
    ):
        text = rows._jdf.queryExecution().executedPlan().toString()
        assert text.count("from_json(") == times
    specs = clean.flatten_specs(df, "product_id", "payload")
    text = specs._jdf.queryExecution().executedPlan().toString()
    assert text.count("from_json(") == 1 and text.count("parseJson") <= 1
