import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import rows

SCHEMA = "id bigint, extracted_at string, v string"


def latest(df, **options):
    return sorted(map(tuple, rows.latest_per_key(df, ["id"], **options).collect()), key=repr)


def test_latest_null_stamp_is_oldest_and_null_key_is_one_key(spark):
    df = spark.createDataFrame(
        [
            (1, "20240102_000000", "new"),
            (1, "20240101_000000", "old"),
            (1, None, "none"),
            (2, None, "only"),
            (None, "20240101_000000", "x"),
            (None, "20240103_000000", "y"),
        ],
        SCHEMA,
    )
    assert latest(df) == [
        (1, "20240102_000000", "new"),
        (2, None, "only"),
        (None, "20240103_000000", "y"),
    ]


def test_ties_do_not_hang_on_row_order(spark):
    tied = [(1, "s", v) for v in "abcde"] + [(1, "s", None)]
    for seed in range(4):
        random.Random(seed).shuffle(tied)
        assert latest(spark.createDataFrame(tied, SCHEMA).repartition(3)) == [(1, "s", "e")]
    assert latest(spark.createDataFrame(tied, SCHEMA), ties=["v"]) == [(1, "s", "e")]


def test_columns_without_order_are_no_tie_breakers(spark):
    df = spark.createDataFrame([(1, "s", '{"a":1}')], SCHEMA)
    df = df.withColumn("m", F.create_map("v", "id")).withColumn("p", F.try_parse_json("v"))
    assert rows.latest_per_key(df, ["id"]).count() == 1


def test_latest_is_idempotent_and_immune_to_overlap(spark):
    rng = random.Random(7)
    data = [
        (rng.choice([None, *range(20)]), f"2024010{rng.randint(1, 9)}_000000", str(rng.random()))
        for _ in range(400)
    ]
    df = spark.createDataFrame(data, SCHEMA)
    once = rows.latest_per_key(df, ["id"])
    expected = latest(df)
    assert latest(once) == expected
    assert latest(df.unionByName(df.limit(250)).unionByName(once)) == expected
    # Folding parts equals reading all at once.
    first, second = df.randomSplit([0.5, 0.5], seed=1)
    assert latest(rows.latest_per_key(first, ["id"]).unionByName(second)) == expected


def test_latest_keeps_one_row_per_key_and_task_before_the_shuffle(spark):
    """Two thirds of the rows share a key; they must not travel."""
    hot = spark.range(0, 60_000, 1, 6).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("id"),
        F.lit("s").alias("extracted_at"),
        F.col("id").cast("string").alias("v"),
    )
    plan = rows.latest_per_key(hot, ["id"])._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_drop_null_keys(spark):
    df = spark.createDataFrame([(1, "a", "x"), (None, "a", "y"), (2, None, "z")], SCHEMA)
    assert [r["v"] for r in rows.drop_null_keys(df, ["id", "extracted_at"]).collect()] == ["x"]


def test_drop_if_present_and_stamp(spark):
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    stamped = rows.stamp_run(rows.drop_if_present(df, ["v", "missing"]), "20240101_000000")
    assert stamped.columns == ["id", "extracted_at"]
    assert stamped.first()["extracted_at"] == "20240101_000000"


def test_work_list(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,), (2.0,)], "id double")
    found = rows.distinct_work_list(df)
    assert sorted(r["product_id"] for r in found.collect()) == [1, 2]
    assert found.schema["product_id"].dataType.simpleString() == "bigint"


def test_row_audit_counts_what_cleaning_keeps(spark):
    data = [(1, "a", "p"), (1, "b", None), (None, "a", "p"), (None, "b", "q"), (3, "a", None)]
    df = spark.createDataFrame(data, SCHEMA)
    audit = rows.row_audit({"all": (df, ["id"], []), "complete": (df, ["id"], ["id", "v"])})
    assert sorted(map(tuple, audit.collect())) == [("all", 5, 3, 2), ("complete", 5, 1, 4)]
    kept = rows.latest_per_key(rows.drop_null_keys(df, ["id", "v"]), ["id"]).count()
    assert kept == 1
    empty = rows.row_audit({"none": (df.limit(0), ["id"], [])})
    assert [tuple(r) for r in empty.collect()] == [("none", 0, 0, 0)]
    with pytest.raises(ValueError):
        rows.row_audit({})
