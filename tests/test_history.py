from datetime import datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from shelfmark.operators import history, rows
from shelfmark.sources import fixtures as fx

CHECK = ["price", "discount_rate"]
SCHEMA = "product_id bigint, name string, price double, discount_rate double"


def ts(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def shown(df):
    plain = df.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")}
    )
    return sorted(
        (
            (r["product_id"], r["name"], r["price"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day)
            for r in plain.collect()
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def first_day(spark):
    source = spark.createDataFrame(
        [
            (1, "same", 1.0, 0.0),
            (2, "changed", 1.0, 0.0),
            (3, "to null", 1.0, 0.0),
            (4, "from null", None, 0.0),
            (5, "null", None, None),
            (6, "renamed", 1.0, 0.0),
            (7, "vanished", 1.0, 0.0),
        ],
        SCHEMA,
    )
    return history.scd2_merge(
        history.empty_history(source), source, "product_id", CHECK, ts(1)
    ).cache()


@pytest.fixture(scope="module")
def second_day(spark, first_day):
    source = spark.createDataFrame(
        [
            (1, "same", 1.0, 0.0),
            (2, "changed", 2.0, 0.0),
            (3, "to null", None, 0.0),
            (4, "from null", 1.0, 0.0),
            (5, "null", None, None),
            (6, "new name", 1.0, 0.0),
            (8, "new", 1.0, 0.0),
        ],
        SCHEMA,
    )
    return history.scd2_merge(first_day, source, "product_id", CHECK, ts(2)).cache()


def test_first_merge_opens_every_row(first_day):
    assert len(shown(first_day)) == 7
    assert all(row[3:] == (1, None) for row in shown(first_day))


def test_second_merge(second_day):
    assert shown(second_day) == sorted(
        [
            (1, "same", 1.0, 1, None),
            (2, "changed", 1.0, 1, 2),
            (2, "changed", 2.0, 2, None),
            (3, "to null", 1.0, 1, 2),
            (3, "to null", None, 2, None),
            (4, "from null", None, 1, 2),
            (4, "from null", 1.0, 2, None),
            (5, "null", None, 1, None),
            (6, "renamed", 1.0, 1, None),
            (7, "vanished", 1.0, 1, 2),
            (8, "new", 1.0, 2, None),
        ],
        key=repr,
    )


def test_returned_key_opens_a_new_row(spark, second_day):
    source = spark.createDataFrame([(7, "back", 1.0, 0.0)], SCHEMA)
    third = history.scd2_merge(second_day, source, "product_id", CHECK, ts(5), False)
    of_seven = [row for row in shown(third) if row[0] == 7]
    assert of_seven == [(7, "back", 1.0, 5, None), (7, "vanished", 1.0, 1, 2)]
    # Without invalidation the other keys stay open.
    assert (1, "same", 1.0, 1, None) in shown(third)


def test_two_rows_of_a_key_fail(spark, first_day):
    source = spark.createDataFrame([(1, "a", 1.0, 0.0), (1, "b", 2.0, 0.0)], SCHEMA)
    merged = history.scd2_merge(first_day, source, "product_id", CHECK, ts(2))
    with pytest.raises(Exception, match="more than one row for product_id 1"):
        merged.collect()


def test_price_history(spark):
    df = spark.createDataFrame(
        [
            (1, "a", "b", 1.0, 0.0, datetime(2024, 1, 1, 23, 0), datetime(2024, 1, 2, 1, 0)),
            (2, "a", "b", 1.0, 0.0, datetime(2024, 1, 1, 1, 0), None),
        ],
        "product_id bigint, name string, brand_name string, price double, discount_rate double, "
        "valid_from timestamp_ntz, valid_to timestamp_ntz",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("valid_from", "valid_to")})
    found = history.price_history(df, ts(4)).orderBy("product_id").collect()
    assert [(r["is_current"], r["days_at_price"]) for r in found] == [(False, 1), (True, 3)]
    assert found[1]["valid_to"] is not None and len(found[0]) == 9


def test_merging_every_run_equals_the_backfill(spark, tmp_path):
    """All daily runs of the events, merged one by one, against the islands of all runs."""
    runs = fx.price_runs(fx.table(spark, SMALL, "events")).cache()
    everything = history.scd2_backfill(runs, "product_id", CHECK, ties=["seen_at"])
    merged = history.empty_history(runs)
    for stamp in sorted(r[0] for r in runs.select("extracted_at").distinct().collect()):
        source = rows.latest_per_key(
            runs.where(F.col("extracted_at") == stamp), ["product_id"], "seen_at", ties=[]
        )
        now = F.to_timestamp(F.lit(stamp), "yyyyMMdd_HHmmss")
        step = history.scd2_merge(merged, source, "product_id", CHECK, now)
        path = str(tmp_path / stamp)
        step.write.parquet(path)
        merged = spark.read.parquet(path)
    columns = sorted(everything.columns)
    left = sorted(map(repr, merged.select(columns).collect()))
    right = sorted(map(repr, everything.select(columns).collect()))
    assert left == right and len(left) > 100

    # At most one open row per key, and no two intervals of a key overlap.
    open_rows = merged.where("valid_to IS NULL").groupBy("product_id").count()
    assert open_rows.where("count > 1").count() == 0
    a, b = merged.alias("a"), merged.alias("b")
    overlap = a.join(b, F.expr("a.product_id = b.product_id AND a.valid_from < b.valid_from")).where(
        F.expr("a.valid_to IS NULL OR a.valid_to > b.valid_from")
    )
    assert overlap.count() == 0


def test_backfill_has_no_window_over_all_runs(spark):
    runs = fx.price_runs(fx.table(spark, SMALL, "events"))
    usual = history.scd2_backfill(runs, "product_id", CHECK, ties=["seen_at"])
    plan = usual._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(product_id" in plan and "windowspecdefinition(extracted_at" not in plan
    stamps = [r[0] for r in runs.select("extracted_at").distinct().collect()]
    known = history.scd2_backfill(runs, "product_id", CHECK, ties=["seen_at"], runs=stamps)
    assert sorted(map(repr, known.collect())) == sorted(map(repr, usual.collect()))


def test_backfill_with_known_runs_sees_empty_runs(spark):
    """A run in which nothing was found closes what was open before it."""
    df = spark.createDataFrame(
        [(1, "a", 1.0, 0.0, "20240101_000000"), (1, "a", 1.0, 0.0, "20240103_000000")],
        SCHEMA + ", extracted_at string",
    )
    stamps = ["20240101_000000", "20240102_000000", "20240103_000000"]
    found = history.scd2_backfill(df, "product_id", CHECK, runs=stamps)
    assert shown(found) == [(1, "a", 1.0, 1, 2), (1, "a", 1.0, 3, None)]
    without = history.scd2_backfill(df, "product_id", CHECK)
    assert shown(without) == [(1, "a", 1.0, 1, None)]


def test_backfill_over_very_many_runs(spark):
    """100,000 runs: the calendar is dealt out as pairs, not with the array of all runs in every row."""
    stamp = F.date_format(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000), "yyyyMMdd_HHmmss")
    runs = spark.range(100_000).select(
        (F.col("id") % 7).alias("k"), F.lit(1.0).alias("price"), stamp.alias("extracted_at")
    )
    # One key in every run, its price changed once; the others in every seventh run.
    always = spark.range(100_000).select(
        F.lit(100).cast("long").alias("k"), F.when(F.col("id") < 40_000, 1.0).otherwise(2.0).alias("price"),
        stamp.alias("extracted_at"),
    )
    found = history.scd2_backfill(runs.unionByName(always), "k", ["price"])
    counts = {r["k"]: (r["n"], r["open"]) for r in found.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_to").isNull()).alias("open")).collect()}
    assert counts.pop(100) == (2, 1)
    assert sum(n for n, _ in counts.values()) == 100_000 and sum(o for _, o in counts.values()) == 1
