"""Landed responses are counted in the pass that writes them, and the counts are kept."""

import json

import pytest

from shelfmark.plans import jobs
from shelfmark.sources import bronze


def pages(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def listing(*ids):
    return json.dumps({"data": [{"id": i, "name": f"Book {i}", "price": 1.0} for i in ids]})


def kept(spark):
    return sorted(map(tuple, spark.table(jobs.LANDED).collect()))


def test_landing_counts_are_stored(spark, tmp_path):
    path, location = str(tmp_path / "bronze"), str(tmp_path / "tables")
    first = pages(spark, [listing(1, 2), listing(3), "{broken", None, "[]"])
    found = jobs.land(spark, {"listing": first}, path, "20240101_000000", location)
    assert [tuple(r) for r in found.collect()] == [("listing", 5, 3)]
    assert bronze.latest_run_file(spark, f"{path}/listing").count() == 3

    jobs.land(spark, {"listing": pages(spark, [listing(4)])}, path, "20240102_000000", location)
    assert kept(spark) == [("listing", "20240101_000000", 5, 3), ("listing", "20240102_000000", 1, 0)]
    # A run that is repeated counts once.
    jobs.land(spark, {"listing": pages(spark, [listing(4), "x"])}, path, "20240102_000000", location)
    assert kept(spark) == [("listing", "20240101_000000", 5, 3), ("listing", "20240102_000000", 2, 1)]


def test_nothing_landed(spark, tmp_path):
    found = jobs.land(spark, {"listing": pages(spark, [])}, str(tmp_path), "20240101_000000")
    assert [tuple(r) for r in found.collect()] == [("listing", 0, 0)]
    with pytest.raises(ValueError):
        jobs.land(spark, {}, str(tmp_path), "20240101_000000")
