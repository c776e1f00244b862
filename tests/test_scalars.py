import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import scalars as S


def x():
    return F.col("x")


def test_to_number_text(column):
    texts = ["1", " 2 ", "x", "1e3", "-.5", "5.", "", None, "1d", "2F", "nan", "1_000", "0x10"]
    expected = [1.0, 2.0, None, 1000.0, -0.5, 5.0, *[None] * 7]
    assert column(texts, "string", S.to_number(x())) == expected
    assert column(["inf", "-Infinity"], "string", S.to_number(x())) == [math.inf, -math.inf]


def test_to_number_of_numbers(column):
    assert column([1, None], "bigint", S.to_number(x(), T.LongType())) == [1.0, None]
    assert column([1.5, math.nan], "double", S.to_number(x(), T.DoubleType())) == [1.5, None]


def test_to_int_nullable(column):
    values = [3.0, 3.5, -2.0, None, math.nan, math.inf, 1e30]
    assert column(values, "double", S.to_int_nullable(x())) == [3, None, -2, *[None] * 4]


def test_zero_to_null(column):
    assert column([0.0, 1.5, None, -0.0], "double", S.zero_to_null(x())) == [None, 1.5, None, None]


def test_extract_quantity_text(column):
    cases = {
        "12": 12,
        "12.7": 12,
        "-3.9": -3,
        '"12"': 12,
        '"12.7"': None,
        '{"value":5}': 5,
        ' \n{"value": 6}': 6,
        '{"text":"x"}': None,
        '{"value":"7"}': 7,
        '{"value":1.5}': 1,
        '{"value":{"a":1}}': None,
        '{"value":null}': None,
        "null": None,
        "true": 1,
        "[1]": None,
        "abc": None,
        "": None,
        "NaN": None,
        "1e3": 1000,
        "007": None,
        "+5": None,
        "-0": 0,
        "12 junk": None,
        '{"value":5} x': None,
        "5,6": None,
        "5]": None,
        "\t12\n": 12,
        '{"value":5,"value":6}': 6,
        "9007199254740993": 9007199254740993,
        "99999999999999999999": None,
    }
    found = column(list(cases) + [None], "string", S.extract_quantity(x()))
    assert dict(zip(cases, found)) == cases and found[-1] is None


def test_extract_quantity_of_numbers_and_objects(column):
    values = [12.9, -3.9, math.nan, None]
    found = column(values, "double", S.extract_quantity(x(), T.DoubleType()))
    assert found == [12, -3, None, None]
    sold = T.StructType.fromDDL("text string, value bigint")
    found = column([("a", 5), ("b", None), None], sold.simpleString(), S.extract_quantity(x(), sold))
    assert found == [5, None, None]
    other = T.StructType.fromDDL("text string")
    assert column([("a",)], other.simpleString(), S.extract_quantity(x(), other)) == [None]


def test_extract_quantity_of_variant(column):
    parsed = F.try_parse_json(x())
    found = column(['{"value":5}', "7"], "string", S.extract_quantity(parsed, T.VariantType()))
    assert found == [5, 7]


def test_parse_created_at(spark, column):
    cases = {
        "1700000000": "2023-11-14 22:13:20",
        " 17 ": "1970-01-01 00:00:17",
        "-1": "1969-12-31 23:59:59",
        "2024": "1970-01-01 00:33:44",
        "2024-01-01T00:00:00+07:00": "2023-12-31 17:00:00",
        "2024-01-01": "2024-01-01 00:00:00",
        "2024-01-01 10:30:00": "2024-01-01 10:30:00",
        "1700000000000": None,
        "100000000000000000": None,
        "n/a": None,
        "12.7": None,
        "": None,
    }
    parsed = S.parse_created_at(x()).cast("timestamp_ntz")
    found = column(list(cases) + [None], "string", parsed)
    expected = [v and datetime.fromisoformat(v) for v in cases.values()] + [None]
    assert found == expected
    numbers = S.parse_created_at(x(), T.DoubleType()).cast("timestamp_ntz")
    assert column([60.9, None], "double", numbers) == [datetime(1970, 1, 1, 0, 1), None]


@pytest.mark.parametrize(
    ("price", "listed", "expected"),
    [
        (75.0, 100.0, 25.0),
        (120.0, 100.0, -20.0),
        (100.0, None, 0.0),
        (100.0, 0.0, 0.0),
        (100.0, -5.0, 0.0),
        (None, 100.0, None),
        (None, None, 0.0),
        (2.0, 3.0, 33.33),
        (99.875, 100.0, 0.13),
    ],
)
def test_discount_pct(spark, price, listed, expected):
    df = spark.createDataFrame([(price, listed)], "p double, l double")
    assert df.select(S.discount_pct(F.col("p"), F.col("l"))).first()[0] == expected


def test_has_reviews_is_never_null(column):
    assert column([3, 0, None], "bigint", S.has_reviews(x())) == [True, False, False]


def test_exact_avg_does_not_hang_on_order(spark):
    values = [37579.4616125 + d for d in (0.1, -0.1, 1e9, -1e9, 0.0, 0.3, -0.3, 0.0)]
    seen = set()
    for parts in (1, 2, 5):
        for rows in (values, values[::-1]):
            df = spark.createDataFrame([(v,) for v in rows], "x double").repartition(parts)
            seen.add(df.agg(S.exact_avg(x())).first()[0])
    assert seen == {37579.461613}


def test_exact_avg_keeps_large_and_tiny_values(spark):
    def avg(*values):
        return spark.createDataFrame([(v,) for v in values], "x double").agg(S.exact_avg(x())).first()[0]

    assert avg(1e21, 1.0, 3.0) == pytest.approx(1e21 / 3)
    assert avg(1e-9, 1e-9) == 1e-9
    assert avg(float("inf"), 1.0) == float("inf")
    assert str(avg(float("nan"), 1.0)) == "nan"
    assert avg(1 / 3, 2 / 3, None) == 0.5
    assert avg(None) is None
    assert avg(1.0, 2.0, 2.0) == 1.666667


def test_tolerant_means_tolerant(column):
    texts = ["12.5", "0", "0.0", "free", None]
    assert column(texts, "string", S.zero_to_null(x(), T.StringType())) == ["12.5", None, None, "free", None]
    odd = ["-9223372036854775808", "9223372036854775807"]
    assert column(odd, "string", S.parse_created_at(x())) == [None, None]


def test_run_stamp_round_trip(column):
    stamp = "20240229_235959"
    assert column([stamp], "string", S.run_stamp(S.run_timestamp(x()))) == [stamp]
