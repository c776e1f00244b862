"""The exact sum against the one of the standard library, in every order and partitioning."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions.exact import exact_sum
from shelfmark.functions.scalars import exact_avg


def sums(spark, groups, parts):
    rows = [(g, v) for g, values in enumerate(groups) for v in values]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
    return dict(map(tuple, df.groupBy("g").agg(exact_sum(F.col("x"))).collect()))


@pytest.mark.parametrize("parts", [1, 64])
def test_large_small_and_thirds(spark, parts):
    rng = random.Random(7)
    mixed = [1e21, 1e-9, 1 / 3, -1e21, 2 / 3, 1e-9, 7e15, -1 / 7] * 5
    groups = [
        mixed,
        [*mixed, -1e21],
        [rng.choice([1e21, 1e-9, 1 / 3, -1e21]) * rng.uniform(-1, 1) for _ in range(500)],
        [rng.uniform(0, 1e6) for _ in range(2000)],
        [0.1] * 10,
        [1e16, 1.0, -1e16],
        [-(2.0**95), 2.0**-60],
        [2.0**53, 1.0, 2.0**-60],
        [2.0**53, 1.0],
        [-(2.0**53), -1.0, -(2.0**-60)],
        [0.0, -0.0],
    ]
    assert sums(spark, groups, parts) == {g: math.fsum(values) for g, values in enumerate(groups)}


finite = st.floats(-1e25, 1e25).filter(lambda x: x == 0 or abs(x) > 1e-15)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.lists(st.lists(finite, min_size=1, max_size=30), min_size=1, max_size=40), parts=st.integers(1, 9))
def test_any_numbers(spark, groups, parts):
    assert sums(spark, groups, parts) == {g: math.fsum(values) for g, values in enumerate(groups)}


def test_values_beyond_the_bins(spark):
    inf, nan = float("inf"), float("nan")
    found = sums(spark, [[1e300, 1.0], [inf, 1.0], [nan, 1.0], [None], [None, 2.5], [1e-300, 1.0]], 3)
    assert (found[0], found[1], found[3], found[4], found[5]) == (1e300, inf, None, 2.5, 1.0)
    assert math.isnan(found[2])
    # Below 2^-120 digits are cut off, in every order alike.
    tiny = [5e-30, -5e-30, 3e-28, 1e-33]
    assert len({sums(spark, [tiny], parts)[0] for parts in (1, 2, 3, 4)}) == 1
    assert sums(spark, [tiny], 1)[0] == pytest.approx(3e-28, rel=1e-4)


def test_average_of_what_no_decimal_holds(spark):
    rng = random.Random(3)
    values = [rng.choice([1e21, 1e-9, 1 / 3]) * rng.uniform(-1, 1) for _ in range(300)]
    seen = set()
    for parts in (1, 3, 64):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        seen.add(df.agg(exact_avg(F.col("x"))).first()[0])
    assert seen == {math.fsum(values) / 300}
