"""Tolerant conversions and derived columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.exact import exact_sum
from shelfmark.functions.json import bind, is_whole, parse_whole

# The run stamp, as written into every extracted record.
RUN_STAMP = "yyyyMMdd_HHmmss"

# Seconds that fit a signed 64-bit count of nanoseconds.
MAX_EPOCH_SECONDS = 9_223_372_036

# Spark's own text-to-double cast also takes Java suffixes ("1d", "2f"), which are not numbers here.
_NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

# Digits that are JSON as they stand and fit a bigint.
_DIGITS = r"^-?(0|[1-9]\d{0,17})$"


def to_number(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Number, or null where the value does not read as one. NaN counts as missing."""
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(_NUMBER_TEXT), col.try_cast("double"))
    number = col.cast("double")
    return F.when(~F.isnan(number), number)


def to_int_nullable(col: Column) -> Column:
    """Whole numbers as bigint; fractions, overflow and missing values as null."""
    return F.when(col == F.floor(col), col.try_cast("bigint"))


def zero_to_null(col: Column, dtype: T.DataType = T.DoubleType()) -> Column:
    """The value as it is, null where it is the number 0; text need not be a number."""
    return F.when(~to_number(col, dtype).eqNullSafe(F.lit(0.0)), col)


def extract_quantity(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Integer from a number, from an object's `value`, or from JSON text of either.

    Numbers are cut toward zero. Whatever does not read as an integer is null.
    """
    if isinstance(dtype, T.StructType):
        if "value" not in dtype.fieldNames():
            return F.lit(None).cast("bigint")
        return col.getField("value").try_cast("bigint")
    if isinstance(dtype, T.StringType):
        # Each text is parsed at most once, and plain digits not at all.
        is_object = F.startswith(F.ltrim(col, F.lit(" \t\r\n")), F.lit("{"))

        def value(parsed: Column) -> Column:
            of_object = F.try_variant_get(parsed, "$[0].value", "bigint")
            number = F.when(is_object, of_object).otherwise(
                F.try_variant_get(parsed, "$[0]", "bigint")
            )
            return F.when(is_whole(parsed), number)

        return F.when(col.rlike(_DIGITS), col.try_cast("bigint")).otherwise(
            bind(parse_whole(col), value)
        )
    if isinstance(dtype, T.VariantType):
        return F.coalesce(
            F.try_variant_get(col, "$.value", "bigint"),
            F.try_variant_get(col, "$", "bigint"),
        )
    return col.try_cast("bigint")


def parse_created_at(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """UTC timestamp from epoch seconds (number or text) or from a date text; else null.

    Whole-number text is always seconds, so "2024" is not a year. Seconds beyond the
    64-bit nanosecond range are null. Needs the UTC session zone set by `session.prepare`.
    """
    seconds = col.try_cast("bigint")
    bounded = F.when(seconds.between(-MAX_EPOCH_SECONDS, MAX_EPOCH_SECONDS), seconds)
    from_epoch = F.timestamp_seconds(bounded)
    if not isinstance(dtype, T.StringType):
        return from_epoch
    return F.when(seconds.isNull(), F.try_to_timestamp(col)).otherwise(from_epoch)


def round_half_up(col: Column, digits: int) -> Column:
    """Round the scaled binary value, so that results do not hang on decimal text."""
    scale = float(10**digits)
    return F.round(col * F.lit(scale), 0) / F.lit(scale)


def exact_avg(col: Column, digits: int = 6) -> Column:
    """Average that does not depend on the order of summation, rounded half up.

    Where eight decimal places hold every value of the group to the last digit a double shows, decimals
    are summed, so that 0.1 counts as a tenth. Any other group is summed exactly as the binary numbers
    its values are (`exact_sum`). So every partitioning gives the same last digit. Averages that are so
    small, so large or so little of a number that rounding would change them beyond recognition stay
    as they are.
    """
    value = col.cast("double")
    exact = value.try_cast("decimal(28,8)")
    near = F.abs(exact.cast("double") - value) <= F.abs(value) * F.lit(1e-15)
    fits = F.bool_and(F.when(value.isNotNull(), F.coalesce(near, F.lit(False))))
    rounded = F.round(F.avg(exact), digits).cast("double")
    plain = exact_sum(value) / F.count(value)
    usual = F.abs(plain).between(1e-3, 1e9)
    return F.when(fits, rounded).when(usual, F.round(plain, digits)).otherwise(plain)


def discount_pct(price: Column, list_price: Column) -> Column:
    """Percent off the list price, 0 without a positive list price, null without a price."""
    pct = (list_price - price) * F.lit(100.0) / list_price
    return F.when(list_price > 0, round_half_up(pct, 2)).otherwise(F.lit(0.0))


def has_reviews(review_count: Column) -> Column:
    return F.coalesce(review_count > 0, F.lit(False))


def run_timestamp(stamp: Column) -> Column:
    return F.to_timestamp(stamp, RUN_STAMP)


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, RUN_STAMP)
