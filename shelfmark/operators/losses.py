"""Values that a tolerant conversion could not read: made null, but counted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

_READ = "__read_"


def _is_given(col: Column, dtype: T.DataType) -> Column:
    """Whether there is a value at all: blank text, a JSON null and NaN are missing, not lost."""
    if isinstance(dtype, T.StringType):
        return ~F.btrim(col, F.lit(" \t\r\n")).isin("", "null")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return ~F.isnan(col) & col.isNotNull()
    return col.isNotNull()


def _both(df: DataFrame, conversions: Mapping[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Converted values beside the given ones, so that each is converted once, and the lost ones' counts."""
    both = df.withColumns({_READ + name: read for name, read in conversions.items()})
    lost = {
        name: F.count_if(_is_given(F.col(name), df.schema[name].dataType) & F.col(_READ + name).isNull())
        for name in conversions
    }
    return both, lost


def converted(
    df: DataFrame, conversions: Mapping[str, Column], lost: Observation | None = None
) -> DataFrame:
    """Every column replaced by its conversion.

    `lost` receives, per column, how many given values became null. They are counted while the rows pass
    by on their way to whatever is done with them: no second read. An observation counts in the first
    action that runs on the result, so that should be the write.
    """
    if lost is None:
        return df.withColumns(dict(conversions))
    both, counts = _both(df, conversions)
    seen = both.observe(lost, *(count.alias(name) for name, count in counts.items()))
    return seen.withColumns({name: F.col(_READ + name) for name in conversions}).drop(
        *(_READ + name for name in conversions)
    )


def conversion_losses(df: DataFrame, conversions: Mapping[str, Column]) -> DataFrame:
    """(column, rows_lost): the same counts as a query, one pass and one row a column."""
    both, counts = _both(df.select(*conversions), conversions)
    listed = F.array(
        *(F.struct(F.lit(name).alias("column"), count.alias("rows_lost")) for name, count in counts.items())
    )
    return both.agg(listed.alias("counts")).select(F.inline("counts"))
