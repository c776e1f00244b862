"""JSON text to VARIANT, for whole texts only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's readers stop at the end of the first value and ignore what follows ("12 junk" is 12).
# This mark is put behind the text; where it does not come next, the text is no JSON.
END = "#end of text#"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def parse_whole(text: Column) -> Column:
    """VARIANT array of the value of `text` and the end mark; null where no value can be read.

    The value is at `$[0]`. Check `is_whole` before using it.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{END}"]')))


def is_whole(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$[1]", "string") == END
