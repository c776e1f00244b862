"""A sum of doubles that is exact, and so does not depend on partitions or order.

Every double is a whole number times a power of two. Its digits to the base 2^24 go into bins, one per
power, and each bin is a plain sum of 64-bit integers: exact, combined before the shuffle like any sum,
and the same in every order. Per group, carries make the bins the digits of the exact sum, which is
rounded once, to the nearest double.

The bins reach from 2^-120 to 2^96 and hold 2^39 rows. What a value has below 2^-120 is cut off, value
by value, so the sum is still the same in every order. A group with a value of 2^96 or more, an
infinite one or NaN has the plain sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 24
_BASE = 1 << _BITS
_LOWEST, _HIGHEST = -5, 3  # powers of the base
_LIMIT = 2.0 ** (_BITS * (_HIGHEST + 1))
_BINS = _HIGHEST - _LOWEST + 1

# The way from bins to the rounded sum, as SQL text: one call builds it, where the functions of this
# language would take a hundred.


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _carried(bins: str) -> str:
    """Lowest first: digits from 0 to base - 1, and behind them what is carried beyond, signed."""
    return f"""aggregate({bins}, named_struct('c', 0L, 'd', cast(array() AS array<bigint>)),
        (a, x) -> named_struct('c', shiftright(x + a.c, {_BITS}), 'd', array_append(a.d, (x + a.c) & {_BASE - 1}L)),
        a -> array_append(a.d, a.c))"""


def _positive(carried: str) -> str:
    """Carried digits of the number without its sign, which is that of the last digit.

    The number is no longer than before: the last place takes up what is carried once more.
    """
    again = _carried(f"transform({carried}, x -> -x)")
    last = f"element_at(n, -1) * {_BASE}L + element_at(n, -2)"
    flipped = _let("n", again, f"array_append(slice(n, 1, {_BINS}), {last})")
    return f"CASE WHEN element_at({carried}, -1) < 0 THEN {flipped} ELSE {carried} END"


def _rounded(digits: str) -> str:
    """The double nearest to the number with these digits, lowest first, the last one unbounded.

    From the first digit that is not 0 on, two numbers of 48 bits, and one bit for all below. Both are
    doubles without loss, so adding them is the only rounding.
    """
    high = f"""concat(array(shiftright(element_at({digits}, -1), {_BITS}), element_at({digits}, -1) & {_BASE - 1}L),
        reverse(slice({digits}, 1, {_BINS})), array(0L, 0L, 0L))"""
    below = f"cast(exists(slice(h, f + 4, {_BINS + 5}), x -> x <> 0) AS bigint)"
    upper = f"cast(h[f - 1] * {_BASE}L + h[f] AS double)"
    lower = f"cast((h[f + 1] * {_BASE}L + h[f + 2]) * 2L + {below} AS double)"
    lowest = f"{_BITS * (_HIGHEST + 2) - 1} - {_BITS} * (f + 2)"
    whole = f"({upper} * {2 ** (2 * _BITS + 1)}D + {lower}) * pow(2D, {lowest})"
    first = "cast(array_position(transform(h, x -> x <> 0), true) AS int)"
    return _let("h", high, _let("f", first, f"CASE WHEN f > 0 THEN {whole} ELSE 0D END"))


def _total() -> str:
    number = _let("p", _positive("c"), _rounded("p"))
    signed = _let("r", number, "CASE WHEN element_at(c, -1) < 0 THEN -r ELSE r END")
    return "bins -> " + _let("c", _carried("transform(bins, x -> coalesce(x, 0L))"), signed)


def exact_sum(col: Column) -> Column:
    """The sum of the group, rounded once; null without a value."""
    value = col.cast("double")
    held = F.when(F.abs(value) < F.lit(_LIMIT), value)
    # Each bin holds the digit of a value at its power of the base, with the sign of the value.
    places = [2.0 ** (-_BITS * k) for k in range(_LOWEST, _HIGHEST + 1)]
    bins = F.array(*(F.sum((held * p % float(_BASE)).cast("bigint")) for p in places))
    total = F.call_function("transform", F.array(bins), F.expr(_total()))[0]
    n = F.count(value)
    return F.when(n > F.count(held), F.sum(value)).when(n > 0, total)
