"""Aggregates, division, membership and join conditions with explicit nulls.

A statistic over a group with a missing value is missing, and NaN is missing; 0/0 is
missing, x/0 is infinite; membership of a missing value is false; missing keys join each other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

INFINITY = float("inf")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _complete(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def strict_max(c: Column | str) -> Column:
    c = _column(c)
    return F.when(_complete(c), F.max(c))


LOW = 2**32
DECIMALS = 10


def known(c: Column | str) -> Column:
    """The number, with NaN as NULL."""
    c = _column(c)
    return F.when(~F.isnan(c.cast("double")), c)


def fixed_parts(c: Column | str, decimals: int = DECIMALS) -> tuple[Column, Column]:
    """High and low part, as bigints, of a number in units of 10^-decimals."""
    units = F.rint(known(c) * F.lit(10.0**decimals))
    high = F.floor(units / F.lit(float(LOW)))
    return high, (units - high * F.lit(float(LOW))).cast("bigint")


def from_parts(high: Column, low: Column, decimals: int = DECIMALS) -> Column:
    units = high.cast("decimal(20,0)") * F.lit(LOW) + low
    return units.cast("double") / F.lit(10.0**decimals)


def exact_sum(c: Column | str, decimals: int = DECIMALS) -> Column:
    """Sum in fixed point: equal for every order and grouping of the additions.

    The two parts are summed apart, so that a group of many rows neither rounds
    nor overflows, at the price of plain bigint additions.
    """
    high, low = fixed_parts(c, decimals)
    return from_parts(F.sum(high), F.sum(low), decimals)


def strict_sum(c: Column | str, decimals: int = DECIMALS) -> Column:
    c = known(c)
    return F.when(_complete(c), exact_sum(c, decimals))


def strict_avg(c: Column | str, decimals: int = DECIMALS) -> Column:
    c = known(c)
    return F.when(_complete(c), exact_sum(c, decimals) / F.count(F.lit(1)))


def ieee_div(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with x/0 = ±Infinity and 0/0 = NULL, never an ANSI error."""
    num, den = _column(num), _column(den)
    at_zero = F.when(num > 0, F.lit(INFINITY)).when(num < 0, F.lit(-INFINITY))
    return F.when(den == 0, at_zero).otherwise(F.try_divide(num, den))


def in_list(c: Column | str, values: Iterable) -> Column:
    return F.coalesce(_column(c).isin(*values), F.lit(False))


def three_valued(cond: Column) -> Column:
    """1 / 0 / NULL for a true / false / unknown condition."""
    return F.when(cond, 1).when(~cond, 0).cast("int")
