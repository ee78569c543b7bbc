"""Exact arithmetic for money and ratios.

Money is summed as whole cents in BIGINT, so totals do not depend on the order
in which partitions are merged, and averages are rounded from exact decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(20,0)"
WIDE = "decimal(28,0)"


def cents(amount: str | Column) -> Column:
    col = F.col(amount) if isinstance(amount, str) else amount
    return F.round(col * 100).cast("long")


def money(total_cents: Column) -> Column:
    return total_cents / F.lit(100.0)


def sum_money(amount: str | Column) -> Column:
    return money(F.sum(cents(amount)))


def ratio(num: Column, den: Column, scale: int, *, half_even: bool = False) -> Column:
    """``num / den`` of two integers, rounded once; NULL for a zero denominator."""
    exact = F.try_divide(num.cast(WHOLE), den.cast(WHOLE))
    rounded = F.bround(exact, scale) if half_even else F.round(exact, scale)
    return rounded.cast("double")


def product(left: Column, right: Column) -> Column:
    """Product of two integer sums, which may pass 2 ** 63."""
    return (left.cast(WIDE) * right.cast("decimal(19,0)")).cast(WIDE)


def wide_ratio(num: Column, den: Column, scale: int, *, half_even: bool = False) -> Column:
    """``ratio`` for terms made by ``product``."""
    exact = F.try_divide(num.cast(WIDE), den.cast(WIDE))
    rounded = F.bround(exact, scale) if half_even else F.round(exact, scale)
    return rounded.cast("double")


def mean_money(amount: str | Column, scale: int = 2, *, half_even: bool = False) -> Column:
    value = cents(amount)
    return ratio(F.sum(value), F.count(value) * 100, scale, half_even=half_even)


def mean_int(value: str | Column, scale: int, *, half_even: bool = False) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return ratio(F.sum(col), F.count(col), scale, half_even=half_even)


def plain_mean(value: str | Column) -> Column:
    """Unrounded mean of an integer column from its exact sum."""
    col = F.col(value) if isinstance(value, str) else value
    return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))


def no_negative_zero(col: Column) -> Column:
    return col + F.lit(0.0)
