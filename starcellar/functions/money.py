"""Ratios, percentages and labels of amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(amount: Column) -> Column:
    """Sums are made over exact decimals; only the result becomes a double."""
    return amount.cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL when the whole is 0 or missing."""
    return F.try_divide(as_double(part), as_double(whole))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 when the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(ratio(part, whole))


# Multiples of the value, as sums of its doublings: each step below is exact in binary.
_DOUBLINGS = {1: (8, 2), 2: (64, 32, 4)}


def rounded(value: Column, digits: int) -> Column:
    """A double rounded to one or two decimals by its exact binary value, true ties to even.

    Rounding the shortest decimal text instead takes 2.45, which lies a little above the tie, for a tie.  The scaled
    value is compared with the middle between its neighbours without error: each difference is between numbers that
    are at most twice one another.  Values from 2^52 on have no such decimals and stay.
    """
    size = F.abs(value)
    scale = 10 ** digits
    floor = F.floor(size * scale).cast("double")
    away = -(floor + 0.5)
    for multiple in _DOUBLINGS[digits]:
        away = away + size * multiple
    up = (away > 0) | ((away == 0) & (floor % 2 == 1))
    whole = F.when(up, floor + 1).otherwise(floor)
    return F.when(size * scale < 2.0 ** 52, F.signum(value) * whole / scale).otherwise(value)


def margin_percent(profit: Column, sales: Column) -> Column:
    """Margin in percent to one decimal, true ties to even; NULL unless sales are positive and profit is not 0."""
    percent = rounded(F.try_divide(as_double(profit), as_double(sales)) * 100, 1)
    return F.when((sales > 0) & (profit != 0), percent)


def margin_label(profit: Column, sales: Column) -> Column:
    """``12.3%`` or ``N/A``, as printed in the monthly report."""
    percent = margin_percent(profit, sales)
    return F.when(percent.isNull(), "N/A").otherwise(F.format_string("%.1f%%", percent))


def money_label(amount: Column, prefix: str = "$") -> Column:
    """``$1.2M``, ``$3.4K``, ``$12.00`` or ``N/A``; only amounts from 1,000 up are shortened, true ties go to even."""
    number = as_double(amount)

    def shown(form: str, value: Column, digits: int) -> Column:
        return F.format_string(prefix + form, rounded(value, digits))

    return (
        F.when(number.isNull(), "N/A")
        .when(number >= 1_000_000, shown("%.1fM", number / 1_000_000, 1))
        .when(number >= 1_000, shown("%.1fK", number / 1_000, 1))
        .otherwise(shown("%,.2f", number, 2))
    )
