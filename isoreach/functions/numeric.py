"""Sums and ratios with the missing-value rules of the accessibility formulas.

Spark's ANSI mode raises on division by zero, NaN poisons its sums and compares greater than every
number. The builders here give the intended result whatever the session's ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def number(column: str) -> Column:
    """A column as double, with NaN taken for missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def nan_safe_sum(value: Column) -> Column:
    """Sum that skips null and NaN, and is 0 when nothing is left."""
    return F.coalesce(F.sum(F.nanvl(value, F.lit(None).cast("double"))), F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """The value, or 0 for null, NaN and both infinities."""
    return F.when(F.abs(value) < F.lit(_INF), value).otherwise(F.lit(0.0))


def safe_ratio(numerator: Column, denominator: Column, zero: str = "inf") -> Column:
    """``numerator / denominator``.

    ``zero="inf"``: a zero denominator gives an infinity of the numerator's sign, and null for 0/0.
    ``zero="zero"``: whatever is not a finite number becomes 0.
    """
    ratio = F.try_divide(numerator, denominator)
    if zero == "zero":
        return finite_or_zero(ratio)
    return (
        F.when(denominator != 0.0, ratio)
        .when((denominator == 0.0) & (numerator > 0.0), F.lit(_INF))
        .when((denominator == 0.0) & (numerator < 0.0), F.lit(-_INF))
    )


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` where the denominator is a number above 0, else 0."""
    usable = (denominator > 0.0) & ~F.isnan(denominator)
    return F.when(usable, F.try_divide(numerator, denominator)).otherwise(F.lit(0.0))
