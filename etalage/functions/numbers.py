"""Rounding, means and text formats that do not depend on row order.

Averages of doubles change in the last bits with the order in which partial
sums are merged, so a retried task could change a published figure.  Means are
therefore taken over whole micro-units in a decimal sum, which is exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def half_up(value: Column, places: int) -> Column:
    """Round half up to ``places`` decimals with plain double arithmetic.

    A value so large that a double holds no such decimals stays as it is.
    """
    scaled = value * F.lit(float(10**places))
    rounded = F.floor(scaled + F.lit(0.5)) / F.lit(float(10**places))
    return F.when(F.abs(scaled) < F.lit(2.0**53), rounded).otherwise(value.cast("double"))


def micro_units(value: Column) -> Column:
    """The value in whole millionths, as a decimal that can be summed exactly."""
    scaled = value * F.lit(float(MICRO))
    small = F.floor(scaled + F.lit(0.5)).cast("decimal(28,0)")
    return F.when(F.abs(scaled) < F.lit(2.0**53), small).otherwise(scaled.cast("decimal(28,0)"))


def mean_of(total: Column, count: Column) -> Column:
    """Mean from a sum of micro-units and a count; null for an empty group."""
    return F.try_divide(total.cast("double"), count.cast("double")) / F.lit(float(MICRO))


def exact_mean(value: Column) -> Column:
    """Aggregate: mean of the non-null values, independent of their order."""
    return mean_of(F.sum(micro_units(value)), F.count(value))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error or infinity, for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * F.lit(100.0)


def fcfa_text(value: Column) -> Column:
    """``1 234 567 FCFA``, or ``-`` when there is no value."""
    grouped = F.replace(F.format_number(half_up(value, 0), 0), F.lit(","), F.lit(" "))
    return F.coalesce(F.concat(grouped, F.lit(" FCFA")), F.lit("-"))


def percent_text(value: Column) -> Column:
    """``12.3%``, or ``-`` when there is no value."""
    text = F.format_string("%.1f%%", half_up(value, 1))
    return F.when(value.isNull(), F.lit("-")).otherwise(text)
