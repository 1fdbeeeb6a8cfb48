"""Numeric expressions with the missing-value rules of the time-series operators: missing is NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN becomes NULL (for every ingest)."""
    return F.when(~F.isnan(x), x)


def lenient_double(text: Column) -> Column:
    """A number, or NULL where the text is none."""
    return known(F.trim(text).try_cast("double"))


def at_least_zero(x: Column) -> Column:
    """max(x, 0), missing where x is."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def mean_of(columns: list[Column]) -> Column:
    """Row-wise mean over the known values."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))
    return F.try_divide(total, n)


def median_of(columns: list[Column]) -> Column:
    """Row-wise median over the known values."""
    values = F.array_sort(F.filter(F.array(*columns), lambda x: x.isNotNull()))
    n = F.size(values)
    low, high = F.try_element_at(values, ((n + 1) / 2).cast("int")), F.try_element_at(values, (n / 2 + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def all_known(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))


def day_category(holiday: Column, bridge: Column, weekend: Column) -> Column:
    """First match: holiday, bridge day, weekend, else normal workday."""
    return F.when(holiday == 1, "holiday").when(bridge == 1, "bridge day").when(weekend == 1, "weekend").otherwise("normal workday")
