"""Aggregates with integer rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_mean(x) -> Column:
    """Mean by integer division; 0 of nothing."""
    return F.coalesce(F.floor(F.sum(_c(x)) / F.when(F.count(_c(x)) > 0, F.count(_c(x)))), F.lit(0)).cast("long")


def upper_median(x) -> Column:
    """The element in the middle, of two the upper one."""
    ordered = F.array_sort(F.collect_list(_c(x)))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def percentile(x, p: float) -> Column:
    """The element at place ``int(n * p)`` of the sorted values."""
    ordered = F.array_sort(F.collect_list(_c(x)))
    return F.get(ordered, F.least(F.floor(F.size(ordered) * p).cast("int"), F.size(ordered) - 1))


def int_mean_deviation(x) -> Column:
    """Population standard deviation around the integer mean, from sums alone: one pass, combined before the shuffle."""
    x = _c(x).cast("long")
    n, total, squares = F.count(x), F.sum(x), F.sum(x * x)
    mean = F.floor(total / F.when(n > 0, n))
    return F.sqrt((squares - 2 * mean * total + n * mean * mean) / F.when(n > 0, n))
