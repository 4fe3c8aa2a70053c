"""Aggregate expressions. All of them combine map-side, except the distinct count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gamelog.functions.scalars import floor_at, ratio, ratio_or_zero


def total(value: Column) -> Column:
    """Sum in which an empty or all-NULL group is 0."""
    return F.coalesce(F.sum(value), F.lit(0))


def total_where(value: Column, condition: Column) -> Column:
    return total(F.when(condition, value))


def share(condition: Column) -> Column:
    """Mean of a flag over the rows where it is known."""
    return F.avg(condition.cast("int"))


def percent_of(condition: Column, counted: Column) -> Column:
    """100 x hits / non-NULL ``counted`` values; 0 where nothing was counted."""
    return ratio_or_zero(F.lit(100.0) * F.count_if(condition), F.count(counted))


def success_rate(success: Column, attempt: Column) -> Column:
    """Successes among attempts, with at least one attempt assumed."""
    return ratio(F.count_if(success & attempt), floor_at(F.count_if(attempt)))


def distinct_with_null(value: Column) -> Column:
    """Number of distinct values, NULL counted as one of them."""
    return F.count_distinct(value) + F.max(value.isNull().cast("int"))
