"""Null rules that differ between data frames on one machine and SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def differs(column: Column, value) -> Column:
    """`column != value` that keeps null rows."""
    return ~column.eqNullSafe(F.lit(value))


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def sum_or_zero(column: Column) -> Column:
    """Sum whose value over only nulls is 0."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def tristate(difference: Column) -> Column:
    """1 above zero, 0 below zero, null at zero or null."""
    return F.when(difference > 0, F.lit(1)).when(difference < 0, F.lit(0))


def nonnull_count(*columns: Column) -> Column:
    """How many of the columns hold a value, per row."""
    total = F.lit(0)
    for column in columns:
        total = total + column.isNotNull().cast("int")
    return total
