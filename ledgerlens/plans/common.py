"""Shared output conventions of the marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import dec


def period_dates() -> list[Column]:
    """``start_interval::date, end_interval::date`` as in the source output."""
    return [F.col("start_interval").cast("date").alias("start_interval"),
            F.col("end_interval").cast("date").alias("end_interval")]


def dsum(c: Column) -> Column:
    """Exact decimal sum, reported as DOUBLE."""
    return F.sum(c).cast("double")


def count_if(cond: Column) -> Column:
    """``sum(case when cond then 1 else 0 end)`` — 0, never NULL, for a non-empty group."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def pct(value: str) -> Column:
    """A percent rate as an exact decimal fraction (``9.25`` -> 0.0925)."""
    from decimal import Decimal

    d = Decimal(value) / 100
    scale = max(-d.as_tuple().exponent, 0)
    return dec(str(d), scale + 1, scale)


def finish(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select(*order)
