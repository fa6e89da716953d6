"""Money arithmetic that gives the same digits in every engine.

Amounts are DECIMAL(18,2); sums of decimals are exact and independent of summation order, so partial/final aggregation
across any number of tasks gives one answer.  Rules that divide (``/ 12``, ``/ 0.33``) sum undivided amounts and divide each
sum once (:func:`ratio_fine`), rounded half up at ten decimals.  Averages are ``sum / count`` computed in DOUBLE from the exact
decimal sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,10)"


def dec(value, precision: int = 18, scale: int = 2) -> Column:
    return F.lit(str(value)).cast(f"decimal({precision},{scale})")


def ratio_fine(c: Column, num: int, den: int = 1) -> Column:
    """``c * den / num`` rounded half up at ten decimals, DECIMAL(38,10)."""
    wide = (c * F.lit(den)).cast(WIDE) if den != 1 else c.cast(WIDE)
    return (wide / F.lit(num)).cast(WIDE)


def share_of_sum(c: Column, num: int) -> Column:
    """``sum(c) / num`` of undivided amounts, as DOUBLE."""
    return ratio_fine(F.sum(c), num).cast("double")
