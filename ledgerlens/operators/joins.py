"""Left joins whose keys may be hot.

``split_join`` compares a hash of the key beside the key itself.  The join's partitioning is then not one that a later aggregate
by the key can reuse, so adaptive execution may split a hot partition, and the aggregate gets its own exchange behind
a partial aggregate (a hot key costs one row per task).  ``spread_nulls`` gives each row without a key a key of its own
that matches nothing, so such rows don't meet in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Merge join on ``left_key = right_key`` (column names that differ) of two sides as large as facts are."""
    l, r = left[left_key], right[right_key]
    return left.join(right.hint("merge"), (F.xxhash64(l) == F.xxhash64(r)) & (l == r), how)


def spread_nulls(key: Column, unique: Column) -> Column:
    """A text key, or for null one that no text without control characters equals."""
    return F.coalesce(key, F.concat(F.lit("\x00"), unique.cast("string")))
