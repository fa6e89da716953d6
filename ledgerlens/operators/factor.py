"""Aggregates over many-to-many joins without the join.

Several rows on either side of a key multiply in a join, so a hot key costs the product of its rows.  Sums over such a product
don't need it: a sum of one side's column is that side's sum times the numbers of rows of the other sides.  :func:`side` folds
each side to one row per key (partial aggregation before its shuffle, so a hot key costs a row per task), :func:`attach` joins the
folded sides to the base, and :func:`copies` gives the number of product rows that a base row or a side's sum stands for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Row counts as decimals of scale 0: Spark keeps the scale of an amount (up to six decimals) in a product with them.
COUNT = "decimal(18,0)"


def side(df: DataFrame, key: str, name: str, **folds: Column) -> DataFrame:
    """One row per non-null ``key``: ``{name}_key``, its rows ``{name}_n`` and each of ``folds`` as ``{name}_{fold}``."""
    return (df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{name}_key"))
            .agg(F.count(F.lit(1)).alias(f"{name}_n"), *[c.alias(f"{name}_{n}") for n, c in folds.items()]))


def attach(base: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """``base`` with the folds of every side, null where a side has no row of the key; no base row is multiplied.

    Sides have as many keys as facts have, so they are merged, never broadcast: what follows runs in as many tasks as the shuffle
    has, however few files the base was read from.
    """
    return reduce(lambda left, right: left.join(right.hint("merge"), F.col(key) == F.col(right.columns[0]), "left").drop(right.columns[0]),
                  sides, base)


def copies(*names: str) -> Column:
    """Rows that the left joins with these sides would make of one row: the product of their numbers, at least one each."""
    return reduce(lambda a, b: (a * b).cast(COUNT), [F.coalesce(f"{n}_n", F.lit(1)).cast(COUNT) for n in names])


def sum_of_rows(value: Column, hits: Column, rows: Column) -> Column:
    """Sum over ``rows`` product rows of which ``hits`` bear ``value`` in total and the others 0; null as SQL's sum is."""
    return F.when(hits == 0, F.lit(0)).when(hits < rows, F.coalesce(value, F.lit(0))).otherwise(value)
