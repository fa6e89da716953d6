"""Valid-time (as-of range) dimension join.

A fact row at instant ``probe`` matches the dimension rows of its key whose
validity window contains it: ``begin <= probe < finish + 1 day - 1 second``
with NULL ``begin`` / ``finish`` meaning open-ended.  A NULL probe matches
nothing.  Written as an equi-join with a residual predicate, so Spark keeps
a hash join on the key (broadcast for a small dimension, sort-merge
otherwise) and evaluates the window per matching pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_contains(probe: Column, begin: Column, finish: Column) -> Column:
    return ((probe >= F.coalesce(begin, probe))
            & (probe < F.coalesce(finish + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND"),
                                  probe + F.expr("INTERVAL 1 SECOND"))))


def valid_time_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, probe: str,
                    begin: str, finish: str, how: str = "left") -> DataFrame:
    """Join ``dim`` rows valid at ``fact[probe]``; column names must not clash."""
    cond = (F.col(fact_key) == F.col(dim_key)) & window_contains(F.col(probe), F.col(begin), F.col(finish))
    return fact.join(dim, cond, how)


BIN_DAYS = 32
MOST_BINS = 16


def _bin(t: Column, bin_days: int) -> Column:
    return F.floor(F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")) / F.lit(bin_days))


def window_index(dim: DataFrame, key: str, begin: str, finish: str, bin_days: int = BIN_DAYS) -> tuple[DataFrame, DataFrame]:
    """(``i_key``, ``i_bin``, ``i_windows``) of the short windows and (``l_key``, ``l_windows``) of long and open ones."""
    row = F.struct(*[F.col(c) for c in dim.columns]).alias("w")
    first, last = _bin(F.col(begin), bin_days), _bin(F.col(finish) + F.expr("INTERVAL 1 DAY"), bin_days)
    known = dim.filter(F.col(key).isNotNull())
    short = F.coalesce((last >= first) & (last - first < MOST_BINS), F.lit(False))
    binned = known.filter(short).select(F.col(key).alias("i_key"), F.explode(F.sequence(first, last)).alias("i_bin"), row)
    long = known.filter(~short).select(F.col(key).alias("l_key"), row)
    return (binned.groupBy("i_key", "i_bin").agg(F.collect_list("w").alias("i_windows")),
            long.groupBy("l_key").agg(F.collect_list("w").alias("l_windows")))


def indexed_valid_time_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, probe: str, begin: str, finish: str,
                            bin_days: int = BIN_DAYS) -> DataFrame:
    """:func:`valid_time_join` (left) through a :func:`window_index`; same columns, same rows."""
    binned, long = window_index(dim, dim_key, begin, finish, bin_days)
    j = fact.withColumn("i_probe", _bin(F.col(probe), bin_days))
    j = j.join(binned, (F.col(fact_key) == F.col("i_key")) & (F.col("i_probe") == F.col("i_bin")), "left")
    j = j.join(long, F.col(fact_key) == F.col("l_key"), "left")
    none = F.array().cast(binned.schema["i_windows"].dataType)
    near = F.concat(F.coalesce("i_windows", none), F.coalesce("l_windows", none))
    valid = F.filter(near, lambda w: window_contains(F.col(probe), w[begin], w[finish]))
    return j.select(*fact.columns, F.explode_outer(valid).alias("w")).select(*fact.columns, *[F.col(f"w.{c}").alias(c) for c in dim.columns])
