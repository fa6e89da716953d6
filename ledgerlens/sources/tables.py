"""Reading the real business tables into a :class:`Domain`.

The marts only need DataFrames with the columns of ``FIXTURES.md`` §1.  In
production they come from a lake (one parquet / table folder per table) or
straight from the operational database through Spark's JDBC source with a
partitioned read (many parallel range scans instead of one connection).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .fixtures import TABLES, Domain


def domain_from_parquet(spark: SparkSession, root: str, tables: tuple[str, ...] = TABLES) -> Domain:
    """One folder per table under ``root`` (``root/orders``, ``root/payments``, ...)."""
    root = root.rstrip("/")
    return Domain.from_tables(spark, {t: spark.read.parquet(f"{root}/{t}") for t in tables})


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              fetch_size: int = 10_000, properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC read: ``num_partitions`` range scans on a numeric key.

    Filters and projections applied to the result are pushed into the
    generated SQL by Spark; without a partition column the read is a single
    connection and should be reserved for small dimension tables.
    """
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("fetchsize", str(fetch_size)))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds of the partition column")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", str(lower))
                  .option("upperBound", str(upper)).option("numPartitions", str(num_partitions)))
    return reader.load()
