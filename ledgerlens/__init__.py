"""ledgerlens — monthly unit-economics marts on Spark DataFrames.

Layout:
  sources/    domain-table adapters, GeoJSON reader, mart sink
  functions/  column-level helpers (local time, rate cards, money)
  operators/  reusable relational operators (spines, period bucketing,
              overlap expansion, valid-time joins, code pivots)
  plans/      the marts, extracts, dimensions and BI datasets
"""

__all__ = ["session"]
