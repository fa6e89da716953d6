"""Code pivots: one aggregate column per code value (``sum(case when ...)``).

Generated from a code map so that every family of per-issue columns uses
one rule.  Two NULL conventions exist in the source and both are kept:

* ``match="eq"``   -> ``CASE WHEN code = k THEN v ELSE other END``
  (a NULL code counts in no column)
* ``match="ne"``   -> ``CASE WHEN code <> k THEN other ELSE v END``
  (a NULL code counts in *every* column)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_cases(code: Column, value: Column | Callable[[int], Column], codes: dict[str, int],
               other: Column | None = None, match: str = "eq") -> dict[str, Column]:
    other = F.lit(0) if other is None else other
    out = {}
    for name, k in codes.items():
        v = value(k) if callable(value) else value
        if match == "eq":
            out[name] = F.when(code == k, v).otherwise(other)
        elif match == "ne":
            out[name] = F.when(code != k, other).otherwise(v)
        else:
            raise ValueError(match)
    return out
