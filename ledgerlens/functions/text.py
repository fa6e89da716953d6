"""String predicates that keep SQL semantics and still reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column


def like_pushable(c: Column, pattern: str) -> Column:
    """``c LIKE pattern`` plus ``contains`` of every literal fragment.

    Spark pushes ``contains`` into the parquet scan (dictionary filtering
    can then skip row groups of a low-cardinality column) but not a general
    ``LIKE``.  Each fragment between wildcards (``%`` and the one-character
    ``_``) must occur in any match, so the extra conjuncts never change the
    result; the exact ``LIKE`` stays as the final test.
    """
    out = None
    for frag in re.split(r"[%_]", pattern):
        if frag:
            cond = c.contains(frag)
            out = cond if out is None else out & cond
    exact = c.like(pattern)
    return exact if out is None else out & exact
