"""Period spine arithmetic, point bucketing and overlap expansion.

The arithmetic operators are checked against brute force over the spine's
periods (the literal cross join + range predicate of the source).
"""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from ledgerlens.operators.spine import Spine, bucket_point, explode_overlap

from .conftest import ts

AS_OF = dt.datetime(2001, 12, 15)


def periods(spine: Spine):
    """Python brute force: (start, end) of every period."""
    out = []
    for k in range(spine.periods):
        if spine.monthly:
            m = spine.start.month - 1 + k * spine.step
            s = dt.datetime(spine.start.year + m // 12, m % 12 + 1, spine.start.day)
            m2 = m + spine.step
            e = dt.datetime(spine.start.year + m2 // 12, m2 % 12 + 1, spine.start.day)
        else:
            s = dt.datetime.combine(spine.start, dt.time()) + dt.timedelta(days=k * spine.step)
            e = s + dt.timedelta(days=spine.step)
        out.append((s, e - dt.timedelta(seconds=1)))
    return out


@pytest.mark.parametrize("unit,n,expected", [("month", 1, 84), ("semester", 1, 14), ("year", 1, 7),
                                             ("month", 5, 17), ("week", 2, 182), ("day", 30, 85)])
def test_spine_lengths(spark, unit, n, expected):
    sp = Spine(dt.date(1995, 1, 1), AS_OF, unit, n)
    assert sp.periods == expected
    rows = sp.frame(spark).orderBy("start_interval").collect()
    assert [(r.start_interval, r.end_interval) for r in rows] == periods(sp)


def test_spine_rejects_bad_parameters():
    with pytest.raises(ValueError):
        Spine(dt.date(2016, 1, 31), AS_OF, "month", 1)
    with pytest.raises(ValueError):
        Spine(dt.date(2016, 1, 1), AS_OF, "fortnight", 1)
    with pytest.raises(ValueError):
        Spine(dt.date(2016, 1, 1), AS_OF, "day", 0)


EDGE_POINTS = [
    "1997-03-31 23:59:58.999", "1997-03-31 23:59:59", "1997-03-31 23:59:59.5", "1997-04-01 00:00:00",
    "1994-12-31 23:59:00", "1995-01-01 00:00:00", "2001-12-31 23:00:00", "2002-01-01 00:00:00", None,
]


def _points_df(spark, values):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("t", T.TimestampNTZType())])
    return spark.createDataFrame([(i, ts(v) if isinstance(v, str) or v is None else v) for i, v in enumerate(values)],
                                 schema)


def brute_bucket(spine, values):
    out = set()
    for i, v in enumerate(values):
        v = ts(v) if isinstance(v, str) or v is None else v
        if v is None:
            continue
        for s, e in periods(spine):
            if s <= v < e:
                out.add((i, s, e))
    return out


@pytest.mark.parametrize("unit,n,start", [("month", 1, "1995-01-01"), ("semester", 1, "1995-01-01"),
                                          ("month", 2, "1995-03-15"), ("week", 1, "1995-01-02"),
                                          ("day", 3, "1995-01-01")])
def test_bucket_point_matches_cross_join(spark, unit, n, start):
    sp = Spine(dt.date.fromisoformat(start), AS_OF, unit, n)
    rnd = random.Random(7)
    values = list(EDGE_POINTS)
    base = dt.datetime(1994, 11, 1)
    for _ in range(300):
        values.append(base + dt.timedelta(seconds=rnd.randrange(0, 86400 * 365 * 8)))
    # end-of-period seconds of a few periods, exactly and just after
    for s, e in periods(sp)[:5]:
        values += [e, e + dt.timedelta(microseconds=500000), e - dt.timedelta(microseconds=1)]
    got = {(r.id, r.start_interval, r.end_interval)
           for r in bucket_point(_points_df(spark, values), "t", sp).collect()}
    assert got == brute_bucket(sp, values)


def test_bucket_point_gap_second(spark):
    """Q1: an event in the last second of a month belongs to no month."""
    sp = Spine(dt.date(1995, 1, 1), AS_OF, "month", 1)
    got = {r.id for r in bucket_point(_points_df(spark, EDGE_POINTS), "t", sp).collect()}
    assert got == {0, 3, 5, 6}


def _spans_df(spark, spans):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("lo", T.TimestampNTZType()),
                           T.StructField("hi", T.TimestampNTZType())])
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], schema)


@pytest.mark.parametrize("unit,n", [("month", 1), ("year", 1), ("week", 1), ("day", 10)])
def test_explode_overlap_matches_cross_join(spark, unit, n):
    """Q2/Q33: inclusive overlap; NULL, reversed and out-of-spine spans give no rows."""
    sp = Spine(dt.date(1995, 1, 2) if unit == "week" else dt.date(1995, 1, 1), AS_OF, unit, n)
    rnd = random.Random(11)
    spans = [(ts("1997-03-31 23:59:59.5"), ts("1997-04-10 00:00:00")),   # starts in the gap second
             (ts("1997-03-31 23:59:59"), ts("1997-03-31 23:59:59")),     # exactly the period end
             (ts("1997-05-10 00:00:00"), ts("1997-05-01 00:00:00")),     # reversed
             (None, ts("1997-05-01 00:00:00")), (ts("1997-05-01 00:00:00"), None),
             (ts("1990-01-01 00:00:00"), ts("1994-06-01 00:00:00")),     # before the spine
             (ts("2003-01-01 00:00:00"), ts("2004-01-01 00:00:00")),     # after as_of
             (ts("1994-01-01 00:00:00"), ts("2005-01-01 00:00:00"))]     # covers everything
    base = dt.datetime(1994, 6, 1)
    for _ in range(200):
        a = base + dt.timedelta(seconds=rnd.randrange(0, 86400 * 365 * 8))
        spans.append((a, a + dt.timedelta(seconds=rnd.randrange(-86400 * 20, 86400 * 400))))
    got = {(r.id, r.start_interval) for r in explode_overlap(_spans_df(spark, spans), "lo", "hi", sp).collect()}
    want = {(i, s) for i, (a, b) in enumerate(spans) if a is not None and b is not None
            for s, e in periods(sp) if a <= e and b >= s}
    assert got == want
