"""Local time, cool-off flag, rate card, card-fee brackets, valid-time join."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.rates import card_fee_pct, shares
from ledgerlens.functions.timeops import LOCAL_TZ, to_local, withdrawal_flag
from ledgerlens.operators.validity import valid_time_join

from .conftest import ts


def test_to_local_dst_both_paths(spark):
    """T7: both conversion paths agree, including around DST changes."""
    instants = ["2018-11-04 02:59:59", "2018-11-04 03:00:00", "2018-11-04 03:00:01",
                "2018-02-18 01:59:59", "2018-02-18 02:00:00", "2018-02-18 02:00:01",
                "1997-10-06 02:59:59.5", "2001-06-01 12:00:00"]
    df = spark.createDataFrame([(ts(x),) for x in instants], "t timestamp_ntz")
    got = df.select(to_local("t").alias("a"),
                    F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    # 2018-11-04 03:00 UTC is 00:00 local daylight time (UTC-2), one second before it is 23:59:59 standard time
    assert got[0].a == ts("2018-11-03 23:59:59") and got[1].a == ts("2018-11-04 01:00:00")


@pytest.mark.parametrize("direct,cancel_offset,expected", [
    (True, dt.timedelta(days=15) - dt.timedelta(seconds=1), True),
    (True, dt.timedelta(days=15), False),
    (False, dt.timedelta(days=8) - dt.timedelta(seconds=1), True),
    (False, dt.timedelta(days=8), False),
    (None, dt.timedelta(days=8) - dt.timedelta(seconds=1), True),   # NULL channel -> 8-day rule
    (None, dt.timedelta(days=9), False),
    (True, -dt.timedelta(seconds=1), False),                          # cancelled before subscribing
    (True, dt.timedelta(0), True),
    (True, None, None),                                               # never cancelled
])
def test_withdrawal_flag(spark, direct, cancel_offset, expected):
    sub = ts("2000-03-01 10:00:00")
    can = None if cancel_offset is None else sub + cancel_offset
    df = spark.createDataFrame([(sub, can, direct)], "subscribed_at timestamp_ntz, canceled_at timestamp_ntz, direct_channel boolean")
    assert df.select(withdrawal_flag().alias("w")).first().w is expected


K = Decimal("0.9262")


@pytest.mark.parametrize("plan,partner,rs,expected", [
    (9, 15, Decimal("12.50"), (1, 0, 0)),
    (20, 15, Decimal("12.50"), (Decimal("0.875"), Decimal("0.125"), 0)),
    (20, 15, None, (1, 0, 0)),
    (40, 15, Decimal("12.50"), (Decimal("0.20") * K, Decimal("0.35") * K, Decimal("0.45") * K)),
    (61, 383, None, (Decimal("0.15") * K, Decimal("0.40") * K, Decimal("0.45") * K)),
    (40, 177, None, (Decimal("0.23") * K, Decimal("0.35") * K, Decimal("0.42") * K)),
    (40, 999, None, (0, 0, 0)),
    (None, 15, Decimal("10.00"), (Decimal("0.20") * K, Decimal("0.35") * K, Decimal("0.45") * K)),  # Q5
    (40, None, None, (0, 0, 0)),
])
def test_revenue_split(spark, plan, partner, rs, expected):
    df = spark.createDataFrame([(plan, partner, rs)], "plan_id int, partner_id int, rs decimal(5,2)")
    s = shares(F.col("plan_id"), F.col("partner_id"), F.col("rs"))
    row = df.select(*[c.alias(n) for n, c in s.items()]).first()
    assert (row.house_share, row.partner_share, row.insurer_share) == tuple(Decimal(x) for x in expected)


@pytest.mark.parametrize("installments,pct", [(None, "2.55"), (0, "2.21"), (-1, "2.21"), (1, "1.87"), (3, "2.21"),
                                              (4, "2.32"), (6, "2.32"), (7, "2.55"), (12, "2.55")])
def test_card_fee_brackets(spark, installments, pct):
    """Q13: zero / negative installments land in the <= 3 bracket; NULL pays the top rate."""
    df = spark.createDataFrame([(installments,)], "i int")
    assert df.select(card_fee_pct(F.col("i")).alias("p")).first().p == Decimal(pct)


def test_valid_time_join(spark):
    """Q8/Q9: open ends, finish day inclusive to 23:59:58 (exclusive 23:59:59), overlaps fan out."""
    dim = spark.createDataFrame([
        (1, 10, None, ts("1999-12-31 00:00:00")),
        (1, 20, ts("2000-01-01 00:00:00"), None),
        (2, 30, ts("2000-01-01 00:00:00"), ts("2000-06-30 00:00:00")),
        (2, 31, ts("2000-06-01 00:00:00"), None),
    ], "k int, v int, b timestamp_ntz, f timestamp_ntz")
    facts = spark.createDataFrame([
        (0, 1, ts("1999-12-31 23:59:58")), (1, 1, ts("1999-12-31 23:59:59")), (2, 1, ts("2000-01-01 00:00:00")),
        (3, 2, ts("2000-06-15 00:00:00")), (4, 2, ts("1999-01-01 00:00:00")), (5, 1, None), (6, 3, ts("2000-01-01 00:00:00")),
    ], "id int, fk int, p timestamp_ntz")
    got = sorted((r.id, r.v) for r in valid_time_join(facts, dim, "fk", "k", "p", "b", "f").collect())
    assert got == [(0, 10), (1, None), (2, 20), (3, 30), (3, 31), (4, None), (5, None), (6, None)]


def test_geojson_reader(spark):
    import os

    from ledgerlens.plans.geo import geo_features, geo_properties, geo_vertices
    from ledgerlens.sources.geojson import read_feature_collections

    here = os.path.join(os.path.dirname(__file__), "fixtures")
    fc = read_feature_collections(spark, os.path.join(here, "zones_a.geojson"), os.path.join(here, "zones_b.geojson"))
    feats = sorted((r.source.rsplit("/", 1)[-1], r.feature_index, r.name, r.ring_count)
                   for r in geo_features(fc).collect())
    assert feats == [("zones_a.geojson", 0, "Harbour", 1), ("zones_a.geojson", 1, "Hill", 1),
                     ("zones_b.geojson", 0, None, 1)]
    verts = geo_vertices(fc).groupBy("source", "feature_index").count().collect()
    assert sorted(r["count"] for r in verts) == [4, 4, 5]
    props = {(r.key, r.value) for r in geo_properties(fc).collect()}
    assert ("stroke-width", "3") in props and ("Area Name", "Harbour") in props


def test_point_in_zone(spark):
    from ledgerlens.plans.geo import inside

    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0], [0.0, 0.0]]  # concave
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 2.0), (3.5, 3.0), (5.0, 1.0), (0.5, 3.0)], "x double, y double")
    got = [r.i for r in df.select(inside(F.col("x"), F.col("y"), F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ring])).alias("i")).collect()]
    assert got == [True, False, True, False, True]


def test_like_pushable_keeps_wildcard_semantics(spark):
    """`_` is a one-character wildcard: 'repairXfee' matches '%repair_fee%'."""
    from ledgerlens.functions.text import like_pushable

    df = spark.createDataFrame([("repair_fee",), ("overdue_repair_fee",), ("repairXfee",), ("repair",), (None,)], "r string")
    got = sorted(r.r for r in df.filter(like_pushable(F.col("r"), "%repair_fee%")).collect())
    assert got == ["overdue_repair_fee", "repairXfee", "repair_fee"]
