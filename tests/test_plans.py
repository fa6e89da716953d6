"""Plan-shape guards: what the optimizer must (not) produce at scale."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest

from ledgerlens import registry
from ledgerlens.operators.spine import Spine
from ledgerlens.plans import fees, service
from ledgerlens.sources.tables import domain_from_parquet

from .test_marts import SR, sr_row
from .conftest import ts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def scale_plans(spark):
    """Physical plans of every query with broadcasting disabled (large-table shape)."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return {n: _plan(fn(spark, "/root/testdata/sf0.001")) for n, fn in registry.queries().items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_cartesian_or_nested_loop_joins(scale_plans):
    bad = {n for n, p in scale_plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert bad == set()


def test_no_python_evaluation(scale_plans):
    bad = {n for n, p in scale_plans.items() if "EvalPython" in p or "PythonUDF" in p}
    assert bad == set()


def test_no_forced_repartitioning(scale_plans):
    assert {n for n, p in scale_plans.items() if "REPARTITION_BY_NUM" in p} == set()


def test_active_orders_are_not_expanded_to_months(scale_plans):
    assert "sequence(" not in scale_plans["bi_active_orders_by_month"]


def test_period_range_reaches_the_scan(spark):
    """A one-month mart pushes a range on the raw event time into the scan of real tables."""
    root = tempfile.mkdtemp(prefix="lake-")
    rows = [sr_row(1, 1, 1, arrived="2000-02-10 12:00:00", swapped="2000-02-11 00:00:00", ref="r1"),
            sr_row(2, 2, 2, arrived="2000-05-10 12:00:00", swapped="2000-05-11 00:00:00", ref="r2")]
    spark.createDataFrame(rows, SR).write.parquet(os.path.join(root, "service_requests"))
    spark.createDataFrame([(1, 1, ts("2000-02-01 12:00:00"), "repair_fee", Decimal("10"), "r1", 1),
                           (2, 1, ts("2000-02-29 23:30:00"), "subscription", Decimal("10"), "r2", 1)],
                          "id bigint, order_id bigint, created_at timestamp_ntz, reason string, value decimal(18,2), "
                          "psp_reference string, installments int").write.parquet(os.path.join(root, "payments"))
    dom = domain_from_parquet(spark, root, ("service_requests", "payments"))
    month = Spine(dt.date(2000, 2, 1), dt.datetime(2000, 2, 15), "month", 1)
    counted = service.mart_sr_monthly_count(dom, month)
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plans = [_plan(d) for d in (counted, service.swapped_requests(dom, month), fees.repair_fee_payments_by_period(dom, month))]
    spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "GreaterThanOrEqual(arrived_at,2000-01-31" in plans[0] and "LessThan(arrived_at,2000-03-03" in plans[0]
    assert counted.count() == 1
    swapped = service.swapped_requests(dom, month)
    assert "GreaterThanOrEqual(swapped_at,2000-01-31" in plans[1] and swapped.count() == 1
    fee = fees.repair_fee_payments_by_period(dom, month)
    assert fee.count() == 1  # requests are read whole: those of a reference are counted whenever they were swapped


def test_reason_filter_reaches_the_scan(spark):
    """On real tables the LIKE filter is pushed into the parquet scan."""
    root = tempfile.mkdtemp(prefix="lake-")
    spark.createDataFrame(
        [(1, 1, ts("2000-02-01 00:00:00"), "repair_fee", Decimal("10"), "r1", 1),
         (2, 1, ts("2000-02-01 00:00:00"), "subscription", Decimal("10"), "r2", 1)],
        "id bigint, order_id bigint, created_at timestamp_ntz, reason string, value decimal(18,2), "
        "psp_reference string, installments int").write.parquet(os.path.join(root, "payments"))
    spark.createDataFrame([("r1", "card")], "psp_reference string, payment_method string") \
        .write.parquet(os.path.join(root, "trackings"))
    spark.createDataFrame([sr_row(1, 1, 1, ref="r1")], SR).write.parquet(os.path.join(root, "service_requests"))
    dom = domain_from_parquet(spark, root, ("payments", "trackings", "service_requests"))
    df = fees.mart_fee_txn_cost(dom)
    plan = _plan(df)
    assert "StringContains(reason,repair)" in plan and "StringContains(reason,fee)" in plan
    assert df.count() == 1
