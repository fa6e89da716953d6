"""Marts on hand-made rows: fan-out, NULL rules and swap resolution."""

import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens.operators.spine import Spine
from ledgerlens.plans import device, fees, service
from ledgerlens.sources.fixtures import Domain

from .conftest import ts

SR = ("id bigint, order_id bigint, issue_id int, arrived_at timestamp_ntz, swapped_at timestamp_ntz, "
      "closed_at timestamp_ntz, tracked_at timestamp_ntz, payment_reference string, "
      "user_service_requests_count int, order_service_requests_count int")
SPINE = Spine(dt.date(2000, 1, 1), dt.datetime(2000, 7, 15), "month", 1)


def sr_row(i, order, issue, arrived=None, swapped=None, closed=None, ref=None):
    return (i, order, issue, ts(arrived), ts(swapped), ts(closed), None, ref, 1, 1)


@pytest.fixture(scope="module")
def severity_rows(spark):
    dom = Domain.from_tables(spark, {
        "service_requests": spark.createDataFrame([
            sr_row(1, 1, 1, swapped="2000-03-10 12:00:00"),
            sr_row(2, 1, None, swapped="2000-03-11 12:00:00"),
            sr_row(3, 2, 4, swapped="2000-03-20 12:00:00"),
            sr_row(4, 2, 4, swapped="2000-03-31 23:59:59.5"),   # local 20:59 -> still March
            sr_row(5, 3, 1, swapped=None),
        ], SR),
        "repairs": spark.createDataFrame([(1, 28), (1, 28), (3, 5)], "service_request_id bigint, repair_shop_id int"),
        "rel_service_request_costs": spark.createDataFrame([
            (1, Decimal("10"), Decimal("100"), Decimal("50")), (1, Decimal("5"), Decimal("0"), Decimal("0")),
            (3, None, None, None),
        ], "service_request_id bigint, repair_cost decimal(18,2), invoice_in_value decimal(18,2), invoice_out_value decimal(18,2)"),
        "service_request_postings": spark.createDataFrame([
            (1, Decimal("21"), Decimal("26")), (1, None, Decimal("27")),
        ], "service_request_id bigint, from_customer_value decimal(18,2), from_house_value decimal(18,2)"),
    })
    return {r.order_id: r for r in service.mart_severity(dom, SPINE).collect()}


def test_severity_fan_out(severity_rows):
    """Q16/Q17: 2 cost x 2 posting rows multiply sums and counts; a missing posting costs 35 each way."""
    r = severity_rows[1]
    assert r.start_interval == dt.date(2000, 3, 1) and r.end_interval == dt.date(2000, 3, 31)
    assert r.repair_cost == -30.0 and r.repair_cost_screen == -30.0 and r.repair_cost_theft == 0.0
    assert r.swap_cost == 100.0
    assert r.inbound_logistic_cost == -147.0 and r.outbound_logistic_cost == -141.0
    assert r.severity_tax_credit == pytest.approx(-6.475)
    assert r.swapped_sr == 5 and r.swapped_sr_screen == 4
    assert r.inhouse_sr == 4 and r.inhouse_sr_screen == 4


def test_severity_null_rules(severity_rows):
    """Q18: an all-NULL group sums to NULL; a per-issue column is NULL only when every row has that issue."""
    r = severity_rows[2]
    assert r.repair_cost is None and r.repair_cost_theft is None and r.repair_cost_screen == 0.0
    assert r.severity_tax_credit is None
    assert r.inbound_logistic_cost == -70.0 and r.swapped_sr == 2 and r.inhouse_sr == 0
    assert 3 not in severity_rows


def test_sr_monthly_count_gap_second(spark):
    dom = Domain.from_tables(spark, {"service_requests": spark.createDataFrame([
        sr_row(1, 1, 1, arrived="2000-04-01 02:59:59"),    # local 23:59:59 on 31 March: no month (Q1)
        sr_row(2, 1, 2, arrived="2000-04-01 03:00:00"),    # local midnight 1 April
        sr_row(3, 1, None, arrived="2000-04-02 00:00:00"),
    ], SR)})
    rows = service.mart_sr_monthly_count(dom, SPINE).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.start_interval == dt.date(2000, 4, 1) and r["count"] == 2
    assert (r.arrived_count_screen, r.arrived_count_water, r.arrived_count_slm, r.arrived_count_theft) == (0, 1, 0, 0)


def test_fee_revenue_null_issue_and_rejoin(spark):
    """Q10/Q11/Q32: the bucket uses the first swap, the re-join adds one row per request,
    and a NULL issue counts in every per-issue column."""
    dom = Domain.from_tables(spark, {
        "payments": spark.createDataFrame([
            (1, 1, ts("2000-02-01 00:00:00"), "repair_fee", Decimal("100"), "r1", 1),
            (2, 2, ts("2000-02-01 00:00:00"), "repair_fee", Decimal("0"), "r2", 1),
            (3, 3, ts("2000-02-01 00:00:00"), "repair_fee", Decimal("50"), "r3", 1),
        ], "id bigint, order_id bigint, created_at timestamp_ntz, reason string, value decimal(18,2), psp_reference string, installments int"),
        "service_requests": spark.createDataFrame([
            sr_row(10, 1, None, swapped="2000-03-05 12:00:00", ref="r1"),
            sr_row(11, 1, 2, swapped="2000-04-02 12:00:00", ref="r1"),
            sr_row(12, 2, 4, swapped="2000-03-06 12:00:00", ref="r2"),
            sr_row(13, 3, 4, swapped="2000-03-06 12:00:00", ref="r3"),
        ], SR),
        "orders": spark.createDataFrame([(1, 20), (2, 40), (3, 61)], "id bigint, plan_id int"),
        "store_orders": spark.createDataFrame([(1, Decimal("33.00")), (2, Decimal("33.00")), (3, Decimal("33.00"))],
                                              "order_id bigint, total_price decimal(18,2)"),
    })
    rows = {r.order_id: r for r in fees.mart_fee_revenue(dom, SPINE).collect()}
    r = rows[1]
    assert r.start_interval == dt.date(2000, 3, 1)
    assert r.fee_rev == 200.0
    assert (r.fee_rev_screen, r.fee_rev_water, r.fee_rev_slm, r.fee_rev_theft) == (100.0, 200.0, 100.0, 100.0)
    assert r.insurer_fee_cost == 0.0 and r.fee_tax == pytest.approx(-18.5)
    assert rows[2].fee_rev == 0.0 and rows[2].insurer_fee_cost == 0.0          # RFQ rule needs value > 0
    assert rows[3].fee_rev == pytest.approx(70.0)                              # phone price 100 x 0.70 (theft)
    assert rows[3].rf_insurer_fee_cost == pytest.approx(20.0)


def test_device_product_resolution(spark):
    """Q19-Q21: first swap in month -> smallest swap; later months -> largest swap of all time;
    a swap exactly at the month start keeps the order's product."""
    dom = Domain.from_tables(spark, {
        "orders": spark.createDataFrame([(1, 100, ts("2000-01-10 12:00:00"), None), (2, 100, None, None)],
                                        "id bigint, produto_id bigint, subscribed_at timestamp_ntz, canceled_at timestamp_ntz"),
        "service_requests": spark.createDataFrame([
            sr_row(50, 1, 1, arrived="2000-02-01 12:00:00", closed="2000-02-05 12:00:00"),
            sr_row(51, 1, 1, arrived="2000-02-10 12:00:00"),
        ], SR),
        "device_swaps": spark.createDataFrame([
            (5, 50, ts("2000-03-15 12:00:00"), 10, 11), (9, 51, ts("2000-05-01 03:00:00"), 12, 13),
        ], "id bigint, service_request_id bigint, created_at timestamp_ntz, old_device_id bigint, new_device_id bigint"),
        "devices": spark.createDataFrame([(10, 200), (11, 201), (12, 300), (13, 301)], "id bigint, product_id bigint"),
        "produtos": spark.createDataFrame([(200, "a", 1), (201, "b", 1), (300, "c", 1), (301, "d", 1)],
                                          "id bigint, modelo string, marca_id int"),
    })
    got = sorted((r.start_interval.month, r.product_id) for r in device.mart_active_device_product(dom, SPINE).collect()
                 if r.o_id == 1)
    assert got == [(1, 200), (2, 200), (3, 200), (4, 300), (5, 100), (6, 301), (7, 301)]
