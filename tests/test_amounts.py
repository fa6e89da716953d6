"""Large amounts, rounding and the session's zone."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions.money import ratio_fine
from ledgerlens.functions.timeops import to_local
from ledgerlens.operators.spine import Spine
from ledgerlens.plans import fees, sales_revenue, service
from ledgerlens.sources.fixtures import Domain

from .conftest import ts
from .test_marts import SR, sr_row

SPINE = Spine(dt.date(2000, 1, 1), dt.datetime(2000, 3, 15), "month", 1)
PAY = ("id bigint, order_id bigint, created_at timestamp_ntz, reason string, value decimal(18,2), psp_reference string, "
       "installments int")
BIG = [Decimal("100000000.00"), Decimal("10000000000.01"), Decimal("9999999999999999.99")]


def domain(spark, pays, store_orders, requests=()):
    return Domain.from_tables(spark, {
        "payments": spark.createDataFrame(pays, PAY),
        "orders": spark.createDataFrame([(o, 40, False, Decimal("5.00"), ts("1999-12-01 00:00:00"), None) for o in range(1, 9)],
                                        "id bigint, plan_id int, direct_channel boolean, preco decimal(18,2), "
                                        "subscribed_at timestamp_ntz, canceled_at timestamp_ntz"),
        "store_orders": spark.createDataFrame(store_orders, "order_id bigint, store_id bigint, total_price decimal(18,2)"),
        "stores": spark.createDataFrame([(1, 15)], "id bigint, partner_id int"),
        "partners": spark.createDataFrame([(15,)], "id int"),
        "revenue_shares": spark.createDataFrame([], "partner_id int, value decimal(5,2), begin_at timestamp_ntz, finish_at timestamp_ntz"),
        "service_requests": spark.createDataFrame(list(requests) or [sr_row(1, 1, 1)], SR)})


def test_large_payments_and_sales(spark):
    pays = [(i, i, ts("2000-02-10 12:00:00"), "monthly_fee", v, f"p{i}", 1) for i, v in enumerate(BIG, 1)]
    pays += [(10 + i, i, ts("2000-03-10 12:00:00"), "subscription", Decimal("1.00"), f"s{i}", 1) for i, _ in enumerate(BIG, 1)]
    dom = domain(spark, pays, [(i, 1, v) for i, v in enumerate(BIG, 1)])
    got = {(r.order_id, r.start_interval.month): r.total_revenue for r in sales_revenue.mart_plan_revenue(dom, SPINE).collect()}
    for i, v in enumerate(BIG, 1):
        assert got[i, 2] == float(v)
        assert got[i, 3] == float((v / 12).quantize(Decimal("1e-10")))
    sold = {r.order_id: r.total_sale for r in sales_revenue.mart_sales(dom, SPINE).collect()}
    assert sold == {i: float(v) for i, v in enumerate(BIG, 1)}


def test_large_phone_price(spark):
    dom = domain(spark, [(1, 1, ts("2000-02-10 12:00:00"), "repair_fee", Decimal("7.00"), "r1", 1)], [(1, 1, Decimal("10000000.00"))],
                 [sr_row(1, 1, 4, swapped="2000-02-10 12:00:00", ref="r1")])
    price = (Decimal("10000000.00") * 100 / 33).quantize(Decimal("1e-10"))
    assert fees.mart_fee_revenue(dom, SPINE).first().fee_rev == float(price * Decimal("0.70"))


def test_severity_sums_beyond_two_to_the_53(spark):
    amounts = [Decimal("9999999999999.99")] * 4000
    dom = Domain.from_tables(spark, {
        "service_requests": spark.createDataFrame([sr_row(1, 1, 1, swapped="2000-02-10 12:00:00")], SR),
        "repairs": spark.createDataFrame([], "service_request_id bigint, repair_shop_id int"),
        "rel_service_request_costs": spark.createDataFrame(
            [(1, a, Decimal("0.01"), Decimal("0.02")) for a in amounts],
            "service_request_id bigint, repair_cost decimal(18,2), invoice_in_value decimal(18,2), invoice_out_value decimal(18,2)"),
        "service_request_postings": spark.createDataFrame([], "service_request_id bigint, from_customer_value decimal(18,2), "
                                                             "from_house_value decimal(18,2)")})
    row = service.mart_severity(dom, SPINE).first()
    assert row.repair_cost == -float(sum(amounts))
    assert row.severity_tax_credit == float(sum((a + Decimal("0.01")) * Decimal("0.0925") for a in amounts))


def test_division_rounds_half_up(spark):
    cents = [*range(0, 400), 10**15 + 7, -5, -7]
    rows = [(Decimal(c) / 100,) for c in cents]
    got = spark.createDataFrame(rows, "x decimal(18,2)").select(
        "x", ratio_fine(F.col("x"), 12).alias("a"), ratio_fine(F.col("x"), 33, 100).alias("b")).collect()
    for r in got:
        n = int(r.x * 100)
        for value, num, den in ((r.a, 12, 1), (r.b, 33, 100)):
            scaled = abs(n) * 10**8 * den
            want = (2 * scaled + num) // (2 * num)
            assert int(value * 10**10) == (want if n >= 0 else -want)


def test_zone_change_mid_session(spark):
    df = spark.createDataFrame([(ts("2018-11-04 01:30:00"),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert df.select(to_local("t").alias("l")).first().l == dt.datetime(2018, 11, 3, 22, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
