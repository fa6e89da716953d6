"""Folded sides against the literal joins: random tables in which every many-to-many join multiplies rows."""

import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest

from ledgerlens import oracle
from ledgerlens.operators.spine import Spine
from ledgerlens.plans import fees, margin, sales_revenue, service
from ledgerlens.sources.fixtures import Domain
from tools.oracle_check import duck_rows, spark_rows

from .test_marts import SR

SPINE = Spine(dt.date(2000, 1, 1), dt.datetime(2000, 6, 15), "month", 1)
SCHEMAS = {
    "orders": "id bigint, plan_id int, direct_channel boolean, preco decimal(18,2), subscribed_at timestamp_ntz, canceled_at timestamp_ntz",
    "store_orders": "id bigint, order_id bigint, store_id bigint, total_price decimal(18,2)",
    "stores": "id bigint, partner_id int", "partners": "id int, partner_kind_id int", "partner_kinds": "id int, description string",
    "revenue_shares": "partner_id int, value decimal(5,2), begin_at timestamp_ntz, finish_at timestamp_ntz",
    "payments": "id bigint, order_id bigint, created_at timestamp_ntz, reason string, value decimal(18,2), psp_reference string, installments int",
    "trackings": "psp_reference string, payment_method string", "service_requests": SR,
    "repairs": "service_request_id bigint, repair_shop_id int",
    "rel_service_request_costs": "service_request_id bigint, repair_cost decimal(18,2), invoice_in_value decimal(18,2), invoice_out_value decimal(18,2)",
    "service_request_postings": "service_request_id bigint, from_customer_value decimal(18,2), from_house_value decimal(18,2)",
}
DUCK = {"rel_service_request_costs": "d_costs", "service_request_postings": "d_postings"}


def random_tables(seed: int) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    pick, maybe = r.choice, lambda v, p=0.2: None if r.random() < p else v
    money = lambda hi=10**5: Decimal(r.randrange(-500, hi)) / 100
    when = lambda: dt.datetime(1999, 12, 20) + dt.timedelta(seconds=r.randrange(86400 * 200))
    refs = [f"{pick(['psp', 'boleto'])}-{i}" for i in range(25)] + [None]
    orders = range(1, 30)
    hot = lambda seq: pick([seq[0], pick(seq), pick(seq)])  # noqa: E731  the first key holds a third of the rows
    return {
        "orders": [(o, maybe(pick([8, 10, 20, 40, 61])), maybe(r.random() < 0.5), maybe(money()), maybe(when()), maybe(when(), 0.6)) for o in orders if o % 7],
        "store_orders": [(100 + i, hot(orders), maybe(r.randrange(5)), maybe(money())) for i in range(40)],
        "stores": [(i, maybe(pick([15, 164, 500]))) for i in range(4)],
        "partners": [(15, 1), (164, 2), (500, 1)], "partner_kinds": [(1, "Venda externa"), (2, "Online")],
        "revenue_shares": [(15, Decimal("10.00"), None, dt.datetime(2000, 3, 1)), (15, Decimal("12.50"), dt.datetime(2000, 2, 1), None),
                           (164, Decimal("5.00"), None, None), (164, Decimal("5.00"), None, None), (500, Decimal("7.00"), dt.datetime(2000, 1, 10), None)],
        "payments": [(i, maybe(hot(orders), 0.05), when(), maybe(pick(["subscription", "monthly_fee", "overdue_monthly_fee", "repair_fee", "repair_fee",
                                                                      "overdue_repair_fee"]), 0.05), maybe(pick([money(), Decimal("0.00")]), 0.1),
                      hot(refs), maybe(r.randrange(9))) for i in range(300)],
        "trackings": [(hot(refs), maybe(pick(["card", "boletobancario_santander"]))) for _ in range(60)],
        "service_requests": [(i, hot(orders), maybe(r.randrange(1, 6)), maybe(when()), maybe(when()), None, None, hot(refs), 1, 1) for i in range(120)],
        "repairs": [(r.randrange(140), pick([28, 28, 5])) for _ in range(80)],
        "rel_service_request_costs": [(pick([3, r.randrange(140)]), maybe(money()), maybe(money()), maybe(money())) for _ in range(150)],
        "service_request_postings": [(pick([3, r.randrange(140)]), maybe(money()), maybe(money())) for _ in range(150)],
    }


def domain(spark, tables) -> Domain:
    return Domain.from_tables(spark, {t: spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in tables.items()})


def duck(tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        ddl = SCHEMAS[t].replace("timestamp_ntz", "timestamp").replace(" string", " varchar")
        name = DUCK.get(t, f"d_{t}")
        con.execute(f"CREATE TABLE {name} ({ddl})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_the_joins(spark, monkeypatch, seed):
    monkeypatch.setattr(oracle, "with_domain", lambda body: body.strip())
    tables = random_tables(seed)
    con, dom = duck(tables), domain(spark, tables)
    for df, sql in ((service.mart_severity(dom, SPINE), oracle.severity(SPINE)),
                    (fees.mart_fee_revenue(dom, SPINE), oracle.fee_revenue(SPINE)),
                    (fees.mart_fee_txn_cost(dom), oracle.fee_txn_cost()), (fees.mart_plan_txn_cost(dom), oracle.plan_txn_cost()),
                    (sales_revenue.mart_sales(dom, SPINE), oracle.revenue(SPINE, "sales")),
                    (sales_revenue.mart_plan_revenue(dom, SPINE), oracle.revenue(SPINE, "revenue")),
                    (margin.mart_contribution_margin(dom, SPINE), oracle.contribution_margin(SPINE))):
        got, want = spark_rows(df), duck_rows(con, sql)
        assert got[0] == want[0] and got[1] == want[1], (sql[:40], list((got[1] - want[1]).elements())[:2], list((want[1] - got[1]).elements())[:2])


def test_one_pass_equals_the_stacked_marts(spark):
    dom = domain(spark, random_tables(9))
    stored = {"plan_revenue": sales_revenue.mart_plan_revenue(dom, SPINE), "severity": service.mart_severity(dom, SPINE)}
    assert spark_rows(margin.mart_contribution_margin(dom, SPINE)) == spark_rows(margin.mart_contribution_margin(dom, SPINE, stored))


def test_one_pass_reads_every_table_once(spark):
    from ledgerlens import registry

    plan = registry.queries()["mart_contribution_margin"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [")
    # 11 tables; requests are read once by reference and once for their swaps
    assert scans <= 12, scans


def test_one_pass_shuffles_payments_by_reference_and_by_order_only(spark):
    """The rows of an order stay together: neither its folds nor the months' aggregate are shuffled once more."""
    plan = margin.mart_contribution_margin(domain(spark, random_tables(4)), SPINE)._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert "start_interval" not in dealt and sum(k in ("o_id", "order_id", "so_order_id") for k in dealt) <= 4, dealt
    assert not any("reason" in line for line in plan.splitlines() if "MergeJoin" in line)


def test_a_request_with_very_many_postings(spark):
    """10^5 postings and 10^3 costs of one request: 10^8 joined rows that are never made."""
    tables = random_tables(1) | {
        "service_requests": [(1, 1, 4, None, dt.datetime(2000, 2, 10, 12), None, None, "r", 1, 1)],
        "rel_service_request_costs": [(1, Decimal("1.25"), Decimal("2.00"), Decimal("0.50"))] * 1000,
        "service_request_postings": [(1, Decimal("2.00"), None)], "repairs": [(1, 28)] * 3}
    dom = domain(spark, tables)
    dom.__dict__["service_request_postings"] = spark.range(100_000).selectExpr(
        "1L AS service_request_id", "CAST(2.00 AS decimal(18,2)) AS from_customer_value", "CAST(NULL AS decimal(18,2)) AS from_house_value")
    row = service.mart_severity(dom, SPINE).first()
    assert (row.swapped_sr, row.inhouse_sr, row.swapped_sr_theft, row.swapped_sr_water) == (10**8, 10**8, 10**8, 0)
    assert (row.repair_cost, row.swap_cost, row.inbound_logistic_cost, row.outbound_logistic_cost) == (-1.25e8, 1.5e8, -2e8, -35e8)
    assert row.repair_cost_theft == row.repair_cost and row.repair_cost_screen == 0.0
    assert row.severity_tax_credit == pytest.approx(-0.25 * 0.0925 * 1e8)


def test_a_reference_with_a_third_of_all_requests(spark):
    """Requests and trackings of a hot reference are counted: one row per task leaves the scan."""
    n = 30_000
    dom = domain(spark, random_tables(2) | {
        "payments": [(1, 1, dt.datetime(2000, 2, 1, 12), "repair_fee", Decimal("3.00"), "hot", 1)], "orders": [(1, 20, None, None, None, None)],
        "store_orders": [(1, 1, None, Decimal("10.00"))] * 2})
    dom.__dict__["service_requests"] = spark.range(0, n, 1, 4).selectExpr(
        "id", "id AS order_id", "CAST(if(id % 5 = 0, NULL, id % 5) AS int) AS issue_id", "CAST(NULL AS timestamp_ntz) AS arrived_at",
        "TIMESTAMP_NTZ '2000-03-05 12:00:00' AS swapped_at", "if(id % 3 = 0, 'hot', concat('r', id)) AS payment_reference")
    dom.__dict__["trackings"] = spark.range(0, n, 1, 4).selectExpr("if(id % 3 = 0, 'hot', concat('r', id)) AS psp_reference", "'card' AS payment_method")
    row = fees.mart_fee_revenue(dom, SPINE).first()
    assert row.fee_rev == 3.0 * 2 * (n // 3) and row.fee_rev_screen == 3.0 * 2 * (n // 3) * 2 / 5  # screen and none
    charge = fees.mart_fee_txn_cost(dom).first()
    each = 3.0 * 0.0187 + 0.27
    assert charge.fee_transaction_cost == pytest.approx(-each * (n // 3) ** 2) and charge.fee_transaction_cost_slm == pytest.approx(-each * (n // 3) ** 2 / 5)
