"""Contribution margin per (month, order) — our composition of the marts.

No source file contains this final step; the shared grain of the marts and their signs (revenue and tax credits positive,
taxes and costs negative) make it a sum.

Computed afresh, it is one pass: every payment meets the folds of its reference and then, beside the swapped requests, those of its
order once.  It gives a row to each month it counts in (month of creation, month of the first swap it paid for); these rows and
those of the requests go into one aggregate per (month, order), where the rows of an order are already.  Every table is read once.  Given stored marts, it stacks and folds those instead.  The
measures are added in one fixed order, so both ways give the same digits.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import share_of_sum
from ..functions.rates import EXTERNAL_SALE_KIND, IOF, ISS_PCT, PHONE_PRICE_NUM, PIS_COFINS_PCT
from ..functions.timeops import month_start, to_local
from ..operators.factor import attach, copies
from ..operators.joins import spread_nulls
from ..operators.spine import Spine, near_spine
from ..sources.fixtures import Domain
from . import fees, sales_revenue, service
from .common import dsum

KEYS = ["start_interval", "order_id"]
# category -> measures, added left to right
MEASURES = {
    "revenue": ["total_revenue", "fee_rev"],
    "taxes": ["plan_revenue_pis_cofins", "rfq_revenue_pis_cofins", "rfq_revenue_iss", "fee_tax", "severity_tax_credit"],
    "costs": ["repair_cost", "swap_cost", "inbound_logistic_cost", "outbound_logistic_cost", "fee_transaction_cost",
              "plan_transaction_cost"],
    "house_revenue": ["house_plan_revenue", "house_rfq_revenue", "fee_rev"],
    "house_taxes": ["house_plan_revenue_pis_cofins", "house_rfq_revenue_pis_cofins", "house_rfq_revenue_iss", "fee_tax",
                    "severity_tax_credit"],
}
SOURCES = {
    "plan_revenue": ["total_revenue", "plan_revenue_pis_cofins", "rfq_revenue_pis_cofins", "rfq_revenue_iss",
                     "house_plan_revenue", "house_rfq_revenue", "house_plan_revenue_pis_cofins",
                     "house_rfq_revenue_pis_cofins", "house_rfq_revenue_iss"],
    "fee_revenue": ["fee_rev", "fee_tax"],
    "severity": ["severity_tax_credit", "repair_cost", "swap_cost", "inbound_logistic_cost", "outbound_logistic_cost"],
    "fee_txn_cost": ["fee_transaction_cost"],
    "plan_txn_cost": ["plan_transaction_cost"],
}


def _ordered_sum(cols: list[str]) -> Column:
    return reduce(lambda acc, c: acc + F.coalesce(F.col(c), F.lit(0.0)), cols[1:],
                  F.coalesce(F.col(cols[0]), F.lit(0.0)))


#: Kinds of payments.
OTHER, SUBSCRIPTION, FEE, REPAIR = range(4)


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def payment_facts(dom: Domain, spine: Spine) -> DataFrame:
    """What every payment brings without its order: (order_id, value, installments, kind, boleto, first days of the months that it
    counts in, numbers of trackings and requests).

    Only what later steps need is shuffled, in small numbers: months and kinds are worked out before the first shuffle, amounts
    after the last.
    """
    reason, ref = F.col("reason"), F.col("psp_reference")
    repair = reason == "repair_fee"
    kind = F.when(reason == "subscription", SUBSCRIPTION).when(repair, REPAIR).when(reason.like("%repair_fee%"), FEE).otherwise(OTHER)
    last = spine.start_of(F.lit(spine.last_index)).cast("date")

    def period(t: Column) -> Column:
        """Start of the period that holds ``t``, or null."""
        k = spine.index_of(t)
        return F.when((k >= 0) & (k <= spine.last_index) & (t < spine.end_of(k)), spine.start_of(k).cast("date"))

    def days(created: Column) -> Column:
        month = month_start(created)
        return F.struct(F.when(reason.isin("subscription", "monthly_fee", "overdue_monthly_fee"), period(created)).alias("revenue"),
                        F.when(month.between(F.lit(spine.start), last), month).alias("charge"))

    # months: of the creation (revenue if inside a period, transaction costs by calendar month), of the first swap (fees)
    pay = dom.payments.filter(reason.isNotNull() & (near_spine("created_at", spine) | repair)).select(
        "order_id", "value", "installments", kind.cast("tinyint").alias("kind"), F.coalesce(ref.like("%boleto%"), F.lit(False)).alias("boleto"),
        _once(to_local("created_at"), days).alias("days"), spread_nulls(ref, F.col("id")).alias("ref"))
    pay = pay.select("order_id", "value", "days.revenue", "days.charge", "installments", "kind", "boleto", "ref")
    pay = attach(pay, "ref", fees.trackings_by_reference(dom), fees.requests_by_reference(dom))
    swapped = (F.col("kind") == REPAIR) & F.col("request_first").isNotNull()
    facts = pay.select("order_id", "value", "revenue", "charge", F.when(swapped, _once(to_local("request_first"), period)).alias("fee"),
                       "installments", "kind", "boleto", "track_n", "track_slips", "request_n", "request_theft")
    return facts.where(F.coalesce("revenue", "charge", "fee").isNotNull())


def _rows(dom: Domain, spine: Spine) -> DataFrame:
    """(start_interval, order_id, line, sums): a row for each month that a payment counts in and one for each swapped request.

    Payments and requests meet the orders by their plain id: partitions that hold all rows of an order serve the aggregate too,
    so nothing is shuffled again.
    """
    requests = service.request_costs(dom, spine).select(
        "order_id", F.col("start_interval").cast("date").alias("swap"), F.struct(*service.FAMILIES).alias("costs"))
    j = payment_facts(dom, spine).unionByName(requests, allowMissingColumns=True)
    orders = _orders(dom)
    j = j.join(orders.hint("merge"), F.col("order_id") == F.col("o_id"), "left")
    tags = ("revenue", "charge", "fee", "swap")

    def entry(day: Column, **on: Column) -> Column:
        return F.struct(day.alias("day"), *[on.get(n, F.lit(False)).alias(n) for n in tags])

    yes, same = F.lit(True), F.coalesce(F.col("revenue") == F.col("charge"), F.lit(False))
    entries = F.array(entry(F.col("revenue"), revenue=yes, charge=same), entry(F.when(~same, F.col("charge")), charge=yes),
                      entry(F.col("fee"), fee=yes), entry(F.col("swap"), swap=yes))
    e = j.select("*", F.explode(F.filter(entries, lambda x: x["day"].isNotNull())).alias("e"))
    e = e.withColumn("sale_n", F.when(~F.col("e.fee") | F.col("known"), F.col("sale_n")))
    terms = sales_revenue.payment_terms(sales_revenue.REVENUE, F.col("value"), F.col("kind") == SUBSCRIPTION)
    bill, fee = fees.fee_terms(), F.col("kind").isin(FEE, REPAIR)
    cost = fees.plan_cost(F.col("boleto"), F.col("kind") == SUBSCRIPTION)
    on = {"rows": ("revenue", terms["rows"]), "twelfths": ("revenue", terms["twelfths"]), "house_share": ("revenue", terms["house_share"]),
          "fee_rev": ("fee", bill["fee_rev"]), "fee_tax": ("fee", bill["fee_tax"]),
          "fee_charge": ("charge", F.when(fee, fees.fee_charge() * copies("request"))),
          "plan_charge": ("charge", F.when(~fee, fees.sold_inside(cost)))}
    on |= {n: ("swap", F.col("costs")[n]) for n in service.FAMILIES}
    line = F.when(F.col("e.swap"), 0).otherwise(sales_revenue.line_class())
    return e.select(F.col("e.day").alias("start_interval"), "order_id", line.alias("line"),
                    *[F.when(F.col(f"e.{tag}"), c).alias(n) for n, (tag, c) in on.items()])


def _orders(dom: Domain) -> DataFrame:
    """One row per order: revenue terms, and numbers and prices of its store orders, from one pass over the order's tables.

    All rows of an order are shuffled together once; every fold below and the join with payments use that.  Store orders without
    an order id match nothing.
    """
    terms = sales_revenue.order_terms(dom, sale_kinds=True).withColumn("outside", F.col("kind") == EXTERNAL_SALE_KIND)
    terms = terms.drop("kind").where(F.col("o_id").isNotNull()).repartition("o_id")
    # share windows repeat a store order; the first of its rows stands for it
    once = F.row_number().over(Window.partitionBy("o_id", "sale_id").orderBy("rs_value")) == 1
    sale = F.col("sale_id").isNotNull() & F.col("first_row")
    sums = {"sale_n": F.count(F.when(sale, 1)), "sale_outside": F.count(F.when(sale & F.col("outside"), 1)),
            "sale_priced": F.count(F.when(sale, F.col("total_price"))), "sale_total": F.sum(F.when(sale, F.col("total_price"))),
            "known": F.count(F.when(F.col("known"), 1))}
    per_order = sales_revenue.order_revenue(terms.withColumn("first_row", once), sales_revenue.REVENUE, **sums)
    known = F.col("known") > 0  # store orders of a missing order count in transaction costs only
    own = [F.when(known, F.col(c)).alias(c) for c in per_order.columns if c.startswith(("sub_", "fee_"))]
    return per_order.select("o_id", "plan_id", "withdrawn", *own, known.alias("known"), F.nullif("sale_n", F.lit(0)).alias("sale_n"),
                            "sale_outside", "sale_priced", "sale_total")


def _fresh(dom: Domain, spine: Spine) -> DataFrame:
    """Measures per (month, order) from one pass over the tables."""
    g = _rows(dom, spine).groupBy(*KEYS).agg(
        F.max("line").alias("line"), F.sum("rows").alias("n"), F.sum("house_share").cast("double").alias("house"),
        share_of_sum(F.col("twelfths"), 12).alias("total_revenue"),
        share_of_sum(F.col("fee_rev"), PHONE_PRICE_NUM).alias("fee_rev"), (-share_of_sum(F.col("fee_tax"), PHONE_PRICE_NUM)).alias("fee_tax"),
        (-dsum(F.col("fee_charge"))).alias("fee_transaction_cost"), (-share_of_sum(F.col("plan_charge"), 12)).alias("plan_transaction_cost"),
        *[dsum(F.col(c)).alias(c) for c in service.FAMILIES])
    plan = F.when(F.col("line") == 1, F.col("total_revenue")).otherwise(0.0)
    rfq = F.when(F.col("line") == 2, F.col("total_revenue")).otherwise(0.0)
    share = F.when(F.col("n") > 0, F.col("house") / F.col("n"))
    k, pis, iss, hundred = F.lit(float(1 - Decimal(IOF))), F.lit(float(PIS_COFINS_PCT)), F.lit(float(ISS_PCT)), F.lit(100.0)
    return g.withColumns({
        "plan_revenue_pis_cofins": -plan * pis / hundred, "rfq_revenue_pis_cofins": -rfq * k * pis / hundred,
        "rfq_revenue_iss": -rfq * k * iss / hundred, "house_plan_revenue": plan * share, "house_rfq_revenue": rfq * share,
        "house_plan_revenue_pis_cofins": -plan * share * pis / hundred, "house_rfq_revenue_pis_cofins": -rfq * share * pis / hundred,
        "house_rfq_revenue_iss": -rfq * share * iss / hundred})


def _stacked(dom: Domain, spine: Spine, stored: dict[str, DataFrame]) -> DataFrame:
    """Measures per (month, order) from the marts of :data:`SOURCES`, stored ones where given.

    Every mart has at most one row per (month, order), so each measure has one non-null value per group of the stack.
    """
    build = {
        "plan_revenue": lambda: sales_revenue.mart_plan_revenue(dom, spine),
        "fee_revenue": lambda: fees.mart_fee_revenue(dom, spine),
        "severity": lambda: service.mart_severity(dom, spine),
        # transaction costs are keyed by calendar month
        "fee_txn_cost": lambda: fees.mart_fee_txn_cost(dom, spine).withColumnRenamed("creation_month", "start_interval"),
        "plan_txn_cost": lambda: fees.mart_plan_txn_cost(dom, spine).withColumnRenamed("creation_month", "start_interval"),
    }
    last_start = spine.start_of(F.lit(spine.last_index)).cast("date")
    in_spine = F.col("start_interval").between(F.lit(spine.start), last_start)
    parts = {name: stored[name].filter(in_spine) if name in stored else make() for name, make in build.items()}
    every = [m for cols in SOURCES.values() for m in cols]
    frames = [parts[name].select(*KEYS, *[F.col(m) if m in cols else F.lit(None).cast("double").alias(m)
                                         for m in every])
              for name, cols in SOURCES.items()]
    stacked = reduce(lambda a, b: a.unionByName(b), frames)
    return stacked.groupBy(*KEYS).agg(*[F.max(m).alias(m) for m in every])


def mart_contribution_margin(dom: Domain, spine: Spine, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Margin per (month, order): gross (partners' and insurers' shares included in revenue) and the house's own.

    ``stored`` gives marts of :data:`SOURCES` that are already written (:func:`ledgerlens.sources.sinks.read_mart`, keyed by
    start_interval), so that a monthly run composes them, pruned by month, instead of computing them again.
    """
    folded = _stacked(dom, spine, stored) if stored else _fresh(dom, spine)
    cats = {cat: _ordered_sum(cols) for cat, cols in MEASURES.items()}
    out = folded.select(*KEYS, *[c.alias(n) for n, c in cats.items()])
    margin = lambda pre: (F.col(f"{pre}revenue") + F.col(f"{pre}taxes")) + F.col("costs")
    return out.select(*KEYS, *MEASURES, margin("").alias("contribution_margin"), margin("house_").alias("house_margin"))
