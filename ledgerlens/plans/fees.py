"""Repair-fee revenue (M5) and payment transaction costs (M6, M7)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import dec, share_of_sum
from ..functions.rates import (BOLETO_FEE, BOLETO_METHOD, CARD_FIXED_FEE, EXTERNAL_SALE_KIND,
                               ICMS_PROVISION_PCT, ISSUES, PHONE_PRICE_NUM, PIS_COFINS_PCT, RFQ_FEE_RATE,
                               RFQ_THEFT_FEE_RATE, THEFT_ISSUE, card_fee_pct, is_rfq)
from ..functions.text import like_pushable
from ..functions.timeops import local_month, to_local
from ..operators.factor import COUNT, attach, copies, side, sum_of_rows
from ..operators.joins import split_join, spread_nulls
from ..operators.spine import Spine, bucket_point, near_spine
from ..sources.fixtures import Domain
from .common import dsum, pct, period_dates


def _pct_sum(*values: str) -> Column:
    return pct(str(sum(Decimal(v) for v in values)))


def requests_by_reference(dom: Domain) -> DataFrame:
    """Requests per payment reference: their number, first swap and numbers by issue (``request_none``: without one)."""
    issue = F.col("issue_id")
    return side(dom.service_requests, "payment_reference", "request", first=F.min("swapped_at"),
                none=F.count(F.when(issue.isNull(), 1)), **{n: F.count(F.when(issue == k, 1)) for n, k in ISSUES.items()})


def trackings_by_reference(dom: Domain) -> DataFrame:
    """Trackings per payment reference: their number and that of bank slips."""
    return side(dom.trackings, "psp_reference", "track", slips=F.count(F.when(F.col("payment_method") == BOLETO_METHOD, 1)))


def store_sales_by_order(dom: Domain) -> DataFrame:
    """Store orders per order: their number, the number of those with a price, and the sum of the prices."""
    return side(dom.store_orders, "order_id", "sale", priced=F.count("total_price"), total=F.sum("total_price"))


def repair_fee_payments_by_period(dom: Domain, spine: Spine) -> DataFrame:
    """Repair-fee payments in the period of the first swap of their requests, with the numbers of these requests.

    Requests are folded per payment reference (partial aggregation before the shuffle, so a hot reference costs one
    row per task), then joined to the payments and bucketed in local time.  Payments without a swapped request belong
    to no period.
    """
    requests = requests_by_reference(dom).filter(near_spine("request_first", spine))
    pay = dom.payments.filter(F.col("reason") == "repair_fee").select("id", "order_id", "value", "psp_reference")
    j = pay.join(requests.hint("merge"), pay["psp_reference"] == requests["request_key"], "inner").drop("request_key")
    j = j.withColumn("swapped_local", to_local("request_first")).drop("request_first")
    return bucket_point(j, "swapped_local", spine).drop("swapped_local")


def fee_terms() -> dict[str, Column]:
    """Measures of one repair-fee payment, in 33rds (a phone's price is its store price / 0.33).

    Each stands for all rows that the source's joins make of the payment: one per request of its reference and store order of
    its order.  A payment has requests here; ``value``, ``plan_id``, ``sale_*`` and ``request_*`` are its columns.
    """
    count = lambda c: F.col(c).cast(COUNT)
    value, total, requests = F.col("value"), F.col("sale_total"), count("request_n")
    sales, priced = copies("sale"), F.coalesce("sale_priced", F.lit(0)).cast(COUNT)
    insured = is_rfq(F.col("plan_id")) & (value > 0)
    percent = {n: int(Decimal(RFQ_THEFT_FEE_RATE if k == THEFT_ISSUE else RFQ_FEE_RATE) * 100) for n, k in ISSUES.items()}
    theft, other = percent["theft"], percent["screen"]
    tax_rfq, tax = _pct_sum(PIS_COFINS_PCT, ICMS_PROVISION_PCT), pct(PIS_COFINS_PCT)
    weight = (count("request_theft") * theft + (requests - count("request_theft")) * other).cast(COUNT)
    plain = lambda n: value * PHONE_PRICE_NUM * (sales * n).cast(COUNT)
    out = {"fee_rev": F.when(insured, total * weight).otherwise(plain(requests)),
           "fee_tax": F.when(insured, total * weight * tax_rfq).otherwise(plain(requests) * tax),
           "insurer_fee_cost": F.when(insured, total * weight - value * PHONE_PRICE_NUM * (priced * requests).cast(COUNT)
                                      ).otherwise(F.lit(0))}
    for name, hits, rate in (("q_insurer_fee_cost", requests - count("request_theft") - count("request_none"), other),
                             ("rf_insurer_fee_cost", count("request_theft"), theft)):
        bill = total * (hits * rate).cast(COUNT) - value * PHONE_PRICE_NUM * (priced * hits).cast(COUNT)
        out[name] = F.when(insured, sum_of_rows(bill, hits, requests)).otherwise(F.lit(0))
    for n in ISSUES:  # a request without an issue counts in every column
        hits = (count(f"request_{n}") + count("request_none")).cast(COUNT)
        rated = total * (hits * percent[n]).cast(COUNT)
        out[f"fee_rev_{n}"] = sum_of_rows(F.when(insured, rated).otherwise(plain(hits)), hits, requests)
        out[f"fee_tax_{n}"] = sum_of_rows(F.when(insured, rated * tax_rfq).otherwise(plain(hits) * tax), hits, requests)
    return out


def mart_fee_revenue(dom: Domain, spine: Spine) -> DataFrame:
    return dom.memo(("mart_fee_revenue", spine), lambda: _mart_fee_revenue(dom, spine))


def _mart_fee_revenue(dom: Domain, spine: Spine) -> DataFrame:
    """Repair-fee revenue, insurer cost and taxes per (local swap month, order).

    In the source each payment meets *all* requests of its reference and every store order of its order.  Requests and store
    orders are counted per key instead, so a reference or an order with many rows multiplies nothing.
    """
    p = repair_fee_payments_by_period(dom, spine)
    sold = dom.orders.select(F.col("id").alias("o_id"), "plan_id").join(
        store_sales_by_order(dom), F.col("o_id") == F.col("sale_key"), "left").drop("sale_key")
    j = split_join(p, sold, "order_id", "o_id")
    terms = fee_terms()
    sums = {n: share_of_sum(F.col(n), PHONE_PRICE_NUM) for n in terms}
    out = j.select("start_interval", "end_interval", "order_id", *[c.alias(n) for n, c in terms.items()]).groupBy(
        "start_interval", "end_interval", "order_id").agg(*[(-c if n.startswith("fee_tax") else c).alias(n) for n, c in sums.items()])
    return out.select(*period_dates(), "order_id", *terms)


def _months_of(pay: DataFrame, spine: Spine | None) -> DataFrame:
    """Payments with their local month of creation; with ``spine``, those in the calendar months of its period starts.

    The guard on the raw time comes first, so that it reaches the scan.
    """
    if spine is not None:
        pay = pay.filter(near_spine("created_at", spine))
    pay = pay.withColumn("creation_month", local_month("created_at"))
    if spine is not None:
        last = spine.start_of(F.lit(spine.last_index)).cast("date")
        pay = pay.filter((F.col("creation_month") >= F.lit(spine.start)) & (F.col("creation_month") <= last))
    return pay


def card_cost(value: Column, installments: Column) -> Column:
    """Card fee of a payment: percent by installment bracket (exact decimal)."""
    return card_fee_pct(installments) * dec("0.01", 3, 2) * value


def fee_charge() -> Column:
    """Transaction cost of one repair-fee payment over its trackings (``track_*``): slips and card charges."""
    slips = F.coalesce("track_slips", F.lit(0)).cast(COUNT)
    cards = (copies("track") - slips).cast(COUNT)
    charged = (card_cost(F.col("value"), F.col("installments")) + dec(CARD_FIXED_FEE, 3, 2)) * cards
    slip = slips * dec(BOLETO_FEE, 3, 2)
    return F.when(slips == 0, charged).when(cards == 0, slip).otherwise(slip + F.coalesce(charged, F.lit(0)))


def plan_cost(boleto: Column, subscription: Column) -> Column:
    """Twelve times the transaction cost of one plan payment over its trackings (``track_*``), for one store order."""
    rows = copies("track")
    slips = F.when(boleto, rows).otherwise(F.coalesce("track_slips", F.lit(0))).cast(COUNT)
    cards = (rows - slips).cast(COUNT)
    card, fixed = card_cost(F.col("value"), F.col("installments")), dec(CARD_FIXED_FEE, 3, 2) * 12
    each = F.when(subscription, card + fixed).otherwise(card * 12 + fixed)
    slip = slips * (dec(BOLETO_FEE, 3, 2) * 12)
    return F.when(slips == 0, each * cards).when(cards == 0, slip).otherwise(slip + F.coalesce(each * cards, F.lit(0)))


def sold_inside(cost: Column) -> Column:
    """A plan payment's cost over the store orders of its order (``sale_n``, ``sale_outside``: those sold by outside partners, which
    cost nothing)."""
    outside = F.coalesce("sale_outside", F.lit(0)).cast(COUNT)
    inside = (copies("sale") - outside).cast(COUNT)
    return F.when(inside == 0, F.lit(0)).when(outside > 0, F.coalesce(cost * inside, F.lit(0))).otherwise(cost * inside)


def plan_charge() -> Column:
    """Twelve times the transaction cost of one plan payment over its trackings and the store orders of its order."""
    return sold_inside(plan_cost(F.col("psp_reference").like("%boleto%"), F.col("reason") == "subscription"))


def _with_trackings(dom: Domain, pay: DataFrame, *more: DataFrame) -> DataFrame:
    """Payments with the folds of their reference; payments without one don't meet in one task."""
    pay = pay.withColumn("ref", spread_nulls(F.col("psp_reference"), F.col("id")))
    return attach(pay, "ref", trackings_by_reference(dom), *more)


def mart_fee_txn_cost(dom: Domain, spine: Spine | None = None) -> DataFrame:
    """Transaction cost of repair-fee payments per (order, local month); with ``spine``, of its months.

    Trackings and requests of one reference multiply in the source's joins; both are folded per reference here.
    """
    pay = _months_of(dom.payments.filter(like_pushable(F.col("reason"), "%repair_fee%")), spine)
    j = _with_trackings(dom, pay, requests_by_reference(dom))
    j = j.withColumn("charge", fee_charge())
    rows, charge = copies("request"), F.col("charge")
    per_issue = {}
    for n in ISSUES:
        hits = F.coalesce(f"request_{n}", F.lit(0)).cast(COUNT)
        per_issue[n] = sum_of_rows(charge * hits, hits, rows)
    return (j.groupBy("order_id", "creation_month")
            .agg((-dsum(charge * rows)).alias("fee_transaction_cost"),
                 *[(-dsum(c)).alias(f"fee_transaction_cost_{n}") for n, c in per_issue.items()]))


def sale_kinds(dom: Domain) -> DataFrame:
    """Store orders with a flag for those that an outside partner sold: (so_order_id, outside)."""
    so = dom.store_orders.select(F.col("order_id").alias("so_order_id"), F.col("store_id").alias("so_store_id"))
    st = dom.stores.select(F.col("id").alias("st_id"), F.col("partner_id").alias("st_partner_id"))
    pa = dom.partners.select(F.col("id").alias("pa_id"), F.col("partner_kind_id"))
    pk = dom.partner_kinds.select(F.col("id").alias("pk_id"), F.col("description").alias("kind"))
    return (so.join(st, F.col("so_store_id") == st["st_id"], "left")
            .join(pa, F.col("st_partner_id") == pa["pa_id"], "left")
            .join(pk, F.col("partner_kind_id") == pk["pk_id"], "left")
            .select("so_order_id", (F.col("kind") == EXTERNAL_SALE_KIND).alias("outside")))


def mart_plan_txn_cost(dom: Domain, spine: Spine | None = None) -> DataFrame:
    """Transaction cost of every non-repair payment per (order, local month); with ``spine``, of its months."""
    pay = _months_of(dom.payments.filter(~F.col("reason").like("%repair_fee%")), spine)
    sales = side(sale_kinds(dom), "so_order_id", "sale", outside=F.count(F.when(F.col("outside"), 1)))
    j = split_join(_with_trackings(dom, pay), sales, "order_id", "sale_key")
    return j.groupBy("order_id", "creation_month").agg((-share_of_sum(plan_charge(), 12)).alias("plan_transaction_cost"))
