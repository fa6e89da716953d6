"""Operator-level queries: each exercises one operator of the marts on the
whole fixture tables (plan classes, LIKE filters, local time, cool-off flag,
valid-time join, period bucketing, overlap expansion, semi-join, code pivot,
distinct, non-NULL counts, rate card, card-fee brackets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import (CARD_FIXED_FEE, ISSUES, PLANS_HOUSE_ONLY, PLANS_RFQ, card_fee_pct)
from ..functions.money import dec
from ..functions.timeops import local_month, month_start, to_local, withdrawal_flag
from ..operators.spine import bucket_point, explode_overlap, near_spine, Spine
from ..sources.fixtures import Domain
from . import device, sales_revenue, service
from .common import period_dates


def op_plan_class(dom: Domain) -> DataFrame:
    """IN / NOT IN with three-valued logic: a NULL plan is in no class."""
    p = F.col("plan_id")
    return dom.orders.select("id", "plan_id", p.isin(*PLANS_HOUSE_ONLY).alias("is_house_only"),
                             p.isin(*PLANS_RFQ).alias("is_rfq"), (~p.isin(*PLANS_RFQ)).alias("is_not_rfq"))


def op_reason_like(dom: Domain) -> DataFrame:
    """LIKE / NOT LIKE per payment reason (NULL reason matches neither)."""
    r = F.col("reason")
    return (dom.payments.groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n_payments"),
                 F.sum(F.when(F.col("psp_reference").like("%boleto%"), 1).otherwise(0)).cast("long").alias("n_boleto_refs"))
            .select("reason", "n_payments", "n_boleto_refs",
                    r.like("%repair_fee%").alias("is_repair_like"),
                    (~r.like("%repair_fee%")).alias("is_not_repair_like")))


def op_to_local_time(dom: Domain) -> DataFrame:
    return dom.payments.select("id", "created_at", to_local("created_at").alias("created_local"))


def op_withdrawal_flag(dom: Domain) -> DataFrame:
    return dom.orders.select("id", "direct_channel", F.coalesce(withdrawal_flag(), F.lit(False)).alias("withdrawn"))


def op_event_month(dom: Domain) -> DataFrame:
    return dom.payments.select("id", local_month("created_at").alias("creation_month"),
                               month_start("created_at").alias("creation_month_utc"))


def op_validity_join_share(dom: Domain) -> DataFrame:
    """Revenue-share percent valid at the local subscription instant."""
    e = sales_revenue.enriched_payments(dom, ("subscription",))
    return e.select("id", "partner_id", "subscribed_at", F.col("rs_value").cast("double").alias("share_pct"))


def op_revenue_split(dom: Domain) -> DataFrame:
    e = sales_revenue.enriched_payments(dom, ("subscription",))
    return e.select("id", "plan_id", "partner_id", *[F.col(n).cast("double").alias(n) for n in sales_revenue.SHARES])


def op_card_fee_brackets(dom: Domain) -> DataFrame:
    inst = F.col("installments")
    pct = card_fee_pct(inst)
    return dom.payments.select("id", "installments", pct.cast("double").alias("card_fee_pct"),
                               (pct * dec("0.01", 3, 2) * F.col("value") + dec(CARD_FIXED_FEE, 3, 2))
                               .cast("double").alias("card_cost"))


def op_bucket_point_in_period(dom: Domain, spine: Spine) -> DataFrame:
    p = dom.payments.filter(near_spine("created_at", spine)).select("id", "order_id", to_local("created_at").alias("created_local"))
    return bucket_point(p, "created_local", spine).select(*period_dates(), "id", "order_id")


def op_in_period_flag(dom: Domain, spine: Spine) -> DataFrame:
    """Requests swapped in each local month (the boolean-key shape of severity)."""
    return service.swapped_requests(dom, spine).select(*period_dates(), "order_id", "id", "issue_id")


def op_explode_overlap_periods(dom: Domain, spine: Spine) -> DataFrame:
    span = device.order_activity_span(dom, spine.as_of)
    return explode_overlap(span, "span_start", "span_end", spine).select(*period_dates(), "o_id")


def op_semi_inhouse(dom: Domain) -> DataFrame:
    return service.inhouse_requests(dom).select("id", "issue_id")


def op_left_join_chain(dom: Domain) -> DataFrame:
    pay = dom.payments.select(F.col("id"), "order_id")
    o = dom.orders.select(F.col("id").alias("o_id"), "plan_id")
    so = dom.store_orders.select(F.col("order_id").alias("so_order_id"), "store_id")
    st = dom.stores.select(F.col("id").alias("st_id"), F.col("partner_id").alias("st_partner_id"))
    pa = dom.partners.select(F.col("id").alias("partner_id"))
    return (pay.join(o, pay["order_id"] == o["o_id"], "left")
            .join(so, (F.col("order_id") == so["so_order_id"]) & F.col("o_id").isNotNull(), "left")
            .join(st, F.col("store_id") == st["st_id"], "left")
            .join(pa, F.col("st_partner_id") == pa["partner_id"], "left")
            .select("id", "order_id", "plan_id", "store_id", "partner_id"))


def op_device_swap_history(dom: Domain) -> DataFrame:
    """Swaps reachable from an order through its requests (left then inner = inner)."""
    o = dom.orders.select(F.col("id").alias("o_id"))
    sr = dom.service_requests.select(F.col("id").alias("sr_id"), "order_id")
    ds = dom.device_swaps.select(F.col("id").alias("dswap_id"), "service_request_id", "created_at")
    return (o.join(sr, o["o_id"] == sr["order_id"], "inner")
            .join(ds, F.col("sr_id") == ds["service_request_id"], "inner")
            .select("o_id", to_local("created_at").alias("c_at"), "dswap_id"))


def op_count_nonnull(dom: Domain) -> DataFrame:
    return (dom.service_requests.groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("n_requests"), F.count("issue_id").alias("n_with_issue"),
                 F.count("swapped_at").alias("n_swapped"), F.count("closed_at").alias("n_closed")))


def op_issue_pivot(dom: Domain) -> DataFrame:
    """Requests per order pivoted by issue code (explicit values: no extra pass)."""
    codes = list(ISSUES.values())
    piv = dom.service_requests.groupBy("order_id").pivot("issue_id", codes).count()
    return piv.select("order_id", *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"n_{n}")
                                    for n, k in ISSUES.items()])


def op_distinct_rows(dom: Domain) -> DataFrame:
    return dom.service_requests.select("order_id", "issue_id").distinct()
