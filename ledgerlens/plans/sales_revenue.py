"""Monthly sales (M1) and recognised plan revenue (M2) per order.

One parametrised pipeline:

1. bucket each payment into the local month of its creation (a guard on the raw column reaches the scan;
   projection, no spine join);
2. work out the terms of each order once (store order, partner, revenue share valid at the local
   subscription instant, house / partner / insurer split, cool-off flag), drop exact duplicates among them (the
   source's all-column GROUP BY) and fold them to what one payment of the order brings;
3. join payments to one row per order and aggregate per (month, order): counts, exact sums of twelfths that are
   divided once, and the ``sum * avg(share) * rate`` products in DOUBLE.

Fact-to-fact joins are all keyed on the order id.  Dimensions are joined
through Spark's size-checked broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import share_of_sum
from ..functions.rates import IOF, ISS_PCT, PIS_COFINS_PCT, PLANS_ANNUAL, PLANS_RFQ, shares
from ..functions.timeops import to_local, withdrawal_flag
from ..operators.factor import COUNT
from ..operators.joins import split_join
from ..operators.spine import Spine, bucket_point, near_spine
from ..operators.validity import valid_time_join
from ..sources.fixtures import Domain
from .common import period_dates

SALES = "sales"
REVENUE = "revenue"
SHARES = ("house_share", "partner_share", "insurer_share")


def order_terms(dom: Domain, sale_kinds: bool = False) -> DataFrame:
    """What a payment takes from its order: one row per order, store order and valid share; with ``sale_kinds``, also the store
    order's id and the kind of its partner, and store orders whose order is missing (``known`` is false there).

    Partner, revenue share valid at the (local) subscription, split and cool-off flag depend on the order alone, so they are worked
    out here once and not per payment.
    """
    orders = dom.orders.select(
        F.col("id").alias("o_id"), "plan_id", "direct_channel", "preco",
        F.col("subscribed_at").alias("o_subscribed_at"), F.col("canceled_at").alias("o_canceled_at"))
    so = dom.store_orders.select(F.col("order_id").alias("so_order_id"), F.col("store_id").alias("so_store_id"),
                                 "total_price", *([F.col("id").alias("sale_id")] if sale_kinds else []))
    stores = dom.stores.select(F.col("id").alias("st_id"), F.col("partner_id").alias("st_partner_id"))
    partners = dom.partners.select(F.col("id").alias("partner_id"), *(["partner_kind_id"] if sale_kinds else []))
    rs = dom.revenue_shares.select(F.col("partner_id").alias("rs_partner_id"), F.col("value").alias("rs_value"),
                                   F.col("begin_at").alias("rs_begin"), F.col("finish_at").alias("rs_finish"))
    j = (orders.join(so, orders["o_id"] == so["so_order_id"], "full" if sale_kinds else "left")
         .join(stores, F.col("so_store_id") == stores["st_id"], "left")
         .join(partners, F.col("st_partner_id") == partners["partner_id"], "left")
         .withColumn("subscribed_at", to_local("o_subscribed_at")))
    if sale_kinds:
        j = j.withColumn("known", F.col("o_id").isNotNull()).withColumn("o_id", F.coalesce("o_id", "so_order_id"))
        kinds = dom.partner_kinds.select(F.col("id").alias("pk_id"), F.col("description").alias("kind"))
        j = j.join(kinds, F.col("partner_kind_id") == kinds["pk_id"], "left")
    j = valid_time_join(j, rs, "partner_id", "rs_partner_id", "subscribed_at", "rs_begin", "rs_finish")
    split = shares(F.col("plan_id"), F.col("partner_id"), F.col("rs_value"))
    return j.select("o_id", "plan_id", "direct_channel", "preco", "total_price", "so_store_id", "partner_id", "subscribed_at",
                    "rs_value", *(["sale_id", "kind", "known"] if sale_kinds else []), *[c.alias(n) for n, c in split.items()],
                    withdrawal_flag("o_subscribed_at", "o_canceled_at", "direct_channel").alias("withdrawn"))


def enriched_payments(dom: Domain, reasons: tuple[str, ...], spine: Spine | None = None) -> DataFrame:
    """Payments of the given reasons with the terms of their orders; with ``spine``, those in its periods only.

    A payment without an order has no plan and no partner, so its shares are 0.
    """
    pay = (dom.payments.filter(F.col("reason").isin(*reasons))
           .select("id", "order_id", "created_at", "reason", F.col("value").alias("pay_value")))
    if spine is not None:  # before any join; the guard reaches the scan
        pay = pay.filter(near_spine("created_at", spine)).withColumn("created_at", to_local("created_at"))
        pay = bucket_point(pay, "created_at", spine)
    terms = order_terms(dom)
    j = split_join(pay, terms, "order_id", "o_id")
    return j.withColumns({n: F.coalesce(n, F.lit(0).cast(terms.schema[n].dataType)) for n in SHARES})


def subscription_twelfths(kind: str) -> Column:
    """Twelve times the amount that a subscription payment books for one store order."""
    total, preco = F.col("total_price"), F.col("preco")
    if kind == SALES:
        return F.when(F.col("plan_id").isin(*PLANS_ANNUAL), total).when(F.col("direct_channel"), preco * 12).otherwise(total * 12)
    return F.coalesce(total, preco * 12)


def order_revenue(terms: DataFrame, kind: str, **sale_sums: Column) -> DataFrame:
    """What a payment of each order brings, one row per order.

    The source joins payments to the store orders and share windows of their order and drops rows that agree in all columns.  Those rows
    depend on the order and on whether the payment is a subscription, so they are made distinct and summed here once: ``sub_*`` for a
    subscription payment (number of rows, twelfths, rows above zero, shares), ``fee_*`` for another (number of rows, shares), whose
    amount is its own.  ``sale_sums`` are further sums over ``terms``.
    """
    order = ["o_id", "plan_id", "withdrawn"]
    rows = terms.withColumn("twelfths", subscription_twelfths(kind)).groupBy(*order, "partner_id", *SHARES, "twelfths").agg(
        F.count(F.lit(1)).alias("_same"), *[c.alias(n) for n, c in sale_sums.items()])
    extra = [F.sum(n).alias(n) for n in sale_sums]
    owners = rows.groupBy(*order, "partner_id", *SHARES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("twelfths").alias("twelfths"), F.count(F.when(F.col("twelfths") > 0, 1)).alias("above"), *extra)
    n = F.col("n").cast(COUNT)
    return owners.groupBy(*order).agg(
        F.sum("n").alias("sub_n"), F.sum("twelfths").alias("sub_twelfths"), F.sum("above").alias("sub_above"),
        *[F.sum(F.col(s) * n).alias(f"sub_{s}") for s in SHARES],
        F.count(F.lit(1)).alias("fee_n"), *[F.sum(s).alias(f"fee_{s}") for s in SHARES], *extra)


def payment_terms(kind: str, value: Column, subscription: Column | None = None) -> dict[str, Column]:
    """Columns of one payment joined to :func:`order_revenue`: rows it stands for, their twelfths, those above zero, sums of shares.

    ``subscription``: whether it is one, by its ``reason`` unless given.  A payment without an order is one row without plan, partner and shares; only what it paid itself counts.
    """
    if kind == SALES:
        either = lambda n: F.col(f"sub_{n}")
        own, above = F.col("sub_twelfths"), F.col("sub_above")
    else:
        subscription = F.col("reason") == "subscription" if subscription is None else subscription
        either = lambda n: F.when(subscription, F.col(f"sub_{n}")).otherwise(F.col(f"fee_{n}"))
        rows = F.coalesce("fee_n", F.lit(1))
        own = F.when(subscription, F.col("sub_twelfths")).otherwise(value * 12 * rows.cast(COUNT))
        above = F.when(subscription, F.col("sub_above")).when(value > 0, rows)
    return {"rows": F.coalesce(either("n"), F.lit(1)), "twelfths": own, "above": F.coalesce(above, F.lit(0)),
            **{s: F.coalesce(either(s), F.lit(0)) for s in SHARES}}


def line_class() -> Column:
    """2: insured plan, 1: another plan, 0: none."""
    plan = F.col("plan_id")
    return F.when(plan.isin(*PLANS_RFQ), 2).when(plan.isNotNull(), 1).otherwise(0)


def revenue_mart(dom: Domain, spine: Spine, kind: str = SALES) -> DataFrame:
    return dom.memo(("revenue_mart", spine, kind), lambda: _revenue_mart(dom, spine, kind))


def _revenue_mart(dom: Domain, spine: Spine, kind: str = SALES) -> DataFrame:
    noun = "sale" if kind == SALES else "revenue"
    reasons = ("subscription",) if kind == SALES else ("subscription", "monthly_fee", "overdue_monthly_fee")
    pay = dom.payments.filter(F.col("reason").isin(*reasons) & near_spine("created_at", spine)).select(
        "order_id", to_local("created_at").alias("created_at"), "reason", F.col("value").alias("pay_value"))
    j = split_join(bucket_point(pay, "created_at", spine), order_revenue(order_terms(dom), kind), "order_id", "o_id")
    terms = payment_terms(kind, F.col("pay_value"))
    p = j.select("start_interval", "end_interval", "order_id", line_class().alias("line"),
                 F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"), *[c.alias(n) for n, c in terms.items()])
    # plan and cool-off belong to the order, so a group has one value of each
    n, line, total = F.sum("rows"), F.max("line"), share_of_sum(F.col("twelfths"), 12)
    s_plan, s_admin = F.when(line == 1, total).otherwise(0.0), F.when(line == 2, total).otherwise(0.0)
    avg = {s: F.sum(s).cast("double") / n for s in SHARES}
    above = F.sum("above")
    iof = F.lit(float(IOF))
    k = F.lit(float(Decimal(1) - Decimal(IOF)))  # the constant (1 - IOF), folded exactly
    pis = F.lit(float(PIS_COFINS_PCT))
    iss = F.lit(float(ISS_PCT))
    hundred = F.lit(100.0)

    cols: list[Column] = []
    if kind == SALES:
        cols += [avg[n].alias(n) for n in SHARES]
    cols += [
        n.alias(f"{noun}_count"),
        F.when(line == 1, above).otherwise(0).alias("plan_count"),
        F.when(line == 2, above).otherwise(0).alias("rfq_count"),
        (-F.when(F.max("withdrawn"), n).otherwise(0)).alias(f"withdrawn_{noun}_count"),
        total.alias(f"total_{noun}"),
        s_plan.alias(f"plan_{noun}"),
        (s_plan * avg["house_share"]).alias(f"house_plan_{noun}"),
        (s_plan * avg["partner_share"]).alias(f"partner_plan_{noun}"),
        s_admin.alias(f"rfq_{noun}"),
        (s_admin * iof).alias(f"iof_rfq_{noun}"),
        (s_admin * avg["house_share"]).alias(f"house_rfq_{noun}"),
        (s_admin * avg["partner_share"]).alias(f"partner_rfq_{noun}"),
        (s_admin * avg["insurer_share"]).alias(f"insurer_rfq_{noun}"),
        (-s_plan * pis / hundred).alias(f"plan_{noun}_pis_cofins"),
        (-s_plan * avg["house_share"] * pis / hundred).alias(f"house_plan_{noun}_pis_cofins"),
        (-s_plan * avg["partner_share"] * pis / hundred).alias(f"partner_plan_{noun}_pis_cofins"),
        (-s_admin * k * pis / hundred).alias(f"rfq_{noun}_pis_cofins"),
        (-s_admin * avg["house_share"] * pis / hundred).alias(f"house_rfq_{noun}_pis_cofins"),
        (-s_admin * avg["partner_share"] * pis / hundred).alias(f"partner_rfq_{noun}_pis_cofins"),
        (-s_admin * avg["insurer_share"] * pis / hundred).alias(f"insurer_rfq_{noun}_pis_cofins"),
        (-s_admin * k * iss / hundred).alias(f"rfq_{noun}_iss"),
        (-s_admin * avg["house_share"] * iss / hundred).alias(f"house_rfq_{noun}_iss"),
        (-s_admin * avg["partner_share"] * iss / hundred).alias(f"partner_rfq_{noun}_iss"),
        (-s_admin * avg["insurer_share"] * iss / hundred).alias(f"insurer_rfq_{noun}_iss"),
    ]
    agg = p.groupBy("start_interval", "end_interval", "order_id").agg(*cols)
    names = [c for c in agg.columns if c not in ("start_interval", "end_interval", "order_id")]
    return agg.select(*period_dates(), "order_id", *names)


def mart_sales(dom: Domain, spine: Spine) -> DataFrame:
    return revenue_mart(dom, spine, SALES)


def mart_plan_revenue(dom: Domain, spine: Spine) -> DataFrame:
    return revenue_mart(dom, spine, REVENUE)
