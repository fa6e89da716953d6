"""Product held by each active order in each month (M8).

Source semantics, kept exactly:

* an order is active in a month when its activity span — earliest of
  subscription / request arrival to latest of cancellation (or *as_of*) /
  request close (falling back to tracked, then arrived) — overlaps it;
* the swap that decides the month: the order's first swap if that falls
  inside the month; else, if the first swap is before the month end, the
  order's *largest* swap id (of all time); else its smallest swap id;
* the product: that swap's old device's product when the swap is after the
  month start, its new device's product when before; otherwise (no swap, or
  a swap exactly at the start) the order's own product.

Plan: everything that does not depend on the month is computed once per
order (span, first swap, smallest / largest swap with their products) with
joins keyed on the order id; only then is each order expanded to its
active months with a bounded ``explode(sequence(...))``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import ntz, to_local
from ..operators.spine import Spine, explode_overlap
from ..sources.fixtures import Domain
from .common import period_dates


def order_activity_span(dom: Domain, as_of: dt.datetime) -> DataFrame:
    """Per order: local start and end of its activity span (left join of requests)."""
    sr = (dom.service_requests
          .groupBy("order_id")
          .agg(F.min("arrived_at").alias("first_arrived"),
               F.max(F.coalesce("closed_at", "tracked_at", "arrived_at")).alias("last_touch")))
    o = dom.orders.select("id", "subscribed_at", "canceled_at", "produto_id")
    j = o.join(sr, o["id"] == sr["order_id"], "left")
    return j.select(
        F.col("id").alias("o_id"), "produto_id",
        to_local(F.least("subscribed_at", "first_arrived")).alias("span_start"),
        to_local(F.greatest(F.coalesce(F.col("canceled_at"), ntz(as_of)), F.col("last_touch"))).alias("span_end"))


def swap_products(dom: Domain) -> DataFrame:
    """Per swap: its request, local swap time, product of the old and of the new device."""
    ds = dom.device_swaps.select(F.col("id").alias("swap_id"), "service_request_id", "created_at",
                                 "old_device_id", "new_device_id")
    dev = dom.devices
    prod = dom.produtos.select(F.col("id").alias("prod_id"))
    device_product = (dev.join(prod, dev["product_id"] == prod["prod_id"], "left")
                      .select(F.col("id").alias("dev_id"), F.col("prod_id")))
    old = device_product.select(F.col("dev_id").alias("old_dev"), F.col("prod_id").alias("old_product_id"))
    new = device_product.select(F.col("dev_id").alias("new_dev"), F.col("prod_id").alias("new_product_id"))
    return (ds.join(old, ds["old_device_id"] == old["old_dev"], "left")
            .join(new, ds["new_device_id"] == new["new_dev"], "left")
            .select("swap_id", "service_request_id", to_local("created_at").alias("swap_local"),
                    "old_product_id", "new_product_id"))


def order_swaps(dom: Domain) -> DataFrame:
    """Per order: first swap time and the smallest / largest swap id with their products.

    ``min_by`` / ``max_by`` the swap id are hash aggregates (partial + final, so an order with very many swaps costs
    one row per task), and the swap table isn't joined back.
    """
    sr = dom.service_requests.select(F.col("id").alias("sr_id"), F.col("order_id").alias("sw_order_id"))
    info = swap_products(dom)
    per_swap = info.join(sr, info["service_request_id"] == sr["sr_id"], "inner")
    parts = (("at", "swap_local"), ("old", "old_product_id"), ("new", "new_product_id"))
    return per_swap.groupBy("sw_order_id").agg(
        F.min("swap_local").alias("first_swap"),
        *[f(c, "swap_id").alias(f"{side}_{n}") for side, f in (("min", F.min_by), ("max", F.max_by)) for n, c in parts])


def mart_active_device_product(dom: Domain, spine: Spine) -> DataFrame:
    span = order_activity_span(dom, spine.as_of)
    swaps = order_swaps(dom)
    per_order = span.join(swaps, span["o_id"] == swaps["sw_order_id"], "left")
    months = explode_overlap(per_order, "span_start", "span_end", spine)

    start, end, first = F.col("start_interval"), F.col("end_interval"), F.col("first_swap")
    use_max = ~((first < end) & (first >= start)) & (first < end)

    def pick(suffix: str):
        return F.when(use_max, F.col(f"max_{suffix}")).otherwise(F.col(f"min_{suffix}"))

    swap_at = pick("at")
    product = (F.when(swap_at > start, pick("old"))
               .when(swap_at < start, pick("new"))
               .otherwise(F.col("produto_id")))
    return months.select(*period_dates(), "o_id", product.alias("product_id"))
