"""Datasets and worksheets of the archived BI workbook (B2-B9).

The workbook's data source is a join tree: periods x confirmed orders
(``1 = 1``), orders (the source joins on ``1 = 1`` as well; we use the
intended key ``orders.id = order_id``), plans, and the draft fee revenue
placed in the period that contains its first payment.  The worksheets sum a
row-level "active at period end" flag by month.

Spark plan: periods are generated per order with a bounded
``explode(sequence(...))`` (the spine has ``spine.periods`` rows), never a
join with the spine; the worksheets do not even do that — the periods in
which an order is active form one contiguous index range computed per
order, so only active (order, period) pairs are generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import ntz
from ..operators.spine import Spine, bucket_point
from ..sources.fixtures import Domain
from .common import pct

# Plan names excluded from the "active orders by month" sheet.
EXCLUDED_PLAN_NAMES = ("CORPORATIVE_2", "CORPORATIVE_3", "QBE_DEFAULT")
ORDER_COLUMNS = ("id", "created_at", "user_id", "preco", "produto_id", "canceled_at", "plan_id", "subscribed_at",
                 "cancellation_reason_id", "direct_channel", "skip_auto_renewal", "order_parent_id", "old_price",
                 "disable_service_request_fee", "device_price")


def bi_selected_orders(dom: Domain, as_of) -> DataFrame:
    """Confirmed orders with first and last activity (raw UTC)."""
    return _selected(dom, as_of, ())


def _selected(dom: Domain, as_of, columns: tuple[str, ...]) -> DataFrame:
    """Confirmed orders with first and last activity and ``columns`` of the order, from one pass over the orders."""
    sr = (dom.service_requests.groupBy("order_id")
          .agg(F.min("arrived_at").alias("first_arrived"),
               F.max(F.coalesce("closed_at", "tracked_at", "arrived_at")).alias("last_touch")))
    o = dom.orders.filter(F.col("payment_confirmed")).select(*dict.fromkeys(("id", "subscribed_at", "canceled_at", *columns)))
    return (o.join(sr.hint("merge"), o["id"] == sr["order_id"], "left")  # as many orders on either side
            .select(F.col("id").alias("order_id"),
                    F.least("subscribed_at", "first_arrived").alias("order_subscribed_at"),
                    F.greatest(F.coalesce(F.col("canceled_at"), ntz(as_of)), F.col("last_touch"))
                    .alias("order_canceled_at"), *columns))


def bi_fee_rev_draft(dom: Domain) -> DataFrame:
    """Repair-fee revenue per (order, UTC month of payment), net of PIS/COFINS."""
    p = dom.payments.filter(F.col("reason") == "repair_fee")
    s = F.sum("value").cast("decimal(28,2)")
    rate = pct("9.25")
    return (p.groupBy("order_id", F.trunc(F.to_date("created_at"), "MM").cast("timestamp_ntz").alias("start_month"))
            .agg(s.cast("double").alias("fee_rev"), (-s * rate).cast("double").alias("fee_rev_taxes"),
                 (s - s * rate).cast("double").alias("net_fee_rev"), F.min("created_at").alias("min")))


def bi_plans(dom: Domain) -> DataFrame:
    return dom.plans.select(F.col("id").alias("id_plans"), F.col("name").alias("plan_name"), "number_of_months",
                            "price_factor", "partner_price_factor", "fixed_product_price", "percentage_value",
                            "use_price_table", "min_value", "max_value")


def bi_orders(dom: Domain) -> DataFrame:
    return dom.orders.select(*ORDER_COLUMNS)


def _fee_in_periods(dom: Domain, spine: Spine) -> DataFrame:
    """Draft fee rows in the period that contains their first payment."""
    fee = bi_fee_rev_draft(dom)
    return bucket_point(fee, "min", spine, keep_index=True).drop("start_interval", "end_interval")


def _order_tree(dom: Domain, spine: Spine) -> DataFrame:
    """Confirmed orders with their order and plan columns (one row per order)."""
    sel, pl = _selected(dom, spine.as_of, ORDER_COLUMNS), bi_plans(dom)
    return sel.join(pl, F.col("plan_id") == pl["id_plans"], "left")


def _with_fees(tree: DataFrame, dom: Domain, spine: Spine) -> DataFrame:
    """Orders with ``fees``, their dated fee rows by period index, and ``more``, the (index, number) of those beyond the first of
    a period.  An order has at most one fee row per month, so both are bounded."""
    row = F.struct(F.col("order_id").alias("fee_order_id"), "start_month", "fee_rev", "fee_rev_taxes", "net_fee_rev", "min")
    per = _fee_in_periods(dom, spine).groupBy(F.col("order_id").alias("f_order"), "_k").agg(F.collect_list(row).alias("rows"))
    beyond = lambda e: F.transform(F.slice(F.sequence(F.lit(0), F.size(e["rows"]) - 1), 2, 1 << 30),
                                   lambda i: F.struct(e["_k"].alias("k"), i.alias("i")))
    fee = per.groupBy("f_order").agg(F.collect_list(F.struct("_k", "rows")).alias("entries")).select(
        "f_order", F.map_from_entries("entries").alias("fees"), F.flatten(F.transform("entries", beyond)).alias("more"))
    return tree.join(fee.hint("merge"), tree["order_id"] == fee["f_order"], "left").drop("f_order")


def _expanded(orders: DataFrame, spine: Spine, first: int, last: int | None) -> DataFrame:
    """One row per order and period (and fee row of both, if any), with ``start_interval``, ``end_interval`` and the fee row ``_f``.

    Period bounds are a constant array, fee rows a map by period, so a row costs two lookups; nothing is shuffled afterwards.
    """
    first, last = max(first, 0), spine.last_index if last is None else min(last, spine.last_index)
    slot = "struct<k: bigint, i: int, s: timestamp_ntz, e: timestamp_ntz>"
    slots = ", ".join(f"named_struct('k', {k}L, 'i', 0, 's', TIMESTAMP_NTZ '{a}', 'e', TIMESTAMP_NTZ '{b}')"
                      for k, (a, b) in enumerate(spine.bounds()) if first <= k <= last)
    fixed = F.expr(f"CAST(array({slots}) AS array<{slot}>)")
    shown = F.filter("more", lambda m: (m["k"] >= first) & (m["k"] <= last))
    further = F.transform(shown, lambda m: F.struct(m["k"].alias("k"), m["i"].alias("i"), F.get(fixed, (m["k"] - first).cast("int"))["s"].alias("s"),
                                                    F.get(fixed, (m["k"] - first).cast("int"))["e"].alias("e")).cast(slot))
    rows = orders.withColumn("_p", F.explode(F.when(F.coalesce(F.size("more"), F.lit(0)) > 0, F.concat(fixed, further)).otherwise(fixed)))
    return rows.withColumns({"start_interval": F.col("_p.s"), "end_interval": F.col("_p.e"),
                             "_f": F.get(F.try_element_at("fees", F.col("_p.k")), F.col("_p.i"))})


FEE_COLUMNS = ("fee_order_id", "start_month", "fee_rev", "fee_rev_taxes", "net_fee_rev", "min")


def bi_order_months(dom: Domain, spine: Spine, first: int = 0, last: int | None = None) -> DataFrame:
    """The workbook's data source: all 37 columns of every (period, confirmed order) with fee revenue.

    ``first`` and ``last`` limit the periods (by index), for a caller that reads some months only.
    """
    tree = _order_tree(dom, spine)
    rows = _expanded(_with_fees(tree, dom, spine), spine, first, last)
    return rows.select("start_interval", "end_interval", *tree.columns, *[F.col(f"_f.{c}").alias(c) for c in FEE_COLUMNS],
                       ntz(spine.as_of).alias("now"))


def bi_fee_rev_in_period(dom: Domain, spine: Spine) -> DataFrame:
    """The theta + equi left join: every (period, confirmed order), with the fee rows whose ``min`` the period contains."""
    orders = bi_selected_orders(dom, spine.as_of).select("order_id")
    rows = _expanded(_with_fees(orders, dom, spine), spine, 0, None)
    return rows.select("start_interval", "end_interval", "order_id", *[F.col(f"_f.{c}").alias(c) for c in FEE_COLUMNS[1:]])


def _active_range(spine: Spine, subscribed: str, canceled: str):
    """Index range of periods whose end satisfies ``subscribed <= end <= ifnull(canceled, end)``."""
    s, c = F.col(subscribed), F.col(canceled)
    k_s = spine.index_of(s)
    first = k_s + F.when(spine.end_of(k_s) < s, 1).otherwise(0)          # first end >= subscribed
    first = F.when(first < 0, F.lit(0).cast("long")).otherwise(first)
    k_c = spine.index_of(c)
    last = k_c - F.when(spine.end_of(k_c) > c, 1).otherwise(0)           # last end <= canceled
    last = F.when(c.isNull(), F.lit(spine.last_index).cast("long")) \
            .when(last > spine.last_index, F.lit(spine.last_index).cast("long")).otherwise(last)
    return first, last


def _active_by_period(dom: Domain, spine: Spine, rows: DataFrame) -> DataFrame:
    """SUM(active) per period over the (period, order) tree restricted to ``rows``.

    Each order contributes 1 per period it is active in, times the number of fee rows joined to that (order, period) (at
    least one).  Orders add 1 where their activity begins and take it back behind its end; a running sum over the spine
    (``periods`` rows) gives the counts, so no order is expanded to months.  Fee rows beyond the first of an order and period
    are added where it is active.  A period in which no order is active appears with 0 as long as any order passed.
    """
    first, last = _active_range(spine, "subscribed_at", "canceled_at")
    spans = rows.select("order_id", first.alias("a"), last.alias("b"))
    some = F.col("a") <= F.col("b")
    step = lambda k, w: F.struct(k.cast("long").alias("k"), F.lit(w).cast("long").alias("w"))
    steps = F.when(some, F.array(step(F.col("a"), 1), step(F.col("b") + 1, -1))).otherwise(F.array(step(F.lit(0), 0)))
    turns = spans.select(F.explode(steps).alias("s")).groupBy(F.col("s.k").alias("k")).agg(F.sum("s.w").alias("w"))
    fee = (_fee_in_periods(dom, spine).groupBy(F.col("order_id").alias("f_order"), F.col("_k").alias("f_k"))
           .agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    extra = (spans.join(fee, spans["order_id"] == fee["f_order"]).filter(F.col("f_k").between(F.col("a"), F.col("b")))
             .groupBy(F.col("f_k").alias("x_k")).agg(F.sum(F.col("n") - 1).alias("x")))
    frame = dom.spark.range(spine.periods).withColumnRenamed("id", "_k")
    so_far = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)  # over ``periods`` rows
    whole = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (frame.join(turns, frame["_k"] == turns["k"], "left").join(extra, frame["_k"] == extra["x_k"], "left")
           .withColumn("running", F.sum(F.coalesce("w", F.lit(0))).over(so_far))
           .withColumn("passed", F.count("w").over(whole)).filter("passed > 0"))
    return per.select(F.trunc(F.to_date(spine.start_of(F.col("_k"))), "MM").alias("start_month"),
                      (F.col("running") + F.coalesce("x", F.lit(0))).alias("active_orders"))


def bi_active_orders_by_month(dom: Domain, spine: Spine) -> DataFrame:
    """Sheet 2: active confirmed orders per month, three plans excluded (NULL plan kept)."""
    tree = _order_tree(dom, spine)
    keep = tree.filter(~F.col("plan_name").isin(*EXCLUDED_PLAN_NAMES) | F.col("plan_name").isNull())
    out = _active_by_period(dom, spine, keep)
    return out.groupBy("start_month").agg(F.sum("active_orders").cast("long").alias("active_orders"))


def bi_active_orders_single(dom: Domain, spine: Spine, order_id: int) -> DataFrame:
    """Sheet 3: the same measure drilled down to one order."""
    tree = _order_tree(dom, spine).filter(F.col("order_id") == order_id)
    out = _active_by_period(dom, spine, tree)
    return out.groupBy("start_month").agg(F.sum("active_orders").cast("long").alias("active_orders"))


def bi_record_count(dom: Domain, spine: Spine) -> DataFrame:
    """Number of Records of the data source, without materialising the pairs."""
    tree = _order_tree(dom, spine).select("order_id")
    # fee rows beyond the first in an (order, period) add rows to the source
    extra = (_fee_in_periods(dom, spine).groupBy("order_id", "_k").agg(F.count(F.lit(1)).alias("n_fee"))
             .groupBy("order_id").agg(F.sum(F.col("n_fee") - 1).alias("extra"))
             .withColumnRenamed("order_id", "x_order_id"))
    return (tree.join(extra, tree["order_id"] == extra["x_order_id"], "left")
            .agg((F.count(F.lit(1)) * spine.periods + F.coalesce(F.sum("extra"), F.lit(0)))
                 .cast("long").alias("number_of_records")))
