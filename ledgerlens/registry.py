"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver's tables of
that folder through :class:`~ledgerlens.sources.fixtures.Domain`; nothing
runs on fixed input alone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .operators.spine import Spine
from .plans import bi, device, dims, fees, geo, margin, micro, sales_revenue, service, spines
from .sources.fixtures import AS_OF_EVENTS, AS_OF_TPC, Domain

# Fixed parameters of the fixture queries.
AS_OF = dt.datetime.fromisoformat(AS_OF_TPC)
MONTHS = Spine(dt.date(1995, 1, 1), AS_OF, "month", 1)

Builder = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def domain_for(spark: SparkSession, sf_dir: str) -> Domain:
    """The domain tables of a folder, defined anew on each call."""
    return Domain(spark, sf_dir)


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Domain], DataFrame]):
        def builder(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(domain_for(spark, sf_dir))

        builder.__name__ = name
        builder.__doc__ = fn.__doc__
        _QUERIES[name] = builder
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return deco


@register("mart_sr_monthly_count", oracle.sr_monthly_count(MONTHS))
def _q_sr_count(dom):
    return service.mart_sr_monthly_count(dom, MONTHS)


@register("mart_severity", oracle.severity(MONTHS))
def _q_severity(dom):
    return service.mart_severity(dom, MONTHS)


@register("mart_sales", oracle.revenue(MONTHS, "sales"))
def _q_sales(dom):
    return sales_revenue.mart_sales(dom, MONTHS)


@register("mart_plan_revenue", oracle.revenue(MONTHS, "revenue"))
def _q_plan_revenue(dom):
    return sales_revenue.mart_plan_revenue(dom, MONTHS)


@register("mart_fee_revenue", oracle.fee_revenue(MONTHS))
def _q_fee_revenue(dom):
    return fees.mart_fee_revenue(dom, MONTHS)


@register("mart_fee_txn_cost", oracle.fee_txn_cost())
def _q_fee_txn_cost(dom):
    return fees.mart_fee_txn_cost(dom)


@register("mart_plan_txn_cost", oracle.plan_txn_cost())
def _q_plan_txn_cost(dom):
    return fees.mart_plan_txn_cost(dom)


@register("mart_active_device_product", oracle.active_device_product(MONTHS))
def _q_device(dom):
    return device.mart_active_device_product(dom, MONTHS)


_DIM_SQL = oracle.dims()
for _name in ("dim_products", "dim_brands", "dim_plans", "dim_stores", "dim_partners", "extract_store_orders",
              "extract_orders_priced", "lookup_payment_360", "scan_preview"):
    register(_name, _DIM_SQL[_name])(getattr(dims, _name))


_MICRO_SQL = oracle.micro(MONTHS)
for _name in ("op_plan_class", "op_reason_like", "op_to_local_time", "op_withdrawal_flag", "op_event_month",
              "op_validity_join_share", "op_revenue_split", "op_card_fee_brackets", "op_semi_inhouse",
              "op_left_join_chain", "op_device_swap_history", "op_count_nonnull", "op_issue_pivot",
              "op_distinct_rows"):
    register(_name, _MICRO_SQL[_name])(getattr(micro, _name))
for _name in ("op_bucket_point_in_period", "op_in_period_flag", "op_explode_overlap_periods"):
    register(_name, _MICRO_SQL[_name])(lambda dom, _f=getattr(micro, _name): _f(dom, MONTHS))

EVENTS_AS_OF = dt.datetime.fromisoformat(AS_OF_EVENTS)
SPINES = {
    "time_spine_year": (Spine(dt.date(1995, 1, 1), AS_OF, "year", 1), "orders"),
    "time_spine_semester": (Spine(dt.date(1995, 1, 1), AS_OF, "semester", 1), "orders"),
    "time_spine_month": (MONTHS, "orders"),
    "time_spine_quarter": (Spine(dt.date(1995, 1, 1), AS_OF, "month", 3), "orders"),
    "time_spine_week": (Spine(dt.date(2024, 1, 1), EVENTS_AS_OF, "week", 1), "events"),
    "time_spine_day": (Spine(dt.date(2024, 1, 1), EVENTS_AS_OF, "day", 1), "events"),
}
for _name, (_spine, _facts) in SPINES.items():
    _sql = oracle.spine_counts(_spine, f"SELECT {oracle.loc('subscribed_at')} AS ts FROM d_orders"
                               if _facts == "orders" else "SELECT ts FROM events")
    _fn = spines.order_spine if _facts == "orders" else spines.event_spine
    register(_name, _sql)(lambda dom, _f=_fn, _s=_spine: _f(dom, _s))


@register("mart_contribution_margin", oracle.contribution_margin(MONTHS))
def _q_margin(dom):
    return margin.mart_contribution_margin(dom, MONTHS)


register("geo_zone_join", oracle.geo_zone_join())(geo.geo_zone_join)


# Workbook parameters: kind of period, window size, start date; Sheet 3's member.
WORKBOOK = Spine(dt.date(1995, 1, 1), AS_OF, "month", 1)
SINGLE_ORDER = 7
_BI_SQL = oracle.bi(WORKBOOK, SINGLE_ORDER)
register("bi_selected_orders", _BI_SQL["bi_selected_orders"])(lambda dom: bi.bi_selected_orders(dom, AS_OF))
for _name in ("bi_fee_rev_draft", "bi_plans", "bi_orders"):
    register(_name, _BI_SQL[_name])(getattr(bi, _name))
for _name in ("bi_order_months", "bi_fee_rev_in_period", "bi_active_orders_by_month", "bi_record_count"):
    register(_name, _BI_SQL[_name])(lambda dom, _f=getattr(bi, _name): _f(dom, WORKBOOK))
register("bi_active_orders_single", _BI_SQL["bi_active_orders_single"])(
    lambda dom: bi.bi_active_orders_single(dom, WORKBOOK, SINGLE_ORDER))


def queries() -> dict[str, Builder]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
