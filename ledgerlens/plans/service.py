"""Service-request marts: monthly arrivals (M3) and claim severity (M4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rates import DEFAULT_LOGISTIC_COST, IN_HOUSE_REPAIR_SHOP, ISSUES, PIS_COFINS_PCT
from ..functions.timeops import to_local
from ..operators.factor import attach, copies, side
from ..operators.pivot import code_cases
from ..operators.spine import Spine, bucket_point, near_spine
from ..sources.fixtures import Domain
from .common import pct, period_dates


def mart_sr_monthly_count(dom: Domain, spine: Spine) -> DataFrame:
    return dom.memo(("mart_sr_monthly_count", spine), lambda: _mart_sr_monthly_count(dom, spine))


def _mart_sr_monthly_count(dom: Domain, spine: Spine) -> DataFrame:
    """Service requests arrived per (local month, order), split by issue.

    ``id`` is the service request's primary key, so the source's
    ``GROUP BY ..., id`` keeps one row per request; each request is bucketed
    by its local arrival time with a projection (no spine join).
    """
    sr = dom.service_requests.filter(near_spine("arrived_at", spine)).select(
        "id", "order_id", "issue_id", to_local("arrived_at").alias("arrived_local"))
    per_period = bucket_point(sr, "arrived_local", spine)
    pivots = code_cases(F.col("issue_id"), F.lit(1), ISSUES)
    return (per_period.groupBy("start_interval", "end_interval", "order_id")
            .agg(F.count("id").alias("count"),
                 *[F.sum(c).cast("long").alias(f"arrived_count_{n}") for n, c in pivots.items()])
            .select(*period_dates(), "order_id", "count",
                    *[f"arrived_count_{n}" for n in ISSUES]))


def inhouse_requests(dom: Domain) -> DataFrame:
    """Requests repaired by the in-house shop (semi-join: one row per request)."""
    shop = dom.repairs.filter(F.col("repair_shop_id") == IN_HOUSE_REPAIR_SHOP)
    sr = dom.service_requests.select("id", "issue_id")
    return sr.join(shop, sr["id"] == shop["service_request_id"], "left_semi")


def swapped_requests(dom: Domain, spine: Spine) -> DataFrame:
    """(period, order, request, issue) for requests swapped in the period (local time)."""
    sr = dom.service_requests.filter(near_spine("swapped_at", spine)).select(
        "id", "order_id", "issue_id", to_local("swapped_at").alias("swapped_local"))
    return bucket_point(sr, "swapped_local", spine).drop("swapped_local")


def mart_severity(dom: Domain, spine: Spine) -> DataFrame:
    return dom.memo(("mart_severity", spine), lambda: _mart_severity(dom, spine))


def request_costs(dom: Domain, spine: Spine) -> DataFrame:
    """Requests swapped in each period with the sums of their cost families over all cost and posting rows.

    Cost and posting rows of one request multiply in the source's joins; here each side is one row per request, and a
    sum of one side counts once per row of the other.  ``rows`` is the number of joined rows a request stands for.
    """
    repair, into, out = F.col("repair_cost"), F.col("invoice_in_value"), F.col("invoice_out_value")
    logistic = F.lit(DEFAULT_LOGISTIC_COST).cast("decimal(18,2)")
    costs = side(dom.rel_service_request_costs, "service_request_id", "cost", repair=F.sum(repair), swap=F.sum(into - out),
                 credit=F.sum(repair + out - into))
    posts = side(dom.service_request_postings, "service_request_id", "post",
                 inbound=F.sum(F.coalesce("from_customer_value", logistic)),
                 outbound=F.sum(F.coalesce("from_house_value", logistic)))
    shop = side(dom.repairs.filter(F.col("repair_shop_id") == IN_HOUSE_REPAIR_SHOP), "service_request_id", "house")
    j = attach(swapped_requests(dom, spine), "id", costs, posts, shop)
    per_cost, per_post = copies("post"), copies("cost")
    return j.select(
        "start_interval", "end_interval", "order_id", "issue_id", copies("cost", "post").cast("long").alias("rows"),
        F.col("house_n").isNotNull().alias("in_house"),
        (-F.col("cost_repair") * per_cost).alias("repair_cost"), (F.col("cost_swap") * per_cost).alias("swap_cost"),
        (-F.coalesce("post_inbound", logistic) * per_post).alias("inbound_logistic_cost"),
        (-F.coalesce("post_outbound", logistic) * per_post).alias("outbound_logistic_cost"),
        (F.col("cost_credit") * pct(PIS_COFINS_PCT) * per_cost).alias("severity_tax_credit"))


FAMILIES = ("repair_cost", "swap_cost", "inbound_logistic_cost", "outbound_logistic_cost", "severity_tax_credit")


def _mart_severity(dom: Domain, spine: Spine) -> DataFrame:
    """Repair, swap and logistic costs of swapped requests per (month, order).

    Several cost and posting rows per request multiply every sum and count, as in the source, but no row is multiplied
    (:func:`request_costs`).  Requests are summed by issue first, in narrow rows; the issues of a (month, order), five rows at
    most, are then spread over the columns.
    """
    keys, measures = ["start_interval", "end_interval", "order_id"], [*FAMILIES, "swapped_sr", "inhouse_sr"]
    known = F.when(F.col("issue_id").isin(*ISSUES.values()), F.col("issue_id"))
    by_issue = request_costs(dom, spine).groupBy(*keys, known.alias("issue")).agg(
        *[F.sum(f).alias(f) for f in FAMILIES], F.sum("rows").alias("swapped_sr"),
        F.sum(F.when(F.col("in_house"), F.col("rows")).otherwise(0)).alias("inhouse_sr"))
    parts = by_issue.groupBy(*keys).agg(F.collect_list(F.struct("issue", *measures)).alias("parts"))
    parts = parts.select(*keys, "parts", *[F.get(F.filter("parts", _is(k)), F.lit(0)).alias(n) for n, k in ISSUES.items()])
    out = []
    for m in measures:
        number = (lambda c: c.cast("double")) if m in FAMILIES else (lambda c: c)
        zero = F.lit(0).cast(by_issue.schema[m].dataType)
        out.append(number(_sum_of("parts", m, by_issue.schema[m].dataType)).alias(m))
        for n in ISSUES:  # other issues add 0, so only an issue of its own may leave a sum null
            own = F.when(F.size("parts") > 1, F.coalesce(F.col(n)[m], zero)).otherwise(F.col(n)[m])
            out.append(number(F.when(F.col(n).isNull(), zero).otherwise(own)).alias(f"{m}_{n}"))
    return parts.select(*period_dates(), "order_id", *out)


def _is(issue: int):
    return lambda p: p["issue"] == issue


def _sum_of(parts: str, field: str, kind: T.DataType) -> Column:
    """Sum of a field over an array of structs; null if all are."""
    def add(a: Column, p: Column) -> Column:
        return F.when(a.isNull(), p[field]).when(p[field].isNull(), a).otherwise((a + p[field]).cast(kind))

    return F.aggregate(parts, F.lit(None).cast(kind), add)
