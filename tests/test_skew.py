"""A hot key holding a third of the rows: results stay whole and exact.

Payments of one order make up a third of the table; the revenue mart (join
on the order, duplicate removal, aggregate per month and order) must give
the same totals as a brute-force computation, with nothing dropped.
"""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators.spine import Spine
from ledgerlens.plans import dims, sales_revenue
from ledgerlens.sources.fixtures import Domain

SPINE = Spine(dt.date(2000, 1, 1), dt.datetime(2000, 12, 15), "month", 1)


TIGHT = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.forceOptimizeSkewedJoin": "false"}


def test_hot_order_lookup(spark):
    """A third of the payments belong to one order: their join is split, every row of the product stays."""
    sf, n = "/root/testdata/sf0.001", 3000
    base = Domain(spark, sf)
    order = base.orders.join(base.store_orders.select("order_id"), F.col("id") == F.col("order_id")).agg(F.min("id")).first()[0]
    others = [r.id for r in base.orders.select("id").limit(200).collect()]
    pays = [(order if i % 3 == 0 else others[i % len(others)], i, f"p{i % 1500}") for i in range(n)]
    dom = Domain(spark, sf, {"payments": spark.createDataFrame(pays, "order_id bigint, installments int, psp_reference string").repartition(8)})
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    try:
        df = dims.lookup_payment_360(dom)
        got = df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    per = lambda t: {r.order_id: r["count"] for r in base.table(t).groupBy("order_id").count().collect()}
    sold, asked = per("store_orders"), per("service_requests")
    assert len(got) == sum(max(1, sold.get(o, 0)) * max(1, asked.get(o, 0)) for o, _, _ in pays)
    # one reference: the same rows, and its orders' keys in the filters of the scans
    one = dims.lookup_payment_360(dom, "p7")
    orders_of = {o for o, _, p in pays if p == "p7"}
    assert sorted(map(repr, one.collect())) == sorted(repr(r) for r in got if (r.order_id, r.installments) in {(o, i) for o, i, p in pays if p == "p7"})
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert all(str(o) in plan for o in orders_of)


def test_hot_order_revenue(spark):
    rnd = random.Random(3)
    n = 3000
    pays = []
    for i in range(n):
        order = 1 if i % 3 == 0 else 2 + i % 97            # order 1 holds a third of all payments
        created = dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rnd.randrange(0, 86400 * 330))
        pays.append((i, order, created, "monthly_fee", Decimal(rnd.randrange(100, 10000)) / 100, f"psp-{i}", 1))
    dom = Domain.from_tables(spark, {
        "payments": spark.createDataFrame(pays, "id bigint, order_id bigint, created_at timestamp_ntz, reason string, "
                                                "value decimal(18,2), psp_reference string, installments int"),
        "orders": spark.createDataFrame([(o, 20, True, Decimal("10.00"), dt.datetime(1999, 12, 1), None) for o in range(1, 100)],
                                        "id bigint, plan_id int, direct_channel boolean, preco decimal(18,2), "
                                        "subscribed_at timestamp_ntz, canceled_at timestamp_ntz"),
        "store_orders": spark.createDataFrame([(1, 1, Decimal("120.00"))], "order_id bigint, store_id bigint, total_price decimal(18,2)"),
        "stores": spark.createDataFrame([(1, 15)], "id bigint, partner_id int"),
        "partners": spark.createDataFrame([(15,)], "id int"),
        "revenue_shares": spark.createDataFrame([(15, Decimal("10.00"), None, None)],
                                                "partner_id int, value decimal(5,2), begin_at timestamp_ntz, finish_at timestamp_ntz"),
    })
    # the driver's own session: no forced skew optimisation
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    try:
        mart = sales_revenue.mart_plan_revenue(dom.from_tables(spark, {
            **{t: dom.table(t) for t in ("orders", "store_orders", "stores", "partners", "revenue_shares")},
            "payments": dom.payments.repartition(8)}), SPINE)
        got = mart.collect()
        assert "skew=true" in mart._jdf.queryExecution().executedPlan().toString()  # the hot order was split
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    sums = {}
    for r in got:
        n, t = sums.get(r.order_id, (0, 0.0))
        sums[r.order_id] = (n + r.revenue_count, t + r.total_revenue)

    def local(ts):   # UTC -> Sao Paulo in 2000: UTC-3, daylight UTC-2 from 8 Oct 2000 (before Feb 27: UTC-2)
        off = 2 if (ts < dt.datetime(2000, 2, 27, 2) or ts >= dt.datetime(2000, 10, 8, 3)) else 3
        return ts - dt.timedelta(hours=off)

    want = {}
    for i, order, created, _, value, _, _ in pays:
        lt = local(created)
        nxt = dt.datetime(lt.year + lt.month // 12, lt.month % 12 + 1, 1)
        if lt >= nxt - dt.timedelta(seconds=1) or lt < dt.datetime(2000, 1, 1):
            continue                                       # last-second gap / before the spine
        n_, t_ = want.get(order, (0, Decimal(0)))
        want[order] = (n_ + 1, t_ + value)
    assert {o: n for o, (n, _) in sums.items()} == {o: v[0] for o, v in want.items()}
    assert all(abs(t - float(want[o][1])) < 1e-6 for o, (_, t) in sums.items())
