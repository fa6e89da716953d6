"""Parametric period spines (T1, T2) joined to the facts they index.

The spine itself is tiny (bounded by its number of periods) and is
broadcast; the facts are bucketed arithmetically and pre-aggregated per
period index before the join, so the fact side never shuffles more than one
row per (task, period).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import to_local
from ..operators.spine import Spine, bucket_point
from ..sources.fixtures import Domain


def spine_counts(dom: Domain, spine: Spine, facts: DataFrame, ts: str) -> DataFrame:
    """Every period of the spine with the number of facts whose ``ts`` falls in it."""
    per = (bucket_point(facts, ts, spine, keep_index=True)
           .groupBy("_k").agg(F.count(F.lit(1)).alias("n_items")))
    frame = dom.spark.range(spine.periods).withColumnRenamed("id", "_k")
    frame = frame.select("_k", spine.start_of(F.col("_k")).alias("start_interval"),
                         spine.end_of(F.col("_k")).alias("end_interval"))
    # the spine side is bounded by construction (spine.periods rows)
    return (F.broadcast(frame).join(per, "_k", "left")
            .select("start_interval", "end_interval", F.coalesce("n_items", F.lit(0)).alias("n_items")))


def order_spine(dom: Domain, spine: Spine) -> DataFrame:
    """Orders subscribed (local time) per period."""
    o = dom.orders.select(to_local("subscribed_at").alias("ts"))
    return spine_counts(dom, spine, o, "ts")


def event_spine(dom: Domain, spine: Spine) -> DataFrame:
    """Events per period (event timestamps are already wall-clock)."""
    return spine_counts(dom, spine, dom.raw("events").select("ts"), "ts")
