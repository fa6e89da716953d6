"""Time helpers: UTC -> local wall clock, month of an event, cool-off flag.

Stored timestamps are naive UTC (``timestamp_ntz``).  All helpers return
``timestamp_ntz`` / ``date`` columns and never depend on the session zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Business time zone and cool-off windows of the reference.
LOCAL_TZ = "America/Sao_Paulo"
COOL_OFF_DAYS_DIRECT = 15
COOL_OFF_DAYS_OTHER = 8


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00", "Etc/GMT", "UCT"}


def _session_is_utc() -> bool:
    """Whether the active session's zone is UTC just now."""
    spark = SparkSession.getActiveSession()
    return spark is not None and spark.conf.get("spark.sql.session.timeZone") in _UTC_NAMES


def to_local(ts) -> Column:
    """Naive UTC -> naive local wall clock (DST aware).

    ``convert_timezone`` is independent of the session zone but resolves
    the zone rules per row; ``from_utc_timestamp`` uses cached offsets and
    is several times faster, and is exact when the session zone is UTC
    (the casts NTZ <-> TIMESTAMP are then identities).  Pick per session.
    """
    c = col_(ts)
    if _session_is_utc():
        return F.from_utc_timestamp(c.cast("timestamp"), LOCAL_TZ).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), c)


def month_start(ts) -> Column:
    """First day of the month of ``ts`` as a DATE."""
    return F.trunc(F.to_date(col_(ts)), "MM")


def local_month(ts) -> Column:
    """Month (DATE) of a UTC timestamp seen in local time."""
    return month_start(to_local(ts))


def ntz(value) -> Column:
    """A literal timestamp_ntz from a datetime / ISO string."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def add_interval(ts, expr: str) -> Column:
    return col_(ts) + F.expr(f"INTERVAL {expr}")


def withdrawal_flag(subscribed="subscribed_at", canceled="canceled_at", direct="direct_channel") -> Column:
    """Cancelled inside the cool-off window; NULL when not decidable.

    Direct channel: ``[subscribed, subscribed + 15 d)``; anything else
    (including NULL channel): ``[subscribed, subscribed + 8 d)``.  Compared
    on the raw UTC columns, as the source does.
    """
    s, c = col_(subscribed), col_(canceled)

    def within(days: int) -> Column:
        return (add_interval(s, f"{days} DAYS") > c) & (s <= c)

    return F.when(col_(direct), within(COOL_OFF_DAYS_DIRECT)).otherwise(within(COOL_OFF_DAYS_OTHER))
