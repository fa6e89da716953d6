"""Period spines and period arithmetic (year / semester / month / week / day).

A spine is the list of periods ``[start_interval, end_interval]`` with
``end = start + n units - 1 second`` from a start date up to the period
that contains ``as_of``.  Instead of cross-joining facts with the spine and
filtering (a nested-loop join over rows x periods), every operator here
*computes* the period index of a timestamp arithmetically, so bucketing is
a projection + filter that stays inside one code-generated stage, and
overlap expansion is a bounded ``explode(sequence(lo, hi))``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS_PER_UNIT = {"year": 12, "semester": 6, "month": 1}
DAYS_PER_UNIT = {"week": 7, "day": 1}
UNITS = tuple(MONTHS_PER_UNIT) + tuple(DAYS_PER_UNIT)



def one_second() -> Column:
    return F.expr("INTERVAL 1 SECOND")


def _as_date(v) -> dt.date:
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, dt.date):
        return v
    return dt.date.fromisoformat(str(v)[:10])


def _add_months(d: dt.date, months: int) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
    return dt.date(y, m + 1, d.day)


@dataclass(frozen=True)
class Spine:
    """Periods of ``n`` ``unit`` starting at ``start`` up to ``as_of``.

    ``semester`` means 6 months.  Month-based spines must start on a day
    <= 28 so that every period starts on the same day of month.
    """

    start: dt.date
    as_of: dt.datetime
    unit: str = "month"
    n: int = 1

    def __post_init__(self):
        object.__setattr__(self, "start", _as_date(self.start))
        if not isinstance(self.as_of, dt.datetime):
            object.__setattr__(self, "as_of", dt.datetime.fromisoformat(str(self.as_of)))
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}, got {self.unit!r}")
        if not 1 <= self.n <= 365:
            raise ValueError("window size must be within 1..365")
        if self.unit in MONTHS_PER_UNIT and self.start.day > 28:
            raise ValueError("month-based spines must start on day <= 28")

    # ---- parameters ----------------------------------------------------------
    @property
    def monthly(self) -> bool:
        return self.unit in MONTHS_PER_UNIT

    @property
    def step(self) -> int:
        """Step in months (month-based) or days (day-based)."""
        per = MONTHS_PER_UNIT.get(self.unit) or DAYS_PER_UNIT[self.unit]
        return per * self.n

    @property
    def last_index(self) -> int:
        """Index of the last period: the last start on or before as_of's date."""
        end = self.as_of.date()
        if self.monthly:
            md = (end.year * 12 + end.month) - (self.start.year * 12 + self.start.month)
            if end < _add_months(self.start, md):
                md -= 1
            return md // self.step
        return (end - self.start).days // self.step

    @property
    def periods(self) -> int:
        return self.last_index + 1

    @property
    def end(self) -> dt.date:
        """First day after the last period."""
        if self.monthly:
            return _add_months(self.start, self.periods * self.step)
        return self.start + dt.timedelta(days=self.periods * self.step)

    def bounds(self) -> list[tuple[dt.datetime, dt.datetime]]:
        """Start and end of every period."""
        at = lambda k: _add_months(self.start, k * self.step) if self.monthly else self.start + dt.timedelta(days=k * self.step)
        starts = [dt.datetime.combine(at(k), dt.time()) for k in range(self.periods + 1)]
        return [(a, b - dt.timedelta(seconds=1)) for a, b in zip(starts, starts[1:])]

    # ---- column arithmetic --------------------------------------------------------
    def index_of(self, ts: Column) -> Column:
        """Index of the period whose start is the last one <= ts (may be < 0)."""
        start = F.lit(self.start)
        if self.monthly:
            md = (F.year(ts) * 12 + F.month(ts)) - (self.start.year * 12 + self.start.month)
            if self.start.day > 1:
                md = md - F.when(ts < F.add_months(start, md.cast("int")).cast("timestamp_ntz"), 1).otherwise(0)
            return F.floor(md / F.lit(self.step)).cast("long")
        return F.floor(F.datediff(F.to_date(ts), start) / F.lit(self.step)).cast("long")

    def start_of(self, k: Column) -> Column:
        """Start (timestamp_ntz) of period ``k``."""
        start = F.lit(self.start)
        if self.monthly:
            d = F.add_months(start, (k * self.step).cast("int"))
        else:
            d = F.date_add(start, (k * self.step).cast("int"))
        return d.cast("timestamp_ntz")

    def end_of(self, k: Column) -> Column:
        """End (timestamp_ntz) of period ``k``: next start minus one second."""
        return self.start_of(k + 1) - one_second()

    # ---- DataFrames ----------------------------------------------------------------
    def frame(self, spark: SparkSession) -> DataFrame:
        """The spine itself: one row per period (bounded by ``periods``)."""
        k = F.col("id")
        return spark.range(self.periods).select(
            self.start_of(k).alias("start_interval"), self.end_of(k).alias("end_interval"))


def near_spine(ts: Column | str, spine: Spine) -> Column:
    """Lossless guard on a raw UTC column: true for all times whose local time may lie in the spine.

    A plain range of literals, so it reaches the parquet scan; put it before joins, :func:`bucket_point` stays exact.
    """
    t = F.col(ts) if isinstance(ts, str) else ts
    return (t >= _moment(spine.start, -1)) & before_spine_end(t, spine)


def before_spine_end(ts: Column | str, spine: Spine) -> Column:
    """The upper half of :func:`near_spine`, for minima that a lower bound would change."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return t < _moment(spine.end, 2)


def _moment(day: dt.date, shift: int) -> Column:
    return F.lit((day + dt.timedelta(days=shift)).isoformat() + " 00:00:00").cast("timestamp_ntz")


def bucket_point(df: DataFrame, ts: Column | str, spine: Spine, keep_index: bool = False) -> DataFrame:
    """Keep rows whose ``ts`` lies in a period (``start <= ts < end``).

    Adds ``start_interval`` / ``end_interval``.  Rows in the last second of
    a period (``end <= ts < next start``) and rows outside the spine belong
    to no period and are dropped — the same rows the cross join + range
    predicate form drops.  No join and no shuffle: the period index is
    computed per row.

    The test is written as ``explode`` of a 0-or-1 element array rather than
    a ``filter``: Catalyst pushes filters below projections by inlining the
    projected expression into every reference, which would evaluate an
    expensive ``ts`` (a time-zone conversion) once per comparison.  A
    generator is a barrier to that rewrite, so ``ts`` is evaluated once.
    """
    t = F.col(ts) if isinstance(ts, str) else ts

    def in_period(x: Column) -> Column:
        k = spine.index_of(x)
        return (k >= 0) & (k <= spine.last_index) & (x < spine.end_of(k))

    keep = [c for c in df.columns if c not in ("_t", "_k", "start_interval", "end_interval")]
    exploded = df.select(*keep, F.explode(F.filter(F.array(t), in_period)).alias("_t"))
    k = spine.index_of(F.col("_t"))
    out = exploded.select(*keep, *([k.alias("_k")] if keep_index else []),
                          spine.start_of(k).alias("start_interval"), spine.end_of(k).alias("end_interval"))
    return out


def explode_overlap(df: DataFrame, lo: Column | str, hi: Column | str, spine: Spine) -> DataFrame:
    """One row per period that the span ``[lo, hi]`` overlaps.

    Overlap is ``lo <= end_interval and hi >= start_interval`` (both
    inclusive).  Rows with a NULL bound, a reversed span or a span outside
    the spine produce no rows.  Output grows by at most ``spine.periods``
    per input row, computed per row — no join with the spine.  Bounds are
    evaluated once per row inside the generator (see :func:`bucket_point`).
    """
    lo_c = F.col(lo) if isinstance(lo, str) else lo
    hi_c = F.col(hi) if isinstance(hi, str) else hi

    def k_lo(x: Column) -> Column:
        k = spine.index_of(x)
        # a span starting inside the last second of its period starts in the next one
        k = k + F.when(x > spine.end_of(k), 1).otherwise(0)
        # clamp with CASE, not greatest(): a NULL bound must stay NULL
        return F.when(k < 0, F.lit(0).cast("long")).otherwise(k)

    def k_hi(x: Column) -> Column:
        k = spine.index_of(x)
        return F.when(k > spine.last_index, F.lit(spine.last_index).cast("long")).otherwise(k)

    def periods(s: Column) -> Column:
        a, b = k_lo(s["lo"]), k_hi(s["hi"])
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))

    bounds = F.array(F.struct(lo_c.alias("lo"), hi_c.alias("hi")))
    keep = [c for c in df.columns if c not in ("_k", "start_interval", "end_interval")]
    exploded = df.select(*keep, F.explode(F.flatten(F.transform(bounds, periods))).alias("_k"))
    k = F.col("_k")
    return exploded.select(*keep, spine.start_of(k).alias("start_interval"), spine.end_of(k).alias("end_interval"))
