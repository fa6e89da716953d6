"""Month-partitioned sink (dynamic overwrite)."""

import datetime as dt
import pathlib
import tempfile

from ledgerlens.operators.spine import Spine
from ledgerlens.plans import service
from ledgerlens.sources.fixtures import Domain
from ledgerlens.sources import sinks
from ledgerlens.sources.sinks import read_mart, vacuum_mart, write_mart

from .test_marts import SR, sr_row

SPINE = Spine(dt.date(2000, 1, 1), dt.datetime(2000, 7, 15), "month", 1)


def _dom(spark, rows):
    return Domain.from_tables(spark, {"service_requests": spark.createDataFrame(rows, SR)})


def test_write_mart_dynamic_overwrite(spark):
    out = tempfile.mkdtemp(prefix="mart-")
    first = [sr_row(1, 1, 1, arrived="2000-02-10 12:00:00"), sr_row(2, 2, 2, arrived="2000-03-10 12:00:00")]
    write_mart(service.mart_sr_monthly_count(_dom(spark, first), SPINE), out)
    # re-run March only: February must survive
    march = [sr_row(2, 2, 2, arrived="2000-03-10 12:00:00"), sr_row(3, 3, 3, arrived="2000-03-11 12:00:00")]
    write_mart(service.mart_sr_monthly_count(_dom(spark, march), SPINE), out)
    got = sorted((r.start_interval, r.order_id) for r in read_mart(spark, out).collect())
    assert got == [(dt.date(2000, 2, 1), 1), (dt.date(2000, 3, 1), 2), (dt.date(2000, 3, 1), 3)]
    assert read_mart(spark, out, [dt.date(2000, 2, 1)]).count() == 1


def test_rerun_empties_its_months_and_leaves_the_session_alone(spark):
    out = tempfile.mkdtemp(prefix="mart-")
    rows = [sr_row(1, 1, 1, arrived="2000-02-10 12:00:00"), sr_row(2, 2, 2, arrived="2000-03-10 12:00:00")]
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    write_mart(service.mart_sr_monthly_count(_dom(spark, rows), SPINE), out)
    later = Spine(dt.date(2000, 3, 1), dt.datetime(2000, 4, 15), "month", 1)  # March has no request any more
    write_mart(service.mart_sr_monthly_count(_dom(spark, rows[:1]), later), out, months=[dt.date(2000, 3, 1), dt.date(2000, 4, 1)])
    assert [r.start_interval for r in read_mart(spark, out).collect()] == [dt.date(2000, 2, 1)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def _mart(spark, rows):
    return spark.createDataFrame(rows, "start_interval date, order_id long")


def test_the_mart_is_computed_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = _mart(spark, [(dt.date(2000, 1 + i % 3, 1), i) for i in range(30)]).mapInArrow(count, "start_interval date, order_id long")
    out = tempfile.mkdtemp(prefix="mart-")
    write_mart(df.withColumn("x", F.lit(1)), out, months=[dt.date(2000, m, 1) for m in range(1, 6)])
    assert seen.value == 30 and read_mart(spark, out).count() == 30


def test_a_run_that_dies_leaves_the_months_as_they_were(spark, monkeypatch):
    out = tempfile.mkdtemp(prefix="mart-")
    write_mart(_mart(spark, [(dt.date(2000, 1, 1), 1), (dt.date(2000, 2, 1), 2)]), out)
    before = sorted(read_mart(spark, out).collect())
    for dies in ("publish", "names"):
        with monkeypatch.context() as m:
            m.setattr(sinks._Store, dies, lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
            try:
                write_mart(_mart(spark, [(dt.date(2000, 2, 1), 9)]), out, months=[dt.date(2000, 1, 1)])
            except KeyboardInterrupt:
                pass
        assert sorted(read_mart(spark, out).collect()) == before
    assert len(vacuum_mart(spark, out)) == 2 and sorted(read_mart(spark, out).collect()) == before


def test_two_runs_at_once_both_count(spark, monkeypatch):
    """A run that publishes between another's look and its rename is merged, not lost."""
    out = tempfile.mkdtemp(prefix="mart-")
    real, raced = sinks._latest, []

    def latest(store):
        got = real(store)
        if not raced:
            raced.append(1)
            write_mart(_mart(spark, [(dt.date(2000, 3, 1), 3)]), out)
        return got

    monkeypatch.setattr(sinks, "_latest", latest)
    write_mart(_mart(spark, [(dt.date(2000, 4, 1), 4)]), out)
    assert sorted(r.order_id for r in read_mart(spark, out).collect()) == [3, 4]


def test_all_months_emptied(spark):
    out = tempfile.mkdtemp(prefix="mart-")
    write_mart(_mart(spark, [(dt.date(2000, 1, 1), 1)]), out)
    write_mart(_mart(spark, []), out, months=[dt.date(2000, 1, 1)])
    got = read_mart(spark, out)
    assert got.count() == 0 and got.columns == ["start_interval", "order_id"]
    assert len(vacuum_mart(spark, out, keep=1)) == 2 and read_mart(spark, out).count() == 0


def test_small_months_are_single_files(spark):
    out = pathlib.Path(tempfile.mkdtemp(prefix="mart-"))
    rows = [sr_row(i, i, 1, arrived=f"2000-0{1 + i % 5}-10 12:00:00") for i in range(200)]
    df = service.mart_sr_monthly_count(_dom(spark, rows), SPINE).repartition(16)
    write_mart(df, str(out))
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in out.glob("runs/run=*/start_interval=*"))


def test_domain_from_parquet(spark):
    import os

    from ledgerlens.sources.tables import domain_from_parquet

    root = tempfile.mkdtemp(prefix="lake-")
    rows = [sr_row(1, 1, 1, arrived="2000-02-10 12:00:00"), sr_row(2, 2, 2, arrived="2000-03-10 12:00:00")]
    spark.createDataFrame(rows, SR).write.parquet(os.path.join(root, "service_requests"))
    dom = domain_from_parquet(spark, root, ("service_requests",))
    assert service.mart_sr_monthly_count(dom, SPINE).count() == 2
