"""Valid-time index and quadtree zones against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerlens.operators.validity import indexed_valid_time_join, valid_time_join, window_index
from ledgerlens.plans import geo

FACT = "id int, fk int, p timestamp_ntz"
DIM = "k int, v int, b timestamp_ntz, f timestamp_ntz"
START = dt.datetime(1990, 1, 1)


def at(r, days):
    return START + dt.timedelta(seconds=r.randrange(86400 * days))


def test_index_equals_the_plain_join(spark):
    r = random.Random(1)
    maybe = lambda v, p: None if r.random() < p else v
    facts = [(i, maybe(r.randrange(6), 0.1), maybe(at(r, 4000), 0.1)) for i in range(400)] * 2  # repeated facts stay
    dims = []
    for i in range(300):
        b = at(r, 4000)
        f = b + dt.timedelta(days=r.choice([-3, -1, 0, 1, 30, 500, 520, 2000]), seconds=r.choice([0, 0, 5]))
        dims.append((maybe(r.randrange(5), 0.05), i, maybe(b, 0.1), maybe(f, 0.1)))
    dims += [(1, 1000, dims[0][2], dims[0][3])] * 2  # equal windows match twice
    fact, dim = spark.createDataFrame(facts, FACT), spark.createDataFrame(dims, DIM)
    args = ("fk", "k", "p", "b", "f")
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(valid_time_join(fact, dim, *args))
    assert rows(indexed_valid_time_join(fact, dim, *args)) == want and len(want) > 2000
    assert rows(indexed_valid_time_join(fact, dim, *args, bin_days=1)) == want
    none = dim.limit(0)
    assert rows(indexed_valid_time_join(fact, none, *args)) == rows(valid_time_join(fact, none, *args))


def test_a_key_with_ten_thousand_windows(spark):
    """Windows of three days, one after the other, on one key: a fact is tested against those of its bin only."""
    n = 10_000
    dim = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("v"),
                                F.timestamp_add("DAY", F.col("id") * 3, F.lit("1990-01-01").cast("timestamp_ntz")).alias("b"),
                                F.timestamp_add("DAY", F.col("id") * 3 + 2, F.lit("1990-01-01").cast("timestamp_ntz")).alias("f"))
    binned, long = window_index(dim, "k", "b", "f")
    assert long.count() == 0 and binned.agg(F.max(F.size("i_windows"))).first()[0] <= 13
    assert binned.agg(F.sum(F.size("i_windows"))).first()[0] < 1.2 * n
    r = random.Random(2)
    facts = [(i, 1, at(r, 30_000)) for i in range(2000)]
    got = indexed_valid_time_join(spark.createDataFrame(facts, FACT), dim, "fk", "k", "p", "b", "f")
    last = lambda p: p.time() == dt.time(23, 59, 59) and (p - START).days % 3 == 2
    assert {(x.id, x.v) for x in got.collect()} == {(i, None if last(p) else (p - START).days // 3) for i, _, p in facts}


def crosses(x, y, rings):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def box(x, y, s):
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def test_zones_of_very_unlike_sizes_and_holes(spark):
    r = random.Random(4)
    star = [[500 + 300 * (1 if i % 2 else 0.3) * c, 500 + 300 * (1 if i % 2 else 0.3) * s] for i, (c, s) in enumerate(
        [(1, 0), (.7, .7), (0, 1), (-.7, .7), (-1, 0), (-.7, -.7), (0, -1), (.7, -.7)])]
    zones = [(1, "land", [box(0.0, 0.0, 1000.0), box(100.0, 100.0, 300.0), box(150.0, 150.0, 50.0)]),  # an island in its lake
             (2, "star", [[*star, star[0]]]), (3, "plot", [box(500.125, 500.25, 0.01)]), (4, "below", [box(-70.0, -3.0, 2.5)]),
             (5, "line", [[[1.0, 1.0], [9.0, 1.0], [1.0, 1.0]]]), (6, "point", [[[3.0, 3.0], [3.0, 3.0]]]), (7, "shared edge", [box(64.0, 64.0, 64.0)])]
    points = [(r.uniform(-100, 1100), r.uniform(-100, 1100)) for _ in range(3000)]
    points += [(500.125 + r.random() * 0.012, 500.25 + r.random() * 0.012) for _ in range(300)]
    points += [(float(r.randrange(0, 257, 16)), float(r.randrange(0, 257, 16))) for _ in range(300)]  # corners of cells and zones
    points += [(-70 + r.random() * 3, -3 + r.random() * 3) for _ in range(100)]
    frame = geo.zones_frame(spark, zones)
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "point_id long, x double, y double")
    got = sorted(tuple(h) for h in geo.points_in_zones(pts, frame).collect())
    assert got == sorted((i, z) for i, (x, y) in enumerate(points) for z, _, rings in zones if crosses(x, y, rings))
    cells = geo.zone_cells(frame).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("whole"), 1)).alias("whole")).collect()
    assert max(c.n for c in cells) < 700 and {c.zone_id: c.whole for c in cells}[1] > 10
    assert geo.points_in_zones(pts, frame.limit(0)).count() == 0 and geo.points_in_zones(pts.limit(0), frame).count() == 0
