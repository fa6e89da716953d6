"""Zone polygons: features, vertices, properties (Z1-Z3) and a point-in-zone
count (Z4).

Z4 is a spatial join over quadtree cells.  Each zone starts from at most 25 cells of a quarter of its own size; a cell that an edge
touches is split in sixteen, ``SPLITS`` times, a cell that none touches is inside as a whole or dropped.  So a zone has a few
hundred cells whatever its extent, coarse inside and fine at the edge.  Every point gets its cell on each level in use and meets the cells on an
equi-join; only points in edge cells take the even-odd test, over all rings, so holes are holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.fixtures import Domain


def geo_features(fc: DataFrame) -> DataFrame:
    f = fc.select("source", F.posexplode("features").alias("feature_index", "f"))
    return f.select("source", "feature_index", F.col("f.type").alias("type"),
                    F.col("f.geometry.type").alias("geometry_type"),
                    F.col("f.properties").getItem("Area Name").alias("name"),
                    F.size("f.geometry.coordinates").alias("ring_count"))


def geo_vertices(fc: DataFrame) -> DataFrame:
    f = fc.select("source", F.posexplode("features").alias("feature_index", "f"))
    r = f.select("source", "feature_index", F.posexplode("f.geometry.coordinates").alias("ring_index", "ring"))
    v = r.select("source", "feature_index", "ring_index", F.posexplode("ring").alias("vertex_index", "xy"))
    return v.select("source", "feature_index", "ring_index", "vertex_index",
                    F.col("xy")[0].alias("lon"), F.col("xy")[1].alias("lat"))


def geo_properties(fc: DataFrame) -> DataFrame:
    f = fc.select("source", F.posexplode("features").alias("feature_index", "f"))
    return f.select("source", "feature_index", F.explode("f.properties").alias("key", "value"))


# Fixed zones of the point-in-zone query (our own shapes, in the unit
# square scaled by 10 that the event points fill): closed rings, holes after the outer one.
ZONES = [
    (1, "north_block", [[[1.0, 5.0], [6.0, 5.5], [6.5, 9.0], [2.0, 9.5], [1.0, 5.0]]]),
    (2, "river_bend", [[[5.0, 0.5], [9.5, 1.0], [9.0, 4.5], [7.0, 2.5], [5.5, 4.0], [5.0, 0.5]]]),
    (3, "far_field", [[[20.0, 20.0], [21.0, 20.0], [21.0, 21.0], [20.0, 20.0]]]),  # no event point lies here
    (4, "ring_road", [[[0.5, 0.5], [9.5, 0.25], [9.75, 9.5], [0.25, 9.75], [0.5, 0.5]],
                      [[3.0, 3.0], [7.0, 3.5], [6.5, 7.0], [3.5, 6.5], [3.0, 3.0]]]),
]


def zones_frame(spark, zones=None) -> DataFrame:
    """Zones (zone_id, zone_name, rings) with their bounding boxes."""
    schema = T.StructType([T.StructField("zone_id", T.IntegerType()), T.StructField("zone_name", T.StringType()),
                           T.StructField("rings", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
    z = spark.createDataFrame(ZONES if zones is None else zones, schema)
    points = F.flatten("rings")
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return z.select("zone_id", "zone_name", "rings", F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"),
                    F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


def event_points(dom: Domain) -> DataFrame:
    e = dom.raw("events").select("event_id")
    k = F.col("event_id")
    return e.select(k.alias("point_id"), ((k * 7919) % 1000 / F.lit(100.0)).alias("x"),
                    ((k * 104729) % 1000 / F.lit(100.0)).alias("y"))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over the edges (ring[i], ring[i+1]) of a closed ring."""
    def step(acc, i):
        p, q = ring[i], ring[i + 1]
        x1, y1, x2, y2 = p[0], p[1], q[0], q[1]
        crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        return acc != crosses

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(False), step)


def edges(rings: Column) -> Column:
    """Sides of all closed rings: array of (x1, y1, x2, y2)."""
    def sides(ring: Column) -> Column:
        return F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda p, i: F.struct(
            p[0].alias("x1"), p[1].alias("y1"), ring[i + 1][0].alias("x2"), ring[i + 1][1].alias("y2")))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), sides))


def within(x: Column, y: Column, sides: Column) -> Column:
    """Even-odd rule over the sides of all rings of a polygon."""
    def step(acc, e):
        crosses = ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
        return acc != crosses

    return F.aggregate(sides, F.lit(False), step)


def _touches(e: Column, x: Column, y: Column, s: Column) -> Column:
    """Whether a side may touch the square of size ``s`` at (x, y), its border included."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    near = ((F.least(e["x1"], e["x2"]) <= x + s) & (F.greatest(e["x1"], e["x2"]) >= x)
            & (F.least(e["y1"], e["y2"]) <= y + s) & (F.greatest(e["y1"], e["y2"]) >= y))
    off = [dx * (cy - e["y1"]) - dy * (cx - e["x1"]) for cx in (x, x + s) for cy in (y, y + s)]
    slack = (F.abs(dx) + F.abs(dy)) * s * 1e-9
    return near & (F.least(*off) <= slack) & (F.greatest(*off) >= -slack)


SPLITS = 1
#: Levels between a cell and its parts, and between a zone's extent and its coarsest cells.
STEP = 2


def zone_level() -> Column:
    """Level of a zone's coarsest cells: a quarter of the least power of two that its extent fits in."""
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-6))
    return (F.ceil(F.log2(extent)) - STEP).cast("int")


def zone_cells(zones: DataFrame, splits: int = SPLITS) -> DataFrame:
    """Quadtree cells of each zone: (zone_id, level, cx, cy, whole, sides).

    A cell is the square [cx, cx + 1) x [cy, cy + 1) times 2 ^ level.  ``whole`` cells lie inside the zone; the others, on its edge, carry
    the zone's sides for the test of a point.  Cells of one zone don't overlap.
    """
    size = lambda level: F.pow(F.lit(2.0), level)
    cells = zones.select("zone_id", edges(F.col("rings")).alias("sides"), zone_level().alias("level"), "min_x", "max_x", "min_y", "max_y")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size(F.col("level"))), F.floor(F.col(hi) / size(F.col("level"))))
    cells = cells.withColumn("cx", F.explode(span("min_x", "max_x"))).withColumn("cy", F.explode(span("min_y", "max_y")))
    cells = cells.select("zone_id", "sides", F.col("sides").alias("near"), F.struct("level", "cx", "cy", F.lit("open").alias("state")).alias("c"))
    for left in range(splits, -1, -1):
        s = size(F.col("c.level"))
        x, y = F.col("c.cx") * s, F.col("c.cy") * s
        open_ = F.col("c.state") == "open"
        cells = cells.select("zone_id", "sides", "c", F.when(open_, F.filter("near", _toucher(x, y, s))).alias("near"))
        state = F.when(~open_, F.col("c.state")).when(F.size("near") > 0, "open").when(within(x + s / 2, y + s / 2, F.col("sides")), "whole")
        cells = cells.withColumn("state", state).filter(F.col("state").isNotNull())
        own = F.struct(F.col("c.level").alias("level"), F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"), F.col("state").alias("state"))
        side, part = 1 << STEP, F.sequence(F.lit(0).cast("long"), F.lit((1 << 2 * STEP) - 1).cast("long"))
        split = F.transform(part, lambda i: F.struct(
            (F.col("c.level") - STEP).cast("int").alias("level"), (F.col("c.cx") * side + i % side).alias("cx"),
            (F.col("c.cy") * side + F.floor(i / side)).alias("cy"), F.lit("open").alias("state")))
        cells = cells.select("zone_id", "sides", "near", F.explode(
            F.when(F.col("state") == "open", split).otherwise(F.array(own)) if left else F.array(own)).alias("c"))
    whole = F.col("c.state") == "whole"
    return cells.select("zone_id", F.col("c.level").alias("level"), F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"), whole.alias("whole"),
                        F.when(~whole, F.col("sides")).alias("sides"))


def _toucher(x: Column, y: Column, s: Column):
    return lambda e: _touches(e, x, y, s)


def points_in_zones(points: DataFrame, zones: DataFrame, splits: int = SPLITS) -> DataFrame:
    """(point_id, zone_id) of every point (point_id, x, y) in every zone that it lies in."""
    # a few dozen numbers at most: powers of two; a zone's levels are that of its coarsest cells and those of its splits
    own = [r[0] for r in zones.select(zone_level()).distinct().collect()]
    levels = F.lit(sorted({k - STEP * i for k in own for i in range(splits + 1)})).cast("array<int>")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level")))
    placed = points.select("point_id", "x", "y", F.explode(levels).alias("level")).withColumns({"cx": at("x"), "cy": at("y")})
    met = placed.join(zone_cells(zones, splits), ["level", "cx", "cy"])
    return met.filter(F.col("whole") | within(F.col("x"), F.col("y"), F.col("sides"))).select("point_id", "zone_id")


def geo_zone_join(dom: Domain) -> DataFrame:
    """Event points per zone; zones without points count 0."""
    zones = zones_frame(dom.spark)
    hits = points_in_zones(event_points(dom), zones).groupBy(F.col("zone_id").alias("hit_zone")).agg(F.count(F.lit(1)).alias("n"))
    return (zones.join(hits, zones["zone_id"] == hits["hit_zone"], "left")
            .select("zone_id", "zone_name", F.coalesce("n", F.lit(0)).alias("n_points")))
