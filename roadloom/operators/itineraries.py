"""Itineraries: the waypoints that a search is sent through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import bearing, destination
from roadloom.operators.proximity import nearest
from roadloom.sources.rules import Rules

# The highways that waypoints are snapped to, and how near a waypoint counts as reached.
WAYPOINT_HIGHWAYS = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified")
RADIUS_M = 3000.0
#: Waypoints this near to the direction of the other end are left out.
ASIDE_DEG = 20


def snapped(places: DataFrame, points: DataFrame, rules: Rules, avoid_residential: bool) -> DataFrame:
    """places (query_id, lat, lon) with the road point each snaps to: (query_id, id, lat, lon of the point)."""
    found = nearest(places, points, rules, avoid_residential, WAYPOINT_HIGHWAYS)
    return found.join(points.select("id", "lat", "lon"), "id").select("query_id", "id", "lat", "lon")


def around(ends: DataFrame, rules: Rules) -> DataFrame:
    """(query_id, side, deg, dist, lat, lon): where waypoints are looked for. ends: (side, lat, lon, from_other: the bearing
    from the other end). Bearings are compared without going around 360."""
    made = rules.generation.waypoint_generation.start_finish
    degs = F.explode(F.array(*(F.lit(float(d)) for d in made.variation_bearing_deg)) if made.variation_bearing_deg else F.array().cast("array<double>"))
    dists = F.explode(F.array(*(F.lit(float(d)) for d in made.variation_distances_m)) if made.variation_distances_m else F.array().cast("array<double>"))
    each = ends.withColumn("deg", degs).filter(F.abs(F.col("deg") - F.col("from_other")) > ASIDE_DEG).withColumn("dist", dists)
    lat, lon = destination(F.col("lat"), F.col("lon"), F.col("deg"), F.col("dist"))
    return each.select(F.concat_ws("/", "side", "deg", "dist").alias("query_id"), "side", "deg", "dist", lat.alias("lat"), lon.alias("lon"))


def itinerary_id(start, waypoints, finish):
    return F.concat_ws("-", start.cast("string"), F.array_join(waypoints.cast("array<string>"), "-"), finish.cast("string"))


def start_finish(start: tuple, finish: tuple, points: DataFrame, rules: Rules | None = None, avoid_residential: bool = False) -> DataFrame:
    """(itin_id, start, finish, waypoints, radius, visit_all): the direct one, and one for each waypoint near the start with
    each near the finish. start and finish: (id, lat, lon)."""
    rules = rules or Rules()
    spark = points.sparkSession
    ends = spark.createDataFrame([("from", *map(float, start[1:]), *map(float, finish[1:])), ("to", *map(float, finish[1:]), *map(float, start[1:]))], "side string, lat double, lon double, olat double, olon double")
    ends = ends.withColumn("from_other", bearing(F.col("olat"), F.col("olon"), F.col("lat"), F.col("lon")))
    places = around(ends, rules)
    found = places.select("query_id", "side", "deg", "dist").join(snapped(places, points, rules, avoid_residential).select("query_id", "id"), "query_id")
    sides = found.groupBy(F.lit(1).alias("one")).agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("deg", "dist", "id")))).alias(s) for s in ("from", "to")))
    # A few dozen waypoints on each side: their pairs are the elements of two arrays in one row.
    pairs = sides.select(F.explode("from").alias("f"), "to").select("f", F.explode("to").alias("t")).select(F.array("f.id", "t.id").alias("waypoints"))
    direct = spark.createDataFrame([([],)], "waypoints array<bigint>")
    return _finished(direct.unionByName(pairs), start[0], finish[0], visit_all=False)


def round_trip(start: tuple, towards: float, metres: float, points: DataFrame, rules: Rules | None = None, avoid_residential: bool = False, adjustment: float = 0.0) -> DataFrame:
    """Itineraries from start back to it: a tip in about the direction asked for, and a point on either side of it, each at
    every ratio of a fifth of the distance. Left out where one of the three has no road point."""
    rules = rules or Rules()
    spark, made = points.sparkSession, rules.generation.waypoint_generation.round_trip
    base = towards + adjustment
    base = 360 - abs(base) if base < 0 else base
    ratios = F.array(*(F.lit(float(r)) for r in made.variation_distance_ratios))
    turns = F.array(*(F.lit(float(b)) for b in made.variation_bearing_deg))
    sides = F.array(*(F.struct(F.lit(k).alias("which"), F.lit(d).alias("aside")) for k, d in (("left", -45.0), ("tip", 0.0), ("right", 45.0))))
    spots = spark.range(1).select(F.explode(turns).alias("turn")).withColumn("ratio", F.explode(ratios)).withColumn("s", F.explode(sides))
    lat, lon = destination(F.lit(float(start[1])), F.lit(float(start[2])), F.lit(base) + F.col("turn") + F.col("s.aside"), F.lit(metres / 5) * F.col("ratio"))
    places = spots.select(F.concat_ws("/", "s.which", "turn", "ratio").alias("query_id"), "s.which", "turn", "ratio", lat.alias("lat"), lon.alias("lon"))
    found = places.select("query_id", "which", "turn", "ratio").join(snapped(places, points, rules, avoid_residential).select("query_id", "id"), "query_id")
    part = lambda which: found.filter(F.col("which") == which).select("turn", F.col("ratio").alias(f"{which}_ratio"), F.col("id").alias(which))
    trips = part("left").join(part("tip"), "turn").join(part("right"), "turn")
    return _finished(trips.select(F.array("left", "tip", "right").alias("waypoints")), start[0], start[0], visit_all=True)


def _finished(rows: DataFrame, start: int, finish: int, visit_all: bool) -> DataFrame:
    out = rows.select(F.lit(start).cast("long").alias("start"), F.lit(finish).cast("long").alias("finish"), "waypoints", F.lit(RADIUS_M).alias("radius"), F.lit(visit_all).alias("visit_all"))
    return out.withColumn("itin_id", itinerary_id(F.col("start"), F.col("waypoints"), F.col("finish")))
