"""Measures of routes. A route is its segments: (route_id, seq, line, end_point, ...), one row each, in order of seq.

Segments carry what the measures need: start_lat, start_lon, end_lat, end_lon, len_m, highway, surface, smoothness, name,
ref, junction and residential (of the end point). Windows run within a route, whose length the search's step limit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import bearing, haversine
from roadloom.sources.rules import FAMILIES, Rules

#: Two sides of a divided road are one place if they are this near and this many segments apart.
LOOP_M, LOOP_SEGMENTS = 50.0, 10
BUCKETS = 10
#: Lengths are added as whole metres and as parts of a metre.
METRE_PARTS = 1 << 40


def along() -> Window:
    return Window.partitionBy("route_id").orderBy("seq")


def back() -> Window:
    return Window.partitionBy("route_id").orderBy(F.desc("seq"))


def whole() -> Window:
    return Window.partitionBy("route_id")


def added(len_m: Column, over=lambda x: x) -> Column:
    """The sum of lengths (finite, under 2^52 m), the same in whatever order they come: integers are added, not floating-point numbers."""
    metres = F.floor(len_m)
    return over(F.sum(metres)) + over(F.sum(F.round((len_m - metres) * METRE_PARTS).cast("long"))) / METRE_PARTS


def totals(segments: DataFrame) -> DataFrame:
    """(route_id, len_m, junctions)."""
    return segments.groupBy("route_id").agg(added(F.col("len_m")).alias("len_m"), F.count_if("junction").alias("junctions"))


def tag_shares(segments: DataFrame) -> DataFrame:
    """(route_id, family, value, len_m, percentage): the route's length by each tag; what has none is ``unknown``."""
    pairs = F.array(*(F.struct(F.lit(f).alias("family"), F.coalesce(f, F.lit("unknown")).alias("value")) for f in FAMILIES))
    by = segments.select("route_id", "len_m", F.explode(pairs).alias("t")).groupBy("route_id", "t.family", "t.value").agg(added(F.col("len_m")).alias("len_m"))
    total = added(F.col("len_m"), lambda x: x.over(Window.partitionBy("route_id", "family")))
    return by.withColumn("percentage", F.when(total > 0, F.col("len_m") / total * 100))


def reverse_bearing(start_lat="start_lat", start_lon="start_lon", end_lat="end_lat", end_lon="end_lon") -> Column:
    """A segment's bearing as routes are scored by: from its end back to its start."""
    return bearing(F.col(end_lat), F.col(end_lon), F.col(start_lat), F.col(start_lon))


def _priority(rules: Rules, family: str) -> Column:
    known = rules.priorities(family)
    if not known:
        return F.lit(0.0)
    pairs = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, v / 255.0)))
    return F.coalesce(F.when(F.col(family).isNotNull(), pairs[F.col(family)]), F.lit(0.0))


def scores(segments: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(route_id, score): how much a route bends, in degrees a kilometre. A bend of 90 degrees or more is a turn and counts
    nothing; bends on preferred roads count more. What comes after a junction or a residential stretch starts anew."""
    rules = rules or Rules()
    reset = F.col("junction") | F.coalesce((F.col("highway") == "residential") | (F.col("residential") & F.col("highway").isNotNull()), F.lit(False))
    seen = segments.withColumn("b", reverse_bearing()).withColumn("held", F.when(~reset, F.col("b")))
    turn = F.abs(F.lag("held").over(along()) - F.col("b"))
    more = 1 + sum((_priority(rules, f) for f in FAMILIES), F.lit(0.0))
    bends = seen.withColumn("bend", F.when(turn < 90, turn * more).otherwise(0.0))
    return bends.groupBy("route_id").agg((F.sum("bend") / F.nullif(F.sum("len_m"), F.lit(0.0)) * 1000).alias("score"))


def same_road(a_ref: Column, b_ref: Column, a_name: Column, b_name: Column) -> Column:
    """Whether two lines share a ref or a name that both have."""
    return F.coalesce(a_ref == b_ref, F.lit(False)) | F.coalesce(a_name == b_name, F.lit(False))


def loops(segments: DataFrame) -> DataFrame:
    """(route_id, looped): whether the route's end was passed before, or is beside an earlier point of the same road."""
    last = segments.groupBy("route_id").agg(F.max_by(F.struct("seq", "end_point", "end_lat", "end_lon", "ref", "name"), "seq").alias("z"))
    each = segments.join(last, "route_id")
    near = haversine(F.col("end_lat"), F.col("end_lon"), F.col("z.end_lat"), F.col("z.end_lon")) < LOOP_M
    far = F.col("z.seq") - F.col("seq") > LOOP_SEGMENTS
    hit = (F.col("seq") < F.col("z.seq")) & ((F.col("end_point") == F.col("z.end_point")) | (near & far & same_road(F.col("ref"), F.col("z.ref"), F.col("name"), F.col("z.name"))))
    return each.groupBy("route_id").agg(F.bool_or(hit).alias("looped"))


def detours(segments: DataFrame, forks: DataFrame, within_m: float) -> DataFrame:
    """(route_id, back): whether a fork (route_id, fork_ref, fork_name) leads back to a road that the route left no further
    than within_m ago."""
    step = haversine(F.col("end_lat"), F.col("end_lon"), F.lead("end_lat").over(along()), F.lead("end_lon").over(along()))
    each = segments.withColumn("step", F.coalesce(step, F.lit(0.0)))
    each = each.withColumn("run", F.sum("step").over(back())).withColumn("place", F.row_number().over(back()))
    each = each.join(forks, "route_id")
    on = same_road(F.col("ref"), F.col("fork_ref"), F.col("name"), F.col("fork_name"))
    first = F.min(F.when(on, F.struct("place", "run")))
    return each.groupBy("route_id").agg(first.alias("f")).select("route_id", F.coalesce((F.col("f.place") > 1) & (F.col("f.run") <= within_m), F.lit(False)).alias("back"))


def junctions_back(segments: DataFrame, k: int) -> DataFrame:
    """(route_id, seq, end_point): the segment at the k-th junction from the end; routes of k segments or fewer, or of fewer
    junctions, have none."""
    counted = segments.withColumn("n", F.sum(F.col("junction").cast("int")).over(back())).withColumn("size", F.count("*").over(whole()))
    return counted.filter((F.col("junction")) & (F.col("n") == k) & (F.col("size") > k)).select("route_id", "seq", "end_point")


def segments_back(segments: DataFrame, k: int) -> DataFrame:
    """(route_id, seq, end_point): the segment k before the last."""
    return segments.withColumn("n", F.row_number().over(back())).filter(F.col("n") == k + 1).select("route_id", "seq", "end_point")


def last_chunk(segments: DataFrame) -> DataFrame:
    """segments from the last junction that isn't the route's end on; the whole route if there is none."""
    end = F.last("end_point").over(along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = segments.withColumn("z", end)
    since = F.coalesce(F.max(F.when(F.col("junction") & (F.col("end_point") != F.col("z")), F.col("seq"))).over(whole()), F.lit(-1))
    return marked.withColumn("since", since).filter(F.col("seq") >= F.col("since")).drop("z", "since")


def since_point(segments: DataFrame, points: DataFrame) -> DataFrame:
    """segments from the first one that ends in the route's point (route_id, point) on; all, if none does."""
    each = segments.join(points, "route_id")
    first = F.coalesce(F.min(F.when(F.col("end_point") == F.col("point"), F.col("seq"))).over(whole()), F.lit(-1))
    return each.withColumn("from_seq", first).filter(F.col("seq") >= F.col("from_seq")).drop("from_seq", "point")


def approximation(segments: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(route_id, bucket, lat, lon): the mean end points of ``buckets`` even parts of a route; short routes lack some."""
    ordered = segments.withColumn("i", F.row_number().over(along()) - 1).withColumn("n", F.count("*").over(whole()))
    # Part b holds the places from int(b * n / buckets) to before int((b + 1) * n / buckets).
    part = F.floor(((F.col("i") + 1) * buckets - 1) / F.col("n")).cast("int")
    return ordered.groupBy("route_id", part.alias("bucket")).agg(F.avg("end_lat").alias("lat"), F.avg("end_lon").alias("lon"))


def coordinates(segments: DataFrame) -> DataFrame:
    """(route_id, coords): the end points in order; the start isn't one."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon"))))
    return segments.groupBy("route_id").agg(F.transform(rows, lambda r: F.struct(r["lat"].alias("lat"), r["lon"].alias("lon"))).alias("coords"))


def statistics(segments: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(route_id, len_m, junctions, highway, surface, smoothness, score): totals, maps of value to (len_m, percentage), score."""
    shares = tag_shares(segments)
    maps = [F.map_from_entries(F.filter(F.collect_list(F.when(F.col("family") == f, F.struct("value", F.struct("len_m", "percentage")))), lambda x: x.isNotNull())).alias(f) for f in FAMILIES]
    return totals(segments).join(shares.groupBy("route_id").agg(*maps), "route_id").join(scores(segments, rules), "route_id")
