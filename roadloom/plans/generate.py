"""Route generation from end to end: snap, plan itineraries, search, measure, cluster, pick."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import clusters, graph, itineraries, navigate, proximity, routes, trace
from roadloom.operators.itineraries import WAYPOINT_HIGHWAYS
from roadloom.plans.networks import Network
from roadloom.sources.rules import Rules


#: Segments of a request's routes that are kept as a local table, of some 150 bytes each.
FEW_SEGMENTS = 500_000


class NoRoad(ValueError):
    """There is no road point near a coordinate."""


@dataclass
class Roads:
    """A network's graph, as tables."""

    nodes: DataFrame
    lines: DataFrame
    restrictions: DataFrame
    degrees: DataFrame

    @classmethod
    def of(cls, net: Network) -> Roads:
        lines = graph.lines(net.ways, net.nodes)
        broken = graph.first_gaps(graph.roads(net.ways), net.nodes).select("way_id")
        return cls(net.nodes, lines, graph.restrictions(net.relations, lines, net.nodes, broken), graph.degrees(lines))

    def points(self) -> DataFrame:
        return proximity.grid(self.nodes, self.lines)


def snap(points: DataFrame, lat: float, lon: float, rules: Rules) -> tuple[int, float, float]:
    place = points.sparkSession.createDataFrame([("q", float(lat), float(lon))], "query_id string, lat double, lon double")
    found = proximity.nearest(place, points, rules, False, WAYPOINT_HIGHWAYS).join(points.select("id", "lat", "lon"), "id").first()
    if found is None:
        raise NoRoad(f"no road near {lat},{lon}")
    return found["id"], found["lat"], found["lon"]


def _cut(rows: DataFrame) -> DataFrame:
    """rows, computed once, without the plan that made them where the session has a checkpoint folder."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()


def vectors(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """(itin_id, vector): the coordinates of an itinerary's waypoints in order; direct ones have none."""
    each = trips.select("itin_id", F.posexplode("waypoints").alias("pos", "id")).join(nodes.select("id", "lat", "lon"), "id")
    rows = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon")))
    return each.groupBy("itin_id").agg(F.flatten(F.transform(rows, lambda p: F.array(p["lat"], p["lon"]))).alias("vector"))


def generate(roads: Roads, rules: Rules, start: tuple[float, float], finish: tuple[float, float] | None = None, towards: float = 0.0, metres: float = 0.0, trace_to: str | None = None) -> DataFrame:
    """(route_id, coords, len_m, junctions, highway, surface, smoothness, score, label): the best routes from start to
    finish, or, without a finish, of a round trip of some metres towards a bearing.

    Rounds are tried with and without residential waypoints, round trips also in other directions, until enough routes are
    found. A round's itineraries are deduped by clusters of their waypoints before they are searched. trace_to: a folder that
    gets every decision of the searches.
    """
    spark = roads.nodes.sparkSession
    # What all steps read: plans made of these are short, where each would hold the network's making several times over.
    nodes, lines = _cut(roads.nodes), _cut(roads.lines)
    roads = Roads(nodes, lines, roads.restrictions, _cut(graph.degrees(lines)))
    points = _cut(roads.points())
    begin = snap(points, *start, rules)
    end = None if finish is None else snap(points, *finish, rules)
    compact = navigate.compact(roads.nodes, roads.lines, roads.restrictions)
    retry = rules.generation.route_generation_retry
    turns = [0.0] + (retry.round_trip_adjustment_bearing_deg if finish is None else [])
    found, enough, rounds = None, 0, 0
    for avoid in retry.avoid_residential:
        for turn in turns:
            if enough and enough >= retry.trigger_min_route_count:
                break
            trips = itineraries.round_trip(begin, towards, metres, points, rules, avoid, turn) if end is None else itineraries.start_finish(begin, end, points, rules, avoid)
            trips = _cut(trips.dropDuplicates(["itin_id"]))
            labels = clusters.labelled(vectors(trips, points), "itin_id", "vector", clusters.ITINERARY_EPSILON)
            chosen = clusters.deduped(trips, labels)
            searched = _cut(navigate.search(chosen, compact, rules))
            if trace_to:
                told = navigate.traced(chosen, compact, rules).persist()
                for name in navigate.TRACE_TABLES:
                    trace.write(navigate.trace_table(told, name), name, trace_to, rounds)
                told.unpersist()
            rounds += 1
            enough += searched.filter("status = 'finished'").select("itin_id").distinct().count()
            named = searched.withColumn("itin_id", F.concat(F.lit(f"{int(avoid)}/{turn:g}/"), "itin_id"))
            found = named if found is None else found.unionByName(named)
    if found is None:
        found = spark.createDataFrame([], navigate.ROUTES)
    segments = navigate.detailed(found, roads.lines, roads.nodes, roads.degrees).persist()
    if segments.count() <= FEW_SEGMENTS:
        # One request's routes: as a local table they cut the plan, which is planned anew for each of their measures.
        segments = spark.createDataFrame(segments.toArrow(), segments.schema)
    shape = F.array_sort(F.collect_list(F.struct("bucket", "lat", "lon")))
    approx = routes.approximation(segments).groupBy("route_id").agg(F.flatten(F.transform(shape, lambda p: F.array(p["lat"], p["lon"]))).alias("vector"))
    labels = clusters.labelled(approx, "route_id", "vector", clusters.ROUTE_EPSILON)
    scored = routes.statistics(segments, rules).join(labels, "route_id").persist()
    return clusters.picked(scored).join(routes.coordinates(segments), "route_id")
