"""Searching many itineraries side by side: the walker over a broadcast graph, one itinerary a row."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import haversine
from roadloom.operators.walker import RoadGraph, Trip, navigate
from roadloom.sources.rules import FAMILIES, Rules, from_dict

ROUTES = "itin_id string, status string, steps long, seq int, line long, start_point long, end_point long"
#: What the trace holds, by table; ``route`` is a JSON array of [lat, lon].
TRACE_TABLES = {
    "step_results": "itinerary_id string, step_num long, result string, chosen_fork_point_id long",
    "weights": "itinerary_id string, step_num long, end_point_id long, weight_name string, weight_type string, weight_value long",
    "fork_choices": "itinerary_id string, step_num long, end_point_id long, line_point_0_lat double, line_point_0_lon double, line_point_1_lat double, line_point_1_lon double, segment_end_point long, discarded boolean",
    "steps": "itinerary_id string, step_num long, move_result string, route string",
    "itineraries": "itinerary_id string, waypoints_count long, radius long, start_lat float, start_lon float, finish_lat float, finish_lon float",
    "waypoints": "itinerary_id string, idx long, lat double, lon double",
}
#: Lines of a graph that one executor holds at most; larger maps are cut to a region first (about 60 bytes a line).
MOST_LINES = 50_000_000


def compact(nodes: DataFrame, lines_: DataFrame, restrictions: DataFrame | None = None) -> RoadGraph:
    """The graph in arrays, for broadcasting. Only nodes with a line are kept; its size is checked."""
    if (n := lines_.count()) > MOST_LINES:
        raise ValueError(f"{n} lines are too many for a graph that each executor holds; cut the map to the region of the trips")
    used = lines_.select(F.explode(F.array("p0", "p1")).alias("id")).distinct()
    points = nodes.join(used, "id", "left_semi").orderBy("id").select("id", "lat", "lon", "residential", "nogo").toArrow()
    ways = lines_.select("way_id", "direction", "name", "ref", *FAMILIES).dropDuplicates(["way_id"]).toArrow()
    rows = lines_.orderBy("line").select("line", "p0", "p1").toArrow()
    found = [] if restrictions is None else [tuple(r) for r in restrictions.orderBy("rel_id").select("via", "kind", "from_lines", "to_lines").collect()]
    graph = RoadGraph.of_columns(points, rows, found, ways)
    del points, ways, rows
    pa.default_memory_pool().release_unused()  # the driver goes on without the tables
    return graph


def _trip(graph: RoadGraph, row) -> Trip:
    at = lambda i: graph.place[int(i)]
    return Trip(row.itin_id, at(row.start), at(row.finish), [at(w) for w in row.waypoints], float(row.radius), bool(row.visit_all))


def search(itineraries: DataFrame, graph: RoadGraph, rules: Rules | None = None, tasks: int | None = None) -> DataFrame:
    """The segments of the route that each itinerary (itin_id, start, finish, waypoints, radius, visit_all) leads to, with
    the search's status; a search without a segment is one row with null seq."""
    spark = itineraries.sparkSession
    shared, plain = spark.sparkContext.broadcast(graph), (rules or Rules()).to_dict()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, own = shared.value, from_dict(_strict(plain))
        names = [c.split()[0] for c in ROUTES.split(", ")]
        for frame in frames:
            for row in frame.itertuples():
                status, route, steps = navigate(g, _trip(g, row), own)
                out = [(row.itin_id, status, steps, k, int(g.line_ids[a >> 1]), int(g.ids[g.begin[a]]), int(g.ids[g.stop[a]])) for k, a in enumerate(route)]
                yield pd.DataFrame(out or [(row.itin_id, status, steps, None, None, None, None)], columns=names).astype({"seq": "Int32", "line": "Int64", "start_point": "Int64", "end_point": "Int64"})

    # Searches differ in length a thousandfold: many small tasks even that out.
    rows = itineraries.repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "itin_id")
    return rows.mapInPandas(work, ROUTES)


def _strict(plain: dict) -> dict:
    """A rules dictionary as a rule file has it: avoid actions carry no value."""
    fix = lambda a: {"action": "avoid"} if a["action"] == "avoid" else a
    return {k: ({t: fix(a) for t, a in v.items()} if k in FAMILIES and v else v) for k, v in plain.items()}


def traced(itineraries: DataFrame, graph: RoadGraph, rules: Rules | None = None) -> DataFrame:
    """(table, row): every decision of every search, as JSON rows of the tables of TRACE_TABLES."""
    shared, plain = itineraries.sparkSession.sparkContext.broadcast(graph), (rules or Rules()).to_dict()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, own = shared.value, from_dict(_strict(plain))
        lat, lon = (lambda p: float(g.lat[p])), (lambda p: float(g.lon[p]))
        for frame in frames:
            for row in frame.itertuples():
                out: list[tuple[str, str]] = []
                trip = _trip(g, row)

                def put(table: str, itin: str = row.itin_id, out: list = out, **values) -> None:
                    out.append((table, json.dumps({"itinerary_id": itin} | values)))

                put("itineraries", waypoints_count=len(trip.waypoints), radius=int(trip.radius), start_lat=lat(trip.start), start_lon=lon(trip.start), finish_lat=lat(trip.finish), finish_lon=lon(trip.finish))
                for k, w in enumerate(trip.waypoints):
                    put("waypoints", idx=k, lat=lat(w), lon=lon(w))

                def say(table: str, r: dict, put=put) -> None:
                    n = r["step_num"]
                    if table == "steps":
                        put("steps", step_num=n, move_result=r["move_result"], route=json.dumps([[lat(p), lon(p)] for p in r["route"]]))
                    elif table == "step_results":
                        put("step_results", step_num=n, result=r["result"], chosen_fork_point_id=None if r["chosen"] is None else int(g.ids[r["chosen"]]))
                    elif table == "fork_choices":
                        for arc, out_already in r["choices"]:
                            a, b, end = g.p0[arc >> 1], g.p1[arc >> 1], int(g.ids[g.stop[arc]])
                            put("fork_choices", step_num=n, end_point_id=end, line_point_0_lat=lat(a), line_point_0_lon=lon(a), line_point_1_lat=lat(b), line_point_1_lon=lon(b), segment_end_point=end, discarded=bool(out_already))
                    else:
                        for name, v in r["verdicts"].items():
                            kind = {"choice": "ForkChoiceDoNotUse", "segment": "LastSegmentDoNotUse"}.get(v, "ForkChoiceUseWithWeight")
                            put("weights", step_num=n, end_point_id=int(g.ids[r["end"]]), weight_name=name, weight_type=kind, weight_value=0 if isinstance(v, str) else int(v))

                navigate(g, trip, own, trace=say)
                yield pd.DataFrame(out, columns=["table", "row"])

    return itineraries.repartition(4 * itineraries.sparkSession.sparkContext.defaultParallelism, "itin_id").mapInPandas(work, "table string, row string")


def trace_table(trace: DataFrame, name: str) -> DataFrame:
    return trace.filter(F.col("table") == name).select(F.from_json("row", TRACE_TABLES[name]).alias("r")).select("r.*")


def detailed(routes: DataFrame, lines_: DataFrame, nodes: DataFrame, degrees_: DataFrame) -> DataFrame:
    """The segments of finished routes with all that routes are measured by; route_id is the itinerary's id."""
    at = nodes.select("id", "lat", "lon", "residential")
    out = routes.filter("status = 'finished' and seq is not null").withColumnRenamed("itin_id", "route_id")
    out = out.join(lines_.select("line", "name", "ref", *FAMILIES), "line")
    out = out.join(at.select(F.col("id").alias("start_point"), F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon")), "start_point")
    out = out.join(at.toDF("end_point", "end_lat", "end_lon", "residential"), "end_point")
    out = out.join(degrees_.select(F.col("node").alias("end_point"), "junction"), "end_point")
    return out.withColumn("len_m", haversine(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon")))
