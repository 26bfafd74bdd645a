"""Small networks from JSON: the graph, restrictions, nearest points, areas, caches, sinks, rules."""

import json
import math
import random
import re
import threading
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom import cli
from roadloom.functions import geo
from roadloom.functions import tags as T
from roadloom.operators import areas, clusters, graph, itineraries, navigate, proximity, routes, trace
from roadloom.plans.generate import NoRoad, Roads, generate, snap
from roadloom.plans.networks import lattice, order_network
from roadloom.sources import cache, osm_json, pbf, rules, sinks
from roadloom.streaming import trace_stream


def document(nodes, ways, relations=()):
    made = [{"type": "node", "id": i, "lat": lat, "lon": lon, "extra": 1} for i, lat, lon in nodes]
    made += [{"type": "way", "id": i, "nodes": ns, "tags": {"highway": "primary"} | tags} for i, ns, tags in ways]
    made += [{"type": "relation", "id": i, "members": [{"type": t, "ref": r, "role": role} for t, r, role in ms], "tags": tags} for i, ms, tags in relations]
    return {"version": 0.6, "elements": made}


@pytest.fixture
def load(spark, tmp_path):
    def read(*parts, lines=False, strict=False):
        doc = document(*parts)
        path = tmp_path / ("map.jsonl" if lines else "map.json")
        path.write_text("\n".join(map(json.dumps, doc["elements"])) if lines else json.dumps(doc))
        return osm_json.read(spark, str(path), strict)

    return read


#: A harbour town, and a crossing of four arms; see test_walker.
TOWN = ([(i, 57.0 + i * 1e-3, 24.0 + i % 7 * 1e-3) for i in (10, 20, 21, 30, 31, 32, 40, 50, 51, 90, 91)], [(701, [10, 20, 30, 40, 50], {}), (702, [20, 21, 31], {}), (703, [30, 31, 32], {}), (704, [50, 51], {}), (705, [90, 91], {})])
CROSS = ([(i, 57.0 + i * 1e-3, 24.0 + i * i * 1e-4) for i in (0, 5, 6, 7, 8, 9)], [(71, [7, 0], {}), (72, [0, 8], {}), (73, [0, 9], {}), (74, [0, 6], {}), (75, [8, 5, 9], {})])


@pytest.mark.parametrize("lines", [False, True])
def test_graph(load, lines):
    net = load(*TOWN, lines=lines)
    found = graph.lines(net.ways, net.nodes)
    assert found.count() == sum(len(ns) - 1 for _, ns, _ in TOWN[1])
    met = [n for _, ns, _ in TOWN[1] for n in (ns[0], ns[-1], *ns[1:-1], *ns[1:-1])]
    assert {r.node for r in graph.degrees(found).filter("junction").collect()} == {n for n in met if met.count(n) > 2} == {20, 30, 31}
    assert {r.other for r in graph.adjacency(found).filter("node = 30").collect()} == {20, 40, 31}


def test_ways_of_many_nodes(spark):
    """Lines of neighbouring ways have numbers of their own, however many nodes a way has."""
    nodes = spark.range(2500).selectExpr("id", "0D AS lat", "0D AS lon")
    ways = spark.range(2).selectExpr("id", "sequence(0L, 2499L) AS nodes", "map('highway', 'primary') AS tags")
    found = graph.lines(ways, nodes)
    assert found.select("line").distinct().count() == found.count() == 2 * 2499


def test_long_roundabout(spark):
    """Exits of a roundabout of 110 points, against counting."""
    n = 110
    nodes = spark.range(2 * n).selectExpr("id", "0D AS lat", "0D AS lon")
    ring = [(1000, [*range(n), 0], {"highway": "primary", "junction": "roundabout"})]
    arms = [(k, [k, n + k], {"highway": "primary"}) for k in range(0, n, 7)]
    found = graph.roundabout_exits(graph.lines(spark.createDataFrame(ring + arms, "id long, nodes array<long>, tags map<string, string>"), nodes))
    got = {(r.entry, r.exit): r.steps for r in found.collect()}
    assert got == {(e, n + k): (k - e) % n for e in range(n) for k in range(0, n, 7)}


def test_missing_node_keeps_what_is_before(load):
    net = load([(1, 1.0, 1.0), (2, 2.0, 2.0), (4, 4.0, 4.0), (5, 5.0, 5.0)], [(10, [1, 2, 3, 4, 5], {})])
    assert [(r.p0, r.p1) for r in graph.lines(net.ways, net.nodes).collect()] == [(1, 2)]
    assert [tuple(r) for r in graph.first_gaps(graph.roads(net.ways), net.nodes).collect()] == [(10, 2)]


CASES = [
    ({}, False), ({"highway": "primary"}, True), ({"highway": "path"}, False), ({"highway": "path", "motorcycle": "yes"}, False), ({"highway": "proposed"}, False), ({"highway": "track"}, True),
    ({"highway": "primary", "service": "alley"}, False), ({"highway": "primary", "access": "no"}, False), ({"highway": "primary", "access": "yes"}, True), ({"highway": "primary", "access": "permissive"}, True),
    ({"highway": "primary", "motor_vehicle": "private"}, False), ({"highway": "primary", "motor_vehicle": "yes"}, True), ({"highway": "primary_link"}, True), ({"access": "yes"}, False),
]


@pytest.mark.parametrize("tags,ok", CASES)
def test_way_filter(spark, tags, ok):
    df = spark.createDataFrame([(tags,)], "tags map<string, string>")
    assert df.select(T.way_ok()).first()[0] is ok


def test_tags_are_normalised(spark):
    df = spark.createDataFrame([({"name": "a_link_b_link", "ref": "x_link_y", "highway": "trunk_link", "junction": "roundabout", "oneway": "yes"},)], "tags map<string, string>")
    r = df.select(T.direction().alias("d"), *T.kept()).first()
    assert tuple(r) == ("roundabout", "a_b", "x_link_y", "trunk", None, None)


def test_bad_elements(spark, tmp_path):
    bad = [{"type": "wrong-value", "id": 1}, {"type": "node", "id": "x", "lat": 1, "lon": 1}, {"type": "node", "id": 2, "lat": 1}, {"type": "way", "id": 3}, {"type": "relation", "id": 4, "tags": {}, "members": [{"type": "wrong-value", "ref": 1, "role": ""}]}, {"type": "node", "id": 5, "lat": 1, "lon": 2}]
    path = tmp_path / "bad.json"
    path.write_text(json.dumps({"elements": bad}))
    found = osm_json.elements(spark, str(path))
    assert {r.problem for r in osm_json.rejects(found).collect()} == {"unknown element type", "bad id", "bad coordinate", "no nodes", "unknown member type"}
    assert [r.id for r in osm_json.network(found).nodes.collect()] == [5]
    with pytest.raises(Exception, match="map data"):
        osm_json.network(found, strict=True).nodes.collect()
    with pytest.raises(osm_json.MapDataError):
        osm_json.read(spark, "map.txt")


@pytest.mark.parametrize("lines", [False, True])
def test_the_last_of_equal_nodes_counts(load, lines):
    net = load([(1, 9.0, 9.0), (2, 5.0, 5.0), (1, 3.0, 4.0)], [], lines=lines)
    assert {r.id: (r.lat, r.lon) for r in net.nodes.collect()} == {1: (3.0, 4.0), 2: (5.0, 5.0)}


def turn(kind, to, via=(("node", 0, "via"),)):
    return ([("way", 71, "from"), *via, ("way", to, "to")], {"type": "restriction", "restriction": kind})


@pytest.mark.parametrize(
    "relations,stops",
    [
        ([], {8, 9, 6}), ([turn("no_left_turn", 72)], {9, 6}), ([turn("no_u_turn", 71)], {8, 9, 6}), ([turn("only_right_turn", 74)], {6}), ([turn("only_straight_on", 73), turn("only_right_turn", 74)], {9, 6}),
        ([turn("only_left_turn", 72), turn("no_left_turn", 72)], set()), ([turn("no_entry", 72), turn("no_exit", 74)], {9}), ([turn("no_parking", 72)], {8, 9, 6}), ([turn("no_left_turn", 72, ())], {8, 9, 6}),
        ([turn("no_left_turn", 72, (("node", 0, "via"), ("node", 8, "via")))], {8, 9, 6}), ([turn("no_left_turn", 12345)], {8, 9, 6}),
    ],
)
def test_legal_turns(load, relations, stops):
    net = load(*CROSS, [(100 + k, ms, tags) for k, (ms, tags) in enumerate(relations)])
    found = graph.lines(net.ways, net.nodes)
    turns = graph.legal_turns(found, graph.restrictions(net.relations, found, net.nodes))
    assert {r.stop for r in turns.filter("start = 7 and via = 0").collect()} == stops


def test_turns_are_not_moved(load):
    """There are as many as the square of a crossing's lines: what comes after they are made needs no exchange."""
    net = load(*CROSS, [(100, *turn("no_left_turn", 72)), (101, *turn("only_right_turn", 74))])
    found = graph.lines(net.ways, net.nodes)
    plan = graph.legal_turns(found, graph.restrictions(net.relations, found, net.nodes))._jdf.queryExecution().sparkPlan().toString()
    joins = re.findall(r"Join \[([^\]]*)\]", plan)
    assert len(joins) > 2 and re.fullmatch(r"via#\d+L?", joins[0])


def metres(a, b):
    """By the law of cosines."""
    p, q, d = *(math.radians(x) for x in (a[0], b[0])), math.radians(b[1] - a[1])
    return 6371008.8 * math.acos(min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d)))


def spots(n, seed):
    rng = random.Random(seed)
    return {k: (48.0 + rng.random() * 0.15, 11.0 + rng.random() * 0.15) for k in range(n)}


def test_nearest(spark, load):
    places, asked = spots(40, 1), spots(25, 2)
    net = load([(i, *p) for i, p in places.items()], [(100 + i, [i, i], {}) for i in places])
    points = proximity.grid(net.nodes, graph.lines(net.ways, net.nodes))
    q = spark.createDataFrame([(str(k), *p) for k, p in asked.items()], "query_id string, lat double, lon double")
    got = {int(r.query_id): r.id for r in proximity.nearest(q, points).collect()}
    assert got == {k: min(places, key=lambda i: metres(p, places[i])) for k, p in asked.items()}
    assert proximity.nearest(spark.createDataFrame([("far", 48.5, 11.0)], q.schema), points).count() == 0  # over 20 cells away


GRID = "id long, lat double, lon double, residential boolean, highway_all array<string>, surface_all array<string>, smoothness_all array<string>, cell_lat int, cell_lon int"


def test_nearest_of_queries_whose_spread_is_unknown(spark, tmp_path):
    """Queries and points on both sides of the antimeridian, many queries at one place; none of it is broadcast."""
    rng = random.Random(4)
    around = lambda: (10 + rng.random() * 0.5, (180 + (rng.random() - 0.5) * 0.9 + 180) % 360 - 180)
    places, asked = {k: around() for k in range(60)}, [around() for _ in range(12)]
    cell = lambda x: math.floor(x * 100 + 0.5) if x >= 0 else -math.floor(-x * 100 + 0.5)
    points = spark.createDataFrame([(k, *p, False, ["primary"], [], [], cell(p[0]), cell(p[1])) for k, p in places.items()], GRID)
    q = spark.createDataFrame([(str(k), *asked[k % 12]) for k in range(48)], "query_id string, lat double, lon double")
    gap = lambda a, b: max(abs(cell(a[0]) - cell(b[0])), min(abs(cell(a[1]) - cell(b[1])), 36000 - abs(cell(a[1]) - cell(b[1]))))
    want = {}
    for k in range(48):
        if near := [i for i in places if gap(asked[k % 12], places[i]) <= proximity.RINGS]:
            want[str(k)] = min(near, key=lambda i: metres(asked[k % 12], places[i]))
    assert len(want) > 40
    assert {r.query_id: r.id for r in proximity.nearest(q, points).collect()} == want
    q.write.parquet(str(tmp_path / "q"))  # a file's size is known, and small
    assert "Broadcast" not in proximity.candidates(spark.read.parquet(str(tmp_path / "q")), points)._jdf.queryExecution().executedPlan().toString()


def test_nearest_by_rules_broadcasts_no_spread(spark, tmp_path):
    points = spark.createDataFrame([(1, 10.0, 20.0, True, ["trunk"], [], [], 1000, 2000), (2, 10.1, 20.0, False, ["trunk"], ["mud"], [], 1010, 2000), (3, 10.1, 20.1, False, ["trunk"], [], [], 1010, 2010)], GRID)
    spark.createDataFrame([(str(k), 10.0, 20.0) for k in range(5)], "query_id string, lat double, lon double").write.parquet(str(tmp_path / "q"))
    own = rules.from_dict({"surface": {"mud": {"action": "avoid"}}})
    found = proximity.nearest(spark.read.parquet(str(tmp_path / "q")), points, own, True, ["trunk"])
    assert not re.search(r"BroadcastHashJoin \[(cell|block)_lat", found._jdf.queryExecution().executedPlan().toString())
    assert {(r.query_id, r.id) for r in found.collect()} == {(str(k), 3) for k in range(5)}


def test_nearest_avoids(spark, load):
    places = spots(30, 3)
    kind = lambda i: ("trunk", "primary", "residential")[i % 3]
    net = load([(i, *p) for i, p in places.items()], [(100 + i, [i, i], {"highway": kind(i)}) for i in places])
    points = proximity.grid(net.nodes, graph.lines(net.ways, net.nodes))
    at = (48.07, 11.07)
    q = spark.createDataFrame([("q", *at)], "query_id string, lat double, lon double")
    best = lambda ok: min((i for i in places if kind(i) in ok), key=lambda i: metres(at, places[i]))
    own = rules.from_dict({"highway": {"trunk": {"action": "avoid"}}})
    assert proximity.nearest(q, points, own).first().id == best({"primary", "residential"})
    assert proximity.nearest(q, points, None, False, ["trunk"]).first().id == best({"trunk"})
    assert proximity.nearest(q, points, own, False, ["trunk", "primary"]).first().id == best({"primary"})
    assert proximity.whitelist(own, ["trunk"]) is None


def test_cells(spark):
    rng = random.Random(4)
    made = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(0.0, 0.0), (-90.0, -180.0), (90.0, 180.0)]
    rows = spark.createDataFrame(made, "lat double, lon double").select("lat", "lon", geo.cell(F.col("lat")).alias("y"), geo.cell(F.col("lon")).alias("x")).collect()
    for r in rows:
        assert abs(r.y - r.lat * 100) <= 0.502 and abs(r.x - r.lon * 100) <= 0.502
    assert (rows[-2].y, rows[-2].x, rows[-1].y, rows[-1].x) == (-9000, -18000, 9000, 18000)


def test_rings(spark):
    cells = spark.range(1).select(F.inline(geo.ring(2))).groupBy("ring").count().collect()
    assert {r.ring: r["count"] for r in cells} == {0: 1, 1: 8, 2: 16}
    assert tuple(spark.range(1).select(geo.wrap(F.lit(18001), 18000), geo.wrap(F.lit(-18002), 18000)).first()) == (-17999, 17998)


def test_distances(spark):
    pairs = list(zip(spots(50, 5).values(), spots(50, 6).values()))
    rows = spark.createDataFrame([(*a, *b) for a, b in pairs], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(geo.haversine(*map(F.col, "abcd"))).collect()]
    assert all(abs(x - metres(*p)) < 0.5 for x, p in zip(got, pairs))
    to = geo.destination(F.lit(57.0), F.lit(24.0), F.lit(90.0), F.lit(10000.0))
    r = spark.range(1).select(*to, geo.haversine(F.lit(57.0), F.lit(24.0), *to), geo.bearing(F.lit(57.0), F.lit(24.0), *to)).first()
    assert abs(r[2] - 10000) < 1e-3 and abs(r[3] - 90) < 1e-6


def brute_place(rings, y, x):
    """Whether a point is in the first ring and no other, and how far in metres the nearest edge is, edge by edge."""
    within, best = [], math.inf
    for ring in rings:
        odd = False
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
            c = math.cos(math.radians(y))
            a, b = ((x1 - x) * c, y1 - y), ((x2 - x) * c, y2 - y)
            d = (b[0] - a[0], b[1] - a[1])
            size = d[0] ** 2 + d[1] ** 2
            t = min(1, max(0, -(a[0] * d[0] + a[1] * d[1]) / size)) if size else 0
            best = min(best, math.hypot(a[0] + t * d[0], a[1] + t * d[1]))
        within.append(odd)
    return within[0] and not any(within[1:]), math.radians(best) * 6371008.8


def test_placed():
    rng = random.Random(7)
    rings, at = [], []
    for _ in range(200):
        turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 9)))
        star = lambda r: [(57 + r * rng.uniform(0.5, 1) * math.sin(a), 24 + r * rng.uniform(0.5, 1) * math.cos(a)) for a in turn]
        closed = lambda ring: ring + ring[:1]
        rings.append([closed(star(0.01)), *(closed(star(0.003)) for _ in range(rng.randrange(3)))])
        at.append((57 + rng.uniform(-0.01, 0.01), 24 + rng.uniform(-0.01, 0.01)))
    kind = pa.list_(pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))
    column = pa.array([[[{"lat": y, "lon": x} for y, x in r] for r in rs] for rs in rings], kind)
    inside, edge = areas.placed(*np.array(at).T, column)
    for k, (rs, p) in enumerate(zip(rings, at)):
        want = brute_place(rs, *p)
        assert inside[k] == want[0] and abs(edge[k] - want[1]) < 1e-6


def test_areas(spark, load):
    square = [(1, 57.0, 24.0), (2, 57.0, 24.01), (3, 57.01, 24.01), (4, 57.01, 24.0), (5, 57.002, 24.002), (6, 57.002, 24.004), (7, 57.004, 24.004), (8, 57.004, 24.002)]
    ring = ([("way", 10, "outer"), ("way", 11, "outer"), ("way", 12, "inner")], {"landuse": "residential"})
    net = load(square, [(10, [1, 2, 3], {}), (11, [1, 4, 3], {}), (12, [5, 6, 7, 8, 5], {})], [(50, *ring)])
    found = areas.polygons(areas.area_members(net.ways, net.relations, net.nodes, "residential"))
    r = found.first()
    assert found.count() == 1 and len(r.outer) == 5 and len(r.holes) == 1
    whole = areas.polygon_area([(57.0, 24.0), (57.0, 24.01), (57.01, 24.01), (57.01, 24.0)])
    assert abs(whole - 1112 * 605) / whole < 0.01 and 0 < r.area_m2 < whole
    spots = spark.createDataFrame([(1, 57.005, 24.005), (2, 57.003, 24.003), (3, 57.02, 24.02), (4, 57.0101, 24.0)], "id long, lat double, lon double")
    got = {x.id: (x.residential, x.nogo) for x in areas.flagged(spots, found, found).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, False), 4: (True, False)}
    assert areas.cells(found).count() == 4


def test_stitching():
    assert areas.stitched([[1, 2], [3, 2], [3, 1]]) == [[1, 2, 3, 1]]
    assert areas.stitched([[1, 2], [2, 3]]) == [] and areas.stitched([[1], [1, 2, 3, 1]]) in ([[1, 2, 3, 1]], [[1, 1, 2, 3, 1]])


def test_rules():
    assert rules.from_dict({}) == rules.Rules()
    assert rules.from_dict({"basic": {"step_limit": 5}}).basic.prefer_same_road.priority == 30
    for bad in ({"x": 1}, {"basic": {"y": 1}}, {"highway": {"a": {"action": "keep"}}}, {"highway": {"a": {"action": "priority"}}}, {"highway": {"a": {"action": "priority", "value": 256}}}, {"basic": {"step_limit": "1"}}):
        with pytest.raises(rules.RulesError):
            rules.from_dict(bad)
    own = rules.from_dict({"highway": {"track": {"action": "avoid"}, "primary": {"action": "priority", "value": 7}}, "surface": None})
    assert own.avoided("highway") == {"track"} and own.priorities("highway") == {"primary": 7} and own.avoided("surface") == set()
    assert rules.json_schema()["properties"]["basic"]["properties"]["step_limit"] == {"type": "integer"}


def test_hdbscan():
    import numpy as np

    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(c, 0.02, (20, 2)) for c in ((0, 0), (5, 5), (9, 0))] + [[(50, 50)]])
    labels = clusters.hdbscan(points, 2, 0.5)
    groups = [set(labels[k * 20 : k * 20 + 20].tolist()) for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and -1 not in set.union(*groups) and labels[60] == -1
    assert clusters.hdbscan(points[:1]).tolist() == [-1] and clusters.hdbscan(np.zeros((0, 2))).tolist() == []


def test_requests_are_clustered_apart(spark):
    rows = [(f"{r}/{k}", r, [float(k % 2 * 10), 0.001 * k]) for r in range(3) for k in range(12)]
    got = {r.id: r.label for r in clusters.labelled(spark.createDataFrame(rows, "id string, r long, vector array<double>"), "id", "vector", 0.1, by="r").collect()}
    assert len(got) == 36 and all({got[f"{r}/{k}"] for k in range(j, 12, 2)} == {got[f"{r}/{j}"]} for r in range(3) for j in (0, 1))


def test_labelled_rows_keep_their_places(spark):
    rows = [(k, [float(k % 2 * 10), 0.001 * k]) for k in range(12)] + [(50, [float("nan"), 1.0]), (51, [1.0])]
    got = {r.id: r.label for r in clusters.labelled(spark.createDataFrame(rows, "id long, vector array<double>"), "id", "vector", 0.1).collect()}
    assert got[50] == got[51] == -1 and len({got[k] for k in range(0, 12, 2)}) == 1 and got[0] != got[1]


def test_itineraries(spark):
    net = lattice(spark)
    points = proximity.grid(net.nodes, graph.lines(net.ways, net.nodes)).cache()
    trips = itineraries.round_trip((300, 57.048, 24.084), 90.0, 10000.0, points)
    assert trips.count() == 256 and trips.filter("size(waypoints) <> 3 or not visit_all").count() == 0
    own = rules.from_dict({"generation": {"waypoint_generation": {"start_finish": {"variation_distances_m": [1000.0], "variation_bearing_deg": [0.0, 90.0]}}}})
    made = itineraries.start_finish((300, 57.048, 24.084), (310, 57.088, 24.084), points, own)
    assert "300--310" in {r.itin_id for r in made.collect()} and made.count() <= 5


def test_generate_and_write(spark, tmp_path):
    roads = Roads.of(lattice(spark, 12))
    own = rules.from_dict({"basic": {"step_limit": 200}, "generation": {"waypoint_generation": {"start_finish": {"variation_distances_m": [1000.0], "variation_bearing_deg": [0.0, 180.0]}}, "route_generation_retry": {"avoid_residential": [False], "round_trip_adjustment_bearing_deg": [], "trigger_min_route_count": 1}}})
    found = generate(roads, own, (57.0, 24.0), (57.02, 24.03)).cache()
    assert found.count() >= 1
    for r in found.collect():
        assert abs(sum(s["percentage"] for s in r.highway.values()) - 100) < 1e-6 and r.len_m > 1000
    sinks.write(found, str(tmp_path / "out.json"))
    said = json.loads((tmp_path / "out.json").read_text())
    assert len(said["result"]["ok"]["routes"]) == found.count() and said["id"] == "default-request-id"
    sinks.write(found, str(tmp_path / "out.gpx"))
    root = ET.parse(tmp_path / "out.gpx").getroot()
    assert len(root) == found.count() and root[0][0].text.startswith("r_0_c_")
    sinks.write(found, str(tmp_path / "each.gpx"), split=True)
    assert len(list(tmp_path.glob("each-*.gpx"))) == found.count()
    with pytest.raises(NoRoad):
        snap(roads.points(), 10.0, 10.0, own)
    source = tmp_path / "map.json"
    source.write_text("{}")
    tables = {"nodes": roads.nodes, "lines": roads.lines, "restrictions": roads.restrictions, "degrees": roads.degrees}
    cache.write(str(tmp_path / "cache"), str(source), tables)
    assert cache.read(spark, str(tmp_path / "cache"), str(source))["lines"].count() == roads.lines.count()
    source.write_text("{ }")
    assert cache.read(spark, str(tmp_path / "cache"), str(source)) is None


def test_trace(spark, tmp_path):
    roads = Roads.of(lattice(spark, 12))
    compact = navigate.compact(roads.nodes, roads.lines)
    trips = itineraries._finished(spark.createDataFrame([([40],)], "waypoints array<bigint>"), 0, 100, False)
    told = navigate.traced(trips, compact, rules.from_dict({"basic": {"step_limit": 50}})).cache()
    assert trace.page(navigate.trace_table(told, "steps"), "0-40-100", size=3).count() == 3
    forks = trace.fork_decisions(navigate.trace_table(told, "weights"))
    chosen = {r.step_num: r.chosen_fork_point_id for r in navigate.trace_table(told, "step_results").collect() if r.result == "ForkChoice"}
    assert {r.step_num: r.end_point_id for r in forks.collect() if r.end_point_id is not None}.keys() == chosen.keys()
    assert navigate.trace_table(told, "itineraries").first().waypoints_count == 1
    for name in navigate.TRACE_TABLES:
        table = navigate.trace_table(told, name)
        trace.write(table, name, str(tmp_path))
        assert sorted(map(str, trace.read(spark, str(tmp_path), name).collect())) == sorted(map(str, table.collect()))
    box = trace.extent(trace.read(spark, str(tmp_path), "itineraries")).first()
    assert box.min_lat < box.lat < box.max_lat and box.min_lon < box.lon < box.max_lon
    with cli.view(spark, str(tmp_path), "127.0.0.1", 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        get = lambda path: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{path}"))
        assert get("/steps?itinerary_id=0-40-100&step_num=2")[0]["step_num"] == 2 and len(get("/weights?page=0")) == trace.PAGE
        assert "steps" in get("/")["tables"]
        with pytest.raises(urllib.error.HTTPError):
            get("/nothing")
        server.shutdown()
    rows = trace_stream.progress(trace.read(spark, str(tmp_path), "step_results"))
    assert sum(r.n for r in rows.collect()) == navigate.trace_table(told, "step_results").count()


def test_tags_of_ways_are_not_broadcast(spark):
    """A file of 10 MB of orders is some hundred MB of tags in memory, however small its size makes it look."""
    ways = order_network(spark, "/root/testdata/sf0.001").ways
    assert "Broadcast" not in ways._jdf.queryExecution().executedPlan().toString()


def test_scores(spark):
    rows = [("r", k, 57 + 0.01 * k, 24 + 0.001 * k * k) for k in range(6)]
    base = spark.createDataFrame(rows, "route_id string, seq int, start_lat double, start_lon double")
    nxt = base.selectExpr("route_id", "seq - 1 AS seq", "start_lat AS end_lat", "start_lon AS end_lon")
    segments = base.join(nxt, ["route_id", "seq"]).selectExpr("*", "1000D AS len_m", "'primary' AS highway", "cast(null AS string) AS surface", "cast(null AS string) AS smoothness", "false AS junction", "false AS residential")
    bends = routes.scores(segments).first().score
    own = rules.from_dict({"highway": {"primary": {"action": "priority", "value": 255}}})
    assert bends > 0 and abs(routes.scores(segments, own).first().score - 2 * bends) < 1e-9


@pytest.mark.parametrize("measure", ["totals", "tag_shares"])
def test_lengths_add_up_in_any_order(spark, measure):
    # Near half a centimetre, an order of additions may round the other way.
    lengths = [0.1, 0.2, 0.3, 62871.0907, 188864.9337, 1e-7, 7.005] * 6
    schema = "route_id bigint, seq bigint, len_m double, junction boolean, highway string, surface string, smoothness string"
    found = set()
    for seed in range(6):
        random.Random(seed).shuffle(lengths)
        rows = spark.createDataFrame([(1, i, x, False, "road", None, None) for i, x in enumerate(lengths)], schema).coalesce(1)
        made = getattr(routes, measure)(rows)
        found |= {r.len_m for r in made.collect()}
    assert len(found) == 1
    assert found.pop() == pytest.approx(math.fsum(lengths), abs=1e-10)


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zig(n):
    return (n << 1) ^ (n >> 63)


def packs(values):
    return b"".join(varint(v) for v in values)


def test_pbf(spark, tmp_path):
    texts = b"".join(field(1, s) for s in (b"", b"highway", b"primary", b"type", b"restriction", b"via"))
    dense = field(1, packs([zig(7), zig(1)])) + field(8, packs([zig(570000000), zig(10)])) + field(9, packs([zig(240000000), zig(-5)])) + field(10, packs([0, 1, 2, 0]))
    way = field(1, 100) + field(2, packs([1])) + field(3, packs([2])) + field(8, packs([zig(7), zig(1)]))
    relation = field(1, 200) + field(2, packs([3])) + field(3, packs([4])) + field(8, packs([5])) + field(9, packs([zig(7)])) + field(10, packs([0]))
    block = field(1, texts) + field(2, field(2, dense)) + field(2, field(3, way)) + field(2, field(4, relation))
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    out = b""
    for kind, data in ((b"OSMHeader", field(1, b"x")), (b"OSMData", blob)):
        head = field(1, kind) + field(3, len(data))
        out += len(head).to_bytes(4, "big") + head + data
    path = tmp_path / "map.pbf"
    path.write_bytes(out)
    found = {(r.type, r.id): r for r in pbf.elements(spark, str(path)).collect()}
    assert set(found) == {("node", "7"), ("node", "8"), ("way", "100"), ("relation", "200")}
    assert found["node", "8"].tags == {"highway": "primary"} and float(found["node", "8"].lat) == 57.000001
    assert found["way", "100"].nodes == ["7", "8"] and found["relation", "200"].members[0].role == "via"
    net = osm_json.read(spark, str(path))
    assert graph.lines(net.ways, net.nodes).count() == 1 and graph.restrictions(net.relations, graph.lines(net.ways, net.nodes), net.nodes).count() == 0


def pbf_file(path, nodes, ways, relations=()):
    """A PBF extract of nodes (id, lat, lon), ways (id, nodes, tags) and relations (id, members, tags)."""
    strings = [b""]

    def text(t):
        if t.encode() not in strings:
            strings.append(t.encode())
        return strings.index(t.encode())

    def running(values):
        return packs(zig(b - a) for a, b in zip([0, *values], values))

    tagged = lambda tags: field(2, packs([text(k) for k in tags])) + field(3, packs([text(v) for v in tags.values()]))
    dense = field(1, running([n[0] for n in nodes])) + field(8, running([round(n[1] * 1e7) for n in nodes])) + field(9, running([round(n[2] * 1e7) for n in nodes]))
    groups = [field(2, field(2, dense))]
    groups += [field(2, field(3, field(1, i) + tagged(tags) + field(8, running(ns)))) for i, ns, tags in ways]
    groups += [field(2, field(4, field(1, i) + tagged(tags) + field(8, packs([text(role) for _, role in ms])) + field(9, running([r for r, _ in ms])) + field(10, packs([1] * len(ms))))) for i, ms, tags in relations]
    block = field(1, b"".join(field(1, t) for t in strings)) + b"".join(groups)
    blob = field(2, len(block)) + field(3, zlib.compress(block))
    head = field(1, b"OSMData") + field(3, len(blob))
    path.write_bytes(len(head).to_bytes(4, "big") + head + blob)


def test_pbf_areas(spark, tmp_path):
    """What is read of an extract: usable roads and their nodes alone, flagged by the areas around them."""
    box = lambda k, y, x, size: [(k, y, x), (k + 1, y, x + size), (k + 2, y + size, x + size), (k + 3, y + size, x)]
    nodes = [(1, 57.005, 24.005), (2, 57.105, 24.105), (3, 57.2, 24.2), (4, 57.3, 24.3), *box(10, 57.0, 24.0, 0.01), *box(20, 57.1, 24.1, 0.01)]
    ways = [(100, [1, 2, 3], {"highway": "primary"}), (101, [3, 4], {"highway": "primary", "access": "no"}), (102, [4, 1], {"name": "no road"}), (110, [10, 11, 12, 13, 10], {"landuse": "residential"}), (120, [20, 21, 22], {}), (121, [22, 23, 20], {})]
    pbf_file(tmp_path / "m.pbf", nodes, ways, [(200, [(120, "outer"), (121, "outer")], {"landuse": "military", "type": "multipolygon"})])
    net = osm_json.read(spark, str(tmp_path / "m.pbf"))
    assert [r.id for r in net.ways.collect()] == [100] and net.relations.count() == 0
    assert {r.id: (r.residential, r.nogo) for r in net.nodes.collect()} == {1: (True, False), 2: (False, True), 3: (False, False)}
