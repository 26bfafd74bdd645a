"""The registry: every operator over networks, routes and traces as a query of (spark, sf_dir), with DuckDB SQL for it.

Geometry is compared as whole numbers (metres or degrees times 100), as engines differ in the last bits of a sine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.operators import areas, clusters, graph, itineraries, navigate, proximity, routes, trace
from roadloom.plans import generate as G
from roadloom.plans.networks import TOWN_NODES_SQL, TOWN_WAY_NODES_SQL, TOWN_WAY_TAGS_SQL, _views, order_network, sql_prelude, town
from roadloom.sources.rules import FAMILIES, Rules, from_dict

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RULES = from_dict({
    "highway": {"residential": {"action": "avoid"}, "primary": {"action": "priority", "value": 100}, "unclassified": {"action": "priority", "value": 255}},
    "surface": {"dirt": {"action": "avoid"}, "gravel": {"action": "priority", "value": 51}},
    "smoothness": {"good": {"action": "priority", "value": 10}},
})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def whole(x: Column, by: int = 100) -> Column:
    return F.floor(x * by + 0.5).cast("long")


def w(x: str, by: int = 100) -> str:
    return f"CAST(floor(({x}) * {by} + 0.5) AS BIGINT)"


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371008.8e0 * asin(sqrt(least(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0e0))))"


def bear(a: str, b: str, c: str, d: str) -> str:
    return f"fmod(degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) + 360, 360.0e0)"


P = sql_prelude()
R = P + f""", deg AS (
  SELECT node, count(*) AS degree FROM (SELECT p0 AS node FROM lines UNION ALL SELECT p1 FROM lines) GROUP BY node
), segs AS (
  SELECT CAST(floor(l.way_id / 20) AS BIGINT) AS route_id, row_number() OVER (PARTITION BY floor(l.way_id / 20) ORDER BY l.line) - 1 AS seq, l.line, l.p1 AS end_point,
    a.lat AS start_lat, a.lon AS start_lon, b.lat AS end_lat, b.lon AS end_lon, {hav("a.lat", "a.lon", "b.lat", "b.lon")} AS len_m,
    l.highway, l.surface, l.smoothness, l.name, l.ref, d.degree > 2 AS junction, b.residential
  FROM lines l JOIN nodes a ON a.id = l.p0 JOIN nodes b ON b.id = l.p1 JOIN deg d ON d.node = l.p1
)"""


def order_lines(spark: SparkSession, sf_dir: str) -> tuple:
    net = order_network(spark, sf_dir)
    return net, graph.lines(net.ways, net.nodes)


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes: the lines of each 20 orders, one after the other."""
    net, lines = order_lines(spark, sf_dir)
    m = graph.measured(lines, net.nodes).join(graph.degrees(lines).select(F.col("node").alias("p1"), "junction"), "p1")
    m = m.join(net.nodes.select(F.col("id").alias("p1"), "residential"), "p1").withColumn("route_id", F.floor(F.col("way_id") / 20))
    seq = F.row_number().over(routes.Window.partitionBy("route_id").orderBy("line")) - 1
    return m.select("route_id", seq.alias("seq"), "line", F.col("p1").alias("end_point"), F.col("lat0").alias("start_lat"), F.col("lon0").alias("start_lon"), F.col("lat1").alias("end_lat"), F.col("lon1").alias("end_lon"), "len_m", *FAMILIES, "name", "ref", "junction", "residential")


# Filters and projections.


@query(P + " SELECT id AS way_id, direction, CASE WHEN name LIKE '%!_link' ESCAPE '!' THEN replace(name, '_link', '') ELSE name END AS name, ref, CASE WHEN highway LIKE '%!_link' ESCAPE '!' THEN replace(highway, '_link', '') ELSE highway END AS highway, surface, smoothness FROM roads WHERE id IN (SELECT way_id FROM way_nodes)")
def way_filter(spark, sf_dir):
    return graph.roads(order_network(spark, sf_dir).ways).drop("nodes")


RESTRICTION = " CASE WHEN v IN ('no_right_turn', 'no_left_turn', 'no_u_turn', 'no_straight_on', 'no_entry', 'no_exit') THEN 'not' WHEN v IN ('only_right_turn', 'only_left_turn', 'only_u_turn', 'only_straight_on') THEN 'only' END"


@query(P + f" SELECT rel_id, v AS value, {RESTRICTION} AS kind, CASE WHEN {RESTRICTION} IS NULL THEN 'unknown restriction' END AS problem FROM (SELECT *, split_part(said, ' ', 1) AS v FROM restrictions WHERE kind = 'restriction')")
def restriction_parse(spark, sf_dir):
    return graph.parsed_relations(order_network(spark, sf_dir).relations).select("rel_id", "value", "kind", "problem")


# Joins that build the graph.


@query(P + " SELECT line, way_id, seq, p0, p1, direction, name, ref, highway, surface, smoothness FROM lines")
def edges(spark, sf_dir):
    return order_lines(spark, sf_dir)[1].withColumn("seq", F.col("seq").cast("long"))


@query(P + " SELECT p0 AS node, line, p1 AS other FROM lines UNION ALL SELECT p1, line, p0 FROM lines")
def adjacency(spark, sf_dir):
    return graph.adjacency(order_lines(spark, sf_dir)[1])


@query(P + " SELECT node, count(*) AS degree, count(*) > 2 AS junction FROM (SELECT p0 AS node FROM lines UNION ALL SELECT p1 FROM lines) GROUP BY node")
def degree_junction(spark, sf_dir):
    return graph.degrees(order_lines(spark, sf_dir)[1])


D = P + ", d AS (SELECT line, way_id, p0 AS start, p1 AS stop, direction FROM lines UNION ALL SELECT line, way_id, p1, p0, direction FROM lines WHERE direction = 'both')"


@query(D + " SELECT * FROM d")
def directed_edges(spark, sf_dir):
    return graph.directed(order_lines(spark, sf_dir)[1])


X = D + f""", known AS (SELECT rel_id, via, from_way, to_way, {RESTRICTION} AS kind FROM (SELECT *, split_part(said, ' ', 1) AS v FROM restrictions WHERE kind = 'restriction')),
turns AS (SELECT k.rel_id, k.via, k.kind, f.line AS from_line, t.line AS to_line FROM known k JOIN lines f ON f.way_id = k.from_way JOIN lines t ON t.way_id = k.to_way WHERE k.kind IS NOT NULL AND k.via IN (SELECT id FROM nodes))"""


def _restricted(spark, sf_dir):
    net, lines = order_lines(spark, sf_dir)
    return lines, graph.restrictions(net.relations, lines, net.nodes)


@query(X + " SELECT DISTINCT rel_id, via, kind, from_line, to_line FROM turns")
def restriction_lines(spark, sf_dir):
    found = _restricted(spark, sf_dir)[1]
    return found.select("rel_id", "via", "kind", F.explode("from_lines").alias("from_line"), "to_lines").select("rel_id", "via", "kind", "from_line", F.explode("to_lines").alias("to_line"))


@query(X + " SELECT DISTINCT via, from_line, to_line FROM turns WHERE kind = 'not'")
def turn_not_allowed(spark, sf_dir):
    return graph.turn_pairs(_restricted(spark, sf_dir)[1], "not")


@query(X + " SELECT DISTINCT via, from_line, to_line FROM turns WHERE kind = 'only'")
def turn_only_allowed(spark, sf_dir):
    return graph.turn_pairs(_restricted(spark, sf_dir)[1], "only")


@query(X + """ SELECT a.start, a.line AS from_line, a.stop AS via, b.line AS to_line, b.stop FROM d a JOIN d b ON a.stop = b.start AND a.start <> b.stop
  WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.kind = 'not' AND t.via = a.stop AND t.from_line = a.line AND t.to_line = b.line)
  AND (NOT EXISTS (SELECT 1 FROM turns t WHERE t.kind = 'only' AND t.via = a.stop AND t.from_line = a.line) OR EXISTS (SELECT 1 FROM turns t WHERE t.kind = 'only' AND t.via = a.stop AND t.from_line = a.line AND t.to_line = b.line))""")
def legal_turns(spark, sf_dir):
    return graph.legal_turns(*_restricted(spark, sf_dir))


@query(X + """, adj AS (SELECT p0 AS node, line FROM lines UNION ALL SELECT p1, line FROM lines) SELECT start AS node, line, stop FROM d
  WHERE NOT EXISTS (SELECT 1 FROM turns t WHERE t.kind = 'not' AND t.via = d.start AND t.to_line = d.line
    AND NOT EXISTS (SELECT 1 FROM adj WHERE adj.node = d.start AND adj.line <> d.line AND adj.line NOT IN (SELECT u.to_line FROM turns u WHERE u.rel_id = t.rel_id)))""")
def start_turns(spark, sf_dir):
    return graph.start_turns(*_restricted(spark, sf_dir))


T = sql_prelude(TOWN_NODES_SQL, TOWN_WAY_NODES_SQL, TOWN_WAY_TAGS_SQL)
TD = T + ", d AS (SELECT line, way_id, p0 AS start, p1 AS stop, direction FROM lines UNION ALL SELECT line, way_id, p1, p0, direction FROM lines WHERE direction = 'both')"


def _town(spark, sf_dir):
    net = town(spark, sf_dir)
    return net, graph.lines(net.ways, net.nodes)


@query(TD + """, r AS (SELECT DISTINCT start, stop FROM d WHERE direction = 'roundabout'), around(entry, here, steps) AS (
  SELECT DISTINCT start, start, 0 FROM r UNION SELECT a.entry, r.stop, a.steps + 1 FROM around a JOIN r ON a.here = r.start WHERE a.steps < 4
) SELECT entry, line, d.stop AS exit, min(steps) AS steps FROM around JOIN d ON d.start = around.here AND d.direction <> 'roundabout' GROUP BY ALL""")
def roundabout_exits(spark, sf_dir):
    return graph.roundabout_exits(_town(spark, sf_dir)[1])


# Geometry.


@query(P + f" SELECT line, {w(hav('a.lat', 'a.lon', 'b.lat', 'b.lon'))} AS len_cm, {w(bear('a.lat', 'a.lon', 'b.lat', 'b.lon'))} AS bearing_100, {w(bear('b.lat', 'b.lon', 'a.lat', 'a.lon'))} AS back_100 FROM lines l JOIN nodes a ON a.id = l.p0 JOIN nodes b ON b.id = l.p1 WHERE l.p0 <> l.p1")
def line_measures(spark, sf_dir):
    net, lines = order_lines(spark, sf_dir)
    m = graph.measured(lines.filter("p0 <> p1"), net.nodes)
    return m.select("line", whole(F.col("len_m")).alias("len_cm"), whole(F.col("bearing")).alias("bearing_100"), whole(routes.reverse_bearing("lat0", "lon0", "lat1", "lon1")).alias("back_100"))


@query(P + """, q AS (SELECT id, radians(lat) AS p, lon, radians((id % 360) * 1.0e0) AS b, (id % 30) * 1000 / 6371008.8e0 AS d FROM nodes),
t AS (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(b)) AS t FROM q)
SELECT id, CAST(floor(degrees(t) * 100000 + 0.5) AS BIGINT) AS lat_e5, CAST(floor((fmod(lon + degrees(atan2(sin(b) * sin(d) * cos(p), cos(d) - sin(p) * sin(t))) + 540, 360.0e0) - 180) * 100000 + 0.5) AS BIGINT) AS lon_e5 FROM t""")
def destination(spark, sf_dir):
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), (F.col("id") % 360).cast("double"), (F.col("id") % 30 * 1000).cast("double"))
    return order_network(spark, sf_dir).nodes.select("id", whole(lat, 100000).alias("lat_e5"), whole(lon, 100000).alias("lon_e5"))


CELL = "CAST(round(CAST({} AS FLOAT) * CAST(100 AS FLOAT)) AS INTEGER)"


@query(P + f" SELECT id, {CELL.format('lat')} AS cell_lat, {CELL.format('lon')} AS cell_lon FROM nodes")
def cell_id(spark, sf_dir):
    return order_network(spark, sf_dir).nodes.select("id", geo.cell(F.col("lat")).alias("cell_lat"), geo.cell(F.col("lon")).alias("cell_lon"))


@query("SELECT i.i AS dlat, j.j AS dlon, greatest(abs(i.i), abs(j.j)) AS ring FROM (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS i) i, (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS j) j")
def ring_cells(spark, sf_dir):
    return spark.range(1).select(F.inline(geo.ring(3)))


@query(P + f" SELECT id, CAST(255 - round(least(t, 360 - t) * (255.0e0 / 180.0e0)) AS INTEGER) AS priority FROM (SELECT id, abs((id * 7 % 360) - (id * 13 % 360)) * 1.0e0 AS t FROM nodes)")
def heading_priority(spark, sf_dir):
    deg = lambda k: (F.col("id") * k % 360).cast("double")
    return order_network(spark, sf_dir).nodes.select("id", geo.heading_priority(deg(7), deg(13)).alias("priority"))


PLACES = "SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))) AS query_id, 57 + (s_suppkey * 37 % 180) * 0.001e0 AS lat, 24 + (s_suppkey * 53 % 300) * 0.001e0 AS lon FROM supplier"


def nearest_ctes(places: str, where: str = "true") -> str:
    """Common table expressions: near (query_id, id, dist_m), the nearest allowed point of each place."""
    return f""", q AS ({places}), pt AS (
  SELECT n.id, n.lat, n.lon, n.residential, list(DISTINCT l.highway) AS hw, list(DISTINCT l.surface) AS sf FROM nodes n JOIN (SELECT p0 AS node, * FROM lines UNION ALL SELECT p1, * FROM lines) l ON l.node = n.id GROUP BY ALL
), c AS (
  SELECT q.query_id, pt.id, {hav("q.lat", "q.lon", "pt.lat", "pt.lon")} AS dist_m, greatest(abs({CELL.format("q.lat")} - {CELL.format("pt.lat")}), abs({CELL.format("q.lon")} - {CELL.format("pt.lon")})) AS ring FROM q, pt WHERE {where}
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist_m, ring, id) AS k FROM c WHERE ring <= 20
), near AS (SELECT query_id, id, dist_m FROM r WHERE k = 1)"""


def _nearest_sql(where: str) -> str:
    return P + nearest_ctes(PLACES, where) + f" SELECT query_id, id, {w('dist_m')} AS dist_cm FROM near"


def _places(spark, sf_dir):
    _views(spark, sf_dir, ("supplier",))
    return spark.sql(PLACES)


@query(_nearest_sql("true"))
def knn_closest(spark, sf_dir):
    net, lines = order_lines(spark, sf_dir)
    return proximity.nearest(_places(spark, sf_dir), proximity.grid(net.nodes, lines)).select("query_id", "id", whole(F.col("dist_m")).alias("dist_cm"))


@query(_nearest_sql("NOT pt.residential AND NOT list_has_any(pt.sf, ['mud']) AND list_has_any(pt.hw, ['motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified'])"))
def knn_closest_rules(spark, sf_dir):
    net, lines = order_lines(spark, sf_dir)
    found = proximity.nearest(_places(spark, sf_dir), proximity.grid(net.nodes, lines), from_dict({"surface": {"mud": {"action": "avoid"}}}), True, itineraries.WAYPOINT_HIGHWAYS)
    return found.select("query_id", "id", whole(F.col("dist_m")).alias("dist_cm"))


# Itineraries, in the town.

START, FINISH = (30, 57.024, 24.007), (125, 57.02, 24.035)
NEAR_RULES = from_dict({"generation": {"waypoint_generation": {"start_finish": {"variation_distances_m": [1000.0, 2000.0, 3000.0], "variation_bearing_deg": [45.0 * k for k in range(8)]}}}})
ON_WAYPOINT_ROADS = f"list_has_any(pt.hw, [{', '.join(repr(h) for h in itineraries.WAYPOINT_HIGHWAYS)}])"


def _values(numbers) -> str:
    return f"unnest([{', '.join(f'{float(x)!r}e0' for x in numbers)}])"


def to_sql(lat: str, lon: str, deg: str, metres: str) -> str:
    """The destination from a place, as two columns."""
    d, p, b = f"({metres} / 6371008.8e0)", f"radians({lat})", f"radians({deg})"
    t = f"(sin({p}) * cos({d}) + cos({p}) * sin({d}) * cos({b}))"
    return f"degrees(asin({t})) AS lat, fmod({lon} + degrees(atan2(sin({b}) * sin({d}) * cos({p}), cos({d}) - sin({p}) * {t})) + 540, 360.0e0) - 180 AS lon"


def _start_finish_sql(rules) -> str:
    made = rules.generation.waypoint_generation.start_finish
    point = lambda p: f"{p[1]!r}e0 AS lat, {p[2]!r}e0 AS lon"
    from_other = bear("o.lat", "o.lon", "e.lat", "e.lon")
    places = f"""SELECT concat_ws('/', side, deg, dist) AS query_id, side, {to_sql("lat", "lon", "deg", "dist")} FROM (
      SELECT e.*, {from_other} AS other, deg, dist FROM (SELECT 'from' AS side, {point(START)} UNION ALL SELECT 'to', {point(FINISH)}) e
      JOIN (SELECT 'to' AS side, {point(START)} UNION ALL SELECT 'from', {point(FINISH)}) o ON e.side = o.side, (SELECT {_values(made.variation_bearing_deg)} AS deg), (SELECT {_values(made.variation_distances_m)} AS dist)) WHERE abs(deg - other) > {itineraries.ASIDE_DEG}"""
    return T + nearest_ctes(places, ON_WAYPOINT_ROADS) + f""", s AS (SELECT side, id FROM near JOIN q USING (query_id)), t AS (
  SELECT concat(a.id, '-', b.id) AS waypoints FROM s a JOIN s b ON a.side = 'from' AND b.side = 'to' UNION ALL SELECT ''
) SELECT concat('{START[0]}-', waypoints, '-{FINISH[0]}') AS itin_id, CAST({START[0]} AS BIGINT) AS start, CAST({FINISH[0]} AS BIGINT) AS finish, waypoints, 3000.0e0 AS radius, false AS visit_all FROM t"""


TOWARDS, METRES, ADJUSTMENT = 350.0, 9000.0, -45.0


def _round_trip_sql(rules) -> str:
    made = rules.generation.waypoint_generation.round_trip
    places = f"""SELECT concat_ws('/', which, turn, ratio) AS query_id, which, turn, {to_sql(f"{START[1]!r}e0", f"{START[2]!r}e0", f"({TOWARDS + ADJUSTMENT}e0 + turn + aside)", f"({METRES / 5}e0 * ratio)")}
      FROM (SELECT unnest(['left', 'tip', 'right']) AS which, unnest([-45.0e0, 0.0e0, 45.0e0]) AS aside), (SELECT {_values(made.variation_bearing_deg)} AS turn), (SELECT {_values(made.variation_distance_ratios)} AS ratio)"""
    return T + nearest_ctes(places, ON_WAYPOINT_ROADS) + f""", s AS (SELECT which, turn, id FROM near JOIN q USING (query_id)), t AS (
  SELECT concat_ws('-', a.id, b.id, c.id) AS waypoints FROM s a JOIN s b ON a.turn = b.turn JOIN s c ON a.turn = c.turn WHERE a.which = 'left' AND b.which = 'tip' AND c.which = 'right'
) SELECT concat('{START[0]}-', waypoints, '-{START[0]}') AS itin_id, CAST({START[0]} AS BIGINT) AS start, CAST({START[0]} AS BIGINT) AS finish, waypoints, 3000.0e0 AS radius, true AS visit_all FROM t"""


def _joined(trips: DataFrame) -> DataFrame:
    return trips.withColumn("waypoints", F.array_join(F.col("waypoints").cast("array<string>"), "-"))


@query(_start_finish_sql(NEAR_RULES))
def itineraries_start_finish(spark, sf_dir):
    net, lines = _town(spark, sf_dir)
    return _joined(itineraries.start_finish(START, FINISH, proximity.grid(net.nodes, lines), NEAR_RULES))


@query(_round_trip_sql(Rules()))
def itineraries_round_trip(spark, sf_dir):
    net, lines = _town(spark, sf_dir)
    return _joined(itineraries.round_trip(START, TOWARDS, METRES, proximity.grid(net.nodes, lines), adjustment=ADJUSTMENT))


@query("""WITH n AS (SELECT CAST(a.n_nationkey AS BIGINT) AS id, CAST(b.n_nationkey AS BIGINT) AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT concat_ws('-', n.id, s.s_suppkey, n.other, 100 + n.id) AS itin_id, s.s_suppkey AS w1, n.other AS w2 FROM supplier s JOIN n ON s.s_nationkey = n.id
UNION ALL SELECT concat(n_nationkey, '--', 100 + n_nationkey), NULL, NULL FROM nation""")
def itinerary_ids(spark, sf_dir):
    """For each nation a request: every waypoint of one side (its suppliers) with every one of the other (the nations of its
    region), and the direct itinerary."""
    _views(spark, sf_dir, ("supplier", "nation"))
    near = spark.sql("SELECT CAST(a.n_nationkey AS BIGINT) AS id, CAST(b.n_nationkey AS BIGINT) AS w2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
    pairs = spark.table("supplier").select(F.col("s_nationkey").cast("long").alias("id"), F.col("s_suppkey").alias("w1")).join(near, "id").select("id", F.array("w1", "w2").alias("waypoints"))
    direct = spark.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array().cast("array<bigint>").alias("waypoints"))
    return pairs.unionByName(direct).select(itineraries.itinerary_id(F.col("id"), F.col("waypoints"), F.col("id") + 100).alias("itin_id"), F.get("waypoints", 0).alias("w1"), F.get("waypoints", 1).alias("w2"))


# Routes.


@query(R + f" SELECT route_id, {w('sum(len_m)')} AS len_cm, count(*) FILTER (junction) AS junctions FROM segs GROUP BY route_id")
def route_totals(spark, sf_dir):
    return routes.totals(order_segments(spark, sf_dir)).select("route_id", whole(F.col("len_m")).alias("len_cm"), "junctions")


@query(R + f""", t AS (SELECT route_id, unnest(['highway', 'surface', 'smoothness']) AS family, unnest([coalesce(highway, 'unknown'), coalesce(surface, 'unknown'), coalesce(smoothness, 'unknown')]) AS value, len_m FROM segs),
g AS (SELECT route_id, family, value, sum(len_m) AS len_m FROM t GROUP BY ALL)
SELECT route_id, family, value, {w('len_m')} AS len_cm, {w('CASE WHEN sum(len_m) OVER (PARTITION BY route_id, family) > 0 THEN len_m / sum(len_m) OVER (PARTITION BY route_id, family) * 100 END')} AS percent_100 FROM g""")
def route_tag_shares(spark, sf_dir):
    return routes.tag_shares(order_segments(spark, sf_dir)).select("route_id", "family", "value", whole(F.col("len_m")).alias("len_cm"), whole(F.col("percentage")).alias("percent_100"))


@query(R + f""", b AS (SELECT *, {bear("end_lat", "end_lon", "start_lat", "start_lon")} AS b, junction OR coalesce(highway = 'residential' OR (residential AND highway IS NOT NULL), false) AS reset FROM segs),
t AS (SELECT *, abs(lag(CASE WHEN NOT reset THEN b END) OVER (PARTITION BY route_id ORDER BY seq) - b) AS turn,
  1 + CASE highway WHEN 'primary' THEN 100 / 255.0e0 WHEN 'unclassified' THEN 1 ELSE 0 END + CASE surface WHEN 'gravel' THEN 51 / 255.0e0 ELSE 0 END + CASE smoothness WHEN 'good' THEN 10 / 255.0e0 ELSE 0 END AS more FROM b)
SELECT route_id, {w('sum(CASE WHEN turn < 90 THEN turn * more ELSE 0 END) / nullif(sum(len_m), 0) * 1000')} AS score_100 FROM t GROUP BY route_id""")
def route_score(spark, sf_dir):
    return routes.scores(order_segments(spark, sf_dir), RULES).select("route_id", whole(F.col("score")).alias("score_100"))


SAME = "(coalesce({0}.ref = {1}.ref, false) OR coalesce({0}.name = {1}.name, false))"


@query(R + f""", z AS (SELECT * FROM segs s WHERE seq = (SELECT max(seq) FROM segs x WHERE x.route_id = s.route_id))
SELECT s.route_id, bool_or(s.seq < z.seq AND (s.end_point = z.end_point OR ({hav("s.end_lat", "s.end_lon", "z.end_lat", "z.end_lon")} < 50 AND z.seq - s.seq > 10 AND {SAME.format("s", "z")}))) AS looped FROM segs s JOIN z ON z.route_id = s.route_id GROUP BY s.route_id""")
def route_loops(spark, sf_dir):
    return routes.loops(order_segments(spark, sf_dir))


@query(R + f""", f AS (SELECT route_id, concat('road_', CAST(route_id % 50 AS VARCHAR)) AS name, concat('P', CAST(route_id % 4 * 5 AS VARCHAR)) AS ref FROM (SELECT DISTINCT route_id FROM segs)),
st AS (SELECT *, coalesce({hav("end_lat", "end_lon", "lead(end_lat) OVER o", "lead(end_lon) OVER o")}, 0) AS step FROM segs WINDOW o AS (PARTITION BY route_id ORDER BY seq)),
rn AS (SELECT *, sum(step) OVER o AS run, row_number() OVER o AS place FROM st WINDOW o AS (PARTITION BY route_id ORDER BY seq DESC)),
h AS (SELECT r.route_id, min(struct_pack(place := place, run := run)) FILTER ({SAME.format("r", "f")}) AS h FROM rn r JOIN f ON f.route_id = r.route_id GROUP BY r.route_id)
SELECT route_id, coalesce(h.place > 1 AND h.run <= 300000, false) AS back FROM h""")
def route_detour(spark, sf_dir):
    segments = order_segments(spark, sf_dir)
    forks = segments.select("route_id").distinct().select("route_id", F.concat(F.lit("P"), F.col("route_id") % 4 * 5).alias("fork_ref"), F.concat(F.lit("road_"), F.col("route_id") % 50).alias("fork_name"))
    return routes.detours(segments, forks, 300000.0)


@query(R + """, z AS (SELECT *, last_value(end_point) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM segs),
m AS (SELECT *, coalesce(max(seq) FILTER (junction AND end_point <> z) OVER (PARTITION BY route_id), -1) AS since FROM z) SELECT route_id, seq, line FROM m WHERE seq >= since""")
def route_suffix(spark, sf_dir):
    return routes.last_chunk(order_segments(spark, sf_dir)).select("route_id", F.col("seq").cast("long").alias("seq"), "line")


@query(R + """, n AS (SELECT *, count(*) FILTER (junction) OVER (PARTITION BY route_id ORDER BY seq DESC) AS n, count(*) OVER (PARTITION BY route_id) AS size FROM segs)
SELECT route_id, seq, end_point FROM n WHERE junction AND n = 5 AND size > 5""")
def route_junctions_back(spark, sf_dir):
    return routes.junctions_back(order_segments(spark, sf_dir), 5).withColumn("seq", F.col("seq").cast("long"))


@query(R + " SELECT route_id, seq, end_point FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY seq DESC) AS n FROM segs) WHERE n = 8")
def route_segments_back(spark, sf_dir):
    return routes.segments_back(order_segments(spark, sf_dir), 7).withColumn("seq", F.col("seq").cast("long"))


@query(R + """, p AS (SELECT route_id, min(end_point) AS point FROM segs GROUP BY route_id), f AS (SELECT s.*, coalesce(min(seq) FILTER (end_point = point) OVER (PARTITION BY s.route_id), -1) AS f FROM segs s JOIN p ON p.route_id = s.route_id)
SELECT route_id, seq, line FROM f WHERE seq >= f""")
def route_since_point(spark, sf_dir):
    segments = order_segments(spark, sf_dir)
    return routes.since_point(segments, segments.groupBy("route_id").agg(F.min("end_point").alias("point"))).select("route_id", F.col("seq").cast("long").alias("seq"), "line")


@query(R + f""", i AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM segs), b AS (SELECT route_id, (SELECT min(k) FROM range(10) t(k) WHERE seq < floor((k + 1) * n / 10.0e0)) AS bucket, end_lat, end_lon FROM i)
SELECT route_id, CAST(bucket AS INTEGER) AS bucket, {w('avg(end_lat)', 100000)} AS lat_e5, {w('avg(end_lon)', 100000)} AS lon_e5 FROM b GROUP BY route_id, bucket""")
def route_approx10(spark, sf_dir):
    return routes.approximation(order_segments(spark, sf_dir)).select("route_id", "bucket", whole(F.col("lat"), 100000).alias("lat_e5"), whole(F.col("lon"), 100000).alias("lon_e5"))


@query(R + " SELECT route_id, string_agg(CAST(CAST(floor(end_lat * 1000 + 0.5) AS BIGINT) AS VARCHAR), ' ' ORDER BY seq) AS lats FROM segs GROUP BY route_id")
def route_coordinates(spark, sf_dir):
    found = routes.coordinates(order_segments(spark, sf_dir))
    return found.select("route_id", F.array_join(F.transform("coords", lambda p: whole(p["lat"], 1000).cast("string")), " ").alias("lats"))


# Clusters, with labels given.

SCORED = "SELECT p_partkey AS route_id, CAST(p_partkey * 31 % 41 - 1 AS INTEGER) AS label, CAST(floor(p_retailprice * 7) AS BIGINT) % 1000 AS score FROM part"


def _scored(spark, sf_dir):
    _views(spark, sf_dir, ("part",))
    return spark.sql(SCORED)


@query(f"WITH s AS ({SCORED}) SELECT route_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, route_id) AS n FROM s WHERE label >= 0) WHERE n = 1")
def best_per_cluster(spark, sf_dir):
    return clusters.best_of_clusters(_scored(spark, sf_dir))


@query(f"WITH s AS ({SCORED}) SELECT route_id, label, score FROM s WHERE label < 0 ORDER BY score DESC, route_id LIMIT 3")
def noise_topk(spark, sf_dir):
    return clusters.best_of_noise(_scored(spark, sf_dir), 40)


# Traces, made of events.

KEY = "concat('i', CAST(user_id % 10 AS VARCHAR(20))) AS itinerary_id, event_id % 200 AS step_num, user_id AS end_point_id"
WEIGHTS = f"""SELECT {KEY}, concat('w', CAST(event_id % 12 AS VARCHAR(20))) AS weight_name,
  CASE WHEN event_id % 17 = 0 THEN 'ForkChoiceDoNotUse' WHEN event_id % 101 = 0 THEN 'LastSegmentDoNotUse' ELSE 'ForkChoiceUseWithWeight' END AS weight_type,
  CASE WHEN event_id % 17 = 0 OR event_id % 101 = 0 THEN 0 ELSE event_id % 256 END AS weight_value, event_id AS idx FROM events"""
CHOICES = f"SELECT DISTINCT {KEY}, user_id AS segment_end_point, user_id % 3 = 0 AS discarded FROM events"
RESULTS = "SELECT concat('i', CAST(user_id % 10 AS VARCHAR(20))) AS itinerary_id, event_id % 200 AS step_num, 'ForkChoice' AS result, max(user_id) AS chosen_fork_point_id FROM events GROUP BY 1, 2"
STEPS = "SELECT concat('i', CAST(user_id % 10 AS VARCHAR(20))) AS itinerary_id, event_id AS step_num, 'fork' AS move_result, concat('[[', CAST(event_id % 90 AS VARCHAR(20)), '.5,', CAST(user_id AS VARCHAR(20)), '.25],[1.0,2.0]]') AS route FROM events"


def _trace(spark, sf_dir, sql):
    _views(spark, sf_dir, ("events",))
    return spark.sql(sql)


@query(f"WITH w AS ({WEIGHTS}) SELECT * FROM w WHERE itinerary_id = 'i3' ORDER BY itinerary_id, weight_name DESC, step_num, idx LIMIT 20 OFFSET 40")
def debug_page(spark, sf_dir):
    return trace.page(_trace(spark, sf_dir, WEIGHTS).orderBy("idx"), "i3", number=2, then=[F.desc("weight_name"), "step_num", "idx"])


@query(f"WITH s AS ({STEPS}) SELECT step_num, CAST(json_extract(route, '$[0][0]') AS DOUBLE) AS lat, CAST(json_extract(route, '$[0][1]') AS DOUBLE) AS lon, CAST(json_array_length(route) AS INTEGER) AS n FROM s WHERE itinerary_id = 'i4' AND step_num <= 4000")
def debug_route_prefix(spark, sf_dir):
    found = trace.route_until(_trace(spark, sf_dir, STEPS), "i4", 4000)
    return found.select("step_num", F.col("points")[0][0].alias("lat"), F.col("points")[0][1].alias("lon"), F.size("points").alias("n"))


@query(f"WITH w AS ({WEIGHTS}), c AS ({CHOICES}), r AS ({RESULTS}) SELECT c.itinerary_id, c.step_num, c.end_point_id, c.discarded, w.weight_name, w.weight_value, w.idx, coalesce(c.end_point_id = r.chosen_fork_point_id, false) AS chosen FROM c LEFT JOIN w ON w.itinerary_id = c.itinerary_id AND w.step_num = c.step_num AND w.end_point_id = c.end_point_id LEFT JOIN r ON r.itinerary_id = c.itinerary_id AND r.step_num = c.step_num")
def debug_step_join(spark, sf_dir):
    found = trace.decisions(*(_trace(spark, sf_dir, q) for q in (RESULTS, CHOICES, WEIGHTS)))
    return found.select("itinerary_id", "step_num", "end_point_id", "discarded", "weight_name", "weight_value", "idx", "chosen")


@query(f"""WITH w AS ({WEIGHTS}), e AS (SELECT itinerary_id, step_num, end_point_id, CAST(sum(weight_value) AS BIGINT) AS weight, bool_or(weight_type = 'ForkChoiceDoNotUse') AS out, bool_or(weight_type = 'LastSegmentDoNotUse') AS ovr FROM w GROUP BY ALL),
k AS (SELECT *, bool_or(ovr) OVER (PARTITION BY itinerary_id, step_num) AS stop, row_number() OVER (PARTITION BY itinerary_id, step_num ORDER BY out, weight DESC, end_point_id) AS n FROM e)
SELECT itinerary_id, step_num, CASE WHEN NOT stop AND NOT out THEN end_point_id END AS end_point_id, CASE WHEN NOT stop AND NOT out THEN weight END AS weight FROM k WHERE n = 1""")
def fork_decision(spark, sf_dir):
    return trace.fork_decisions(_trace(spark, sf_dir, WEIGHTS))


# Searches and clusters: no SQL. Tests compare them with brute force.


SEARCH_RULES = from_dict({"basic": {"step_limit": 400}, "generation": {"waypoint_generation": {"start_finish": {"variation_distances_m": [1500.0], "variation_bearing_deg": [0.0, 90.0, 180.0, 270.0]}}}})


def _searched(spark, sf_dir):
    roads = G.Roads.of(town(spark, sf_dir))
    return navigate.compact(roads.nodes, roads.lines), itineraries.start_finish(START, FINISH, roads.points(), SEARCH_RULES).dropDuplicates(["itin_id"])


@query()
def navigate_lattice(spark, sf_dir):
    compact, trips = _searched(spark, sf_dir)
    return navigate.search(trips, compact, SEARCH_RULES)


@query()
def navigate_trace(spark, sf_dir):
    compact, trips = _searched(spark, sf_dir)
    return navigate.trace_table(navigate.traced(trips, compact, SEARCH_RULES), "weights")


@query()
def generate_routes(spark, sf_dir):
    roads = G.Roads.of(town(spark, sf_dir))
    return G.generate(roads, from_dict(NEAR_RULES_FILE), START[1:], FINISH[1:]).drop("coords")


NEAR_RULES_FILE = {
    "basic": {"step_limit": 300},
    "highway": {"primary": {"action": "priority", "value": 50}},
    "generation": {"waypoint_generation": {"start_finish": {"variation_distances_m": [1500.0], "variation_bearing_deg": [0.0, 90.0, 180.0, 270.0]}}, "route_generation_retry": {"trigger_min_route_count": 2, "round_trip_adjustment_bearing_deg": [], "avoid_residential": [False]}},
}


@query()
def hdbscan_labels(spark, sf_dir):
    """Suppliers around a few towns, by place; each nation is a request."""
    _views(spark, sf_dir, ("supplier",))
    rows = spark.sql("SELECT s_suppkey, s_nationkey, array(CAST(s_suppkey % 5 AS DOUBLE) + s_acctbal / 1000000, CAST(s_suppkey % 3 AS DOUBLE) + s_acctbal / 500000) AS vector FROM supplier")
    return clusters.labelled(rows, "s_suppkey", "vector", 0.1, by="s_nationkey")


# Areas: the block beside each customer of two segments.

AREA_M2, SIDE_LAT, SIDE_LON = 20000.0, 0.0039, 0.0069
AREAS_SQL = "SELECT c_custkey AS area_id, 57 + (c_custkey % 24) * 0.004e0 + 0.0000039e0 AS y0, 24 + floor(c_custkey / 24.0e0) * 0.007e0 + 0.0000069e0 AS x0, 57 + (c_custkey % 24) * 0.004e0 + 0.0039e0 AS y1, 24 + floor(c_custkey / 24.0e0) * 0.007e0 + 0.0069e0 AS x1, c_mktsegment AS land FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


def _squares(spark, sf_dir):
    net = town(spark, sf_dir)
    corner = lambda y, x: F.struct(F.col(y).alias("lat"), F.col(x).alias("lon"))
    none = F.array().cast("array<array<struct<lat: double, lon: double>>>")
    outer = F.array(corner("y0", "x0"), corner("y0", "x1"), corner("y1", "x1"), corner("y1", "x0"), corner("y0", "x0"))
    return net, spark.sql(AREAS_SQL).select("area_id", F.lit(0).alias("part"), outer.alias("outer"), none.alias("holes"), F.lit(AREA_M2).alias("area_m2"), "land")


@query(f"""WITH a AS ({AREAS_SQL}), b AS (SELECT area_id, {CELL.format("y0")} AS lo, {CELL.format("y1")} AS hi, {CELL.format("x0")} AS le, {CELL.format("x1")} AS ri FROM a),
c AS (SELECT *, unnest(range(lo, hi + 1)) AS cell_lat FROM b) SELECT area_id, 0 AS part, CAST(cell_lat AS INTEGER) AS cell_lat, CAST(unnest(range(le, ri + 1)) AS INTEGER) AS cell_lon FROM c""")
def polygon_cells(spark, sf_dir):
    return areas.cells(_squares(spark, sf_dir)[1])


EDGE_M = "6371008.8e0 * radians(CASE WHEN dy < 0 AND dx < 0 THEN least(-dy, -dx) ELSE sqrt(pow(greatest(dy, 0), 2) + pow(greatest(dx, 0), 2)) END)"


@query(T + f""", a AS ({AREAS_SQL}), m AS (
  SELECT n.id, a.land, greatest(y0 - lat, lat - y1) AS dy, greatest(x0 - lon, lon - x1) * cos(radians(lat)) AS dx FROM nodes n JOIN a ON abs(y0 - lat) < 0.02 AND abs(x0 - lon) < 0.03
), e AS (SELECT id, land, dy < 0 AND dx < 0 AS inside, {EDGE_M} AS edge_m FROM m), f AS (
  SELECT id, sum({AREA_M2}e0) FILTER (land = 'BUILDING' AND (inside OR edge_m <= 500)) AS homes, bool_or(land = 'MACHINERY' AND inside AND edge_m > 100) AS ban FROM e GROUP BY id
) SELECT n.id, n.lat, n.lon, coalesce(homes > {areas.RESIDENTIAL_M2!r}e0, false) AS residential, coalesce(ban, false) AS nogo FROM nodes n LEFT JOIN f USING (id)""")
def area_flags(spark, sf_dir):
    net, found = _squares(spark, sf_dir)
    return areas.flagged(net.nodes.withColumn("lat", F.col("lat").cast("double")), found.filter("land = 'BUILDING'").drop("land"), found.filter("land = 'MACHINERY'").drop("land"))
