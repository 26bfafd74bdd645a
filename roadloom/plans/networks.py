"""Road networks.

A network is three tables: nodes (id, lat, lon, residential, nogo), ways (id, nodes, tags) and relations (id, members,
tags). Besides those read from map files there are two that are derived from the analytics tables, so that every operator
can be run and checked at any scale: the order network, where parts are nodes and each order is a way through its parts,
and the town, where each customer is a crossing of regular streets. The lattice is a town of any size without tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.graph import WAY_STEP


@dataclass
class Network:
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


#: The order network in SQL that both Spark and DuckDB understand; nodes and ways are lists of rows here.
NODES_SQL = """SELECT p_partkey AS id, 57 + (p_partkey % 45) * 0.004e0 AS lat, 24 + floor(p_partkey / 45.0e0) * 0.007e0 AS lon,
  p_size % 7 = 0 AS residential, p_size % 31 = 0 AS nogo FROM part"""
WAY_NODES_SQL = """SELECT l_orderkey AS way_id, l_partkey AS node,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS pos FROM lineitem"""
WAY_TAGS_SQL = """SELECT o_orderkey AS id,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'tertiary_link' WHEN '4' THEN 'unclassified'
    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'path' ELSE 'residential' END END AS highway,
  CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS oneway,
  CASE WHEN o_orderkey % 97 = 0 THEN 'roundabout' END AS junction,
  CASE WHEN o_orderkey % 83 = 0 THEN 'mud' ELSE CASE o_custkey % 4 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 3 THEN 'dirt' END END AS surface,
  CASE o_custkey % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' END AS smoothness,
  concat('road_', CAST(o_custkey % 50 AS VARCHAR(20)), CASE WHEN o_custkey % 9 = 0 THEN '_link' ELSE '' END) AS name,
  CASE WHEN o_custkey % 5 = 0 THEN concat('P', CAST(o_custkey % 20 AS VARCHAR(20))) END AS ref,
  CASE WHEN o_orderkey % 41 = 0 THEN 'alley' END AS service,
  CASE WHEN o_orderkey % 37 = 0 THEN 'private' WHEN o_orderkey % 31 = 0 THEN 'permissive' END AS access,
  CASE WHEN o_orderkey % 29 = 0 THEN 'no' END AS motor_vehicle FROM orders"""
#: Restrictions are events: the via is the user's part; from and to are the least and the greatest way through it.
RESTRICTIONS_SQL = """SELECT e.event_id AS rel_id, e.user_id AS via, w.lo AS from_way, w.hi AS to_way,
  CASE e.event_id % 5 WHEN 0 THEN 'no_left_turn' WHEN 1 THEN 'only_straight_on' WHEN 2 THEN 'no_u_turn @ (22:00-06:00)' WHEN 3 THEN 'no_thing' ELSE 'no_entry' END AS said,
  CASE e.event_id % 7 WHEN 0 THEN 'route' ELSE 'restriction' END AS kind
  FROM events e JOIN (SELECT l_partkey AS node, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem GROUP BY l_partkey) w ON w.node = e.user_id"""
#: The town: streets along every row of TOWN_WIDTH customers and across, in stretches of as many; every fifth row is one-way, and in
#: each stretch of rows four points are a roundabout. ``r`` counts a customer's place from the roundabout's first point.
TOWN_WIDTH = 24
TOWN_NODES_SQL = """SELECT c_custkey AS id, 57 + (c_custkey % 24) * 0.004e0 AS lat, 24 + floor(c_custkey / 24.0e0) * 0.007e0 AS lon,
  c_custkey % 43 = 0 AS residential, c_custkey % 211 = 200 AS nogo FROM customer"""
_TOWN_RING_SQL = "SELECT 3000000000 + CAST(floor(c_custkey / 576.0e0) AS BIGINT) AS way_id, c_custkey AS node, c_custkey % 576 - 60 AS r FROM customer"
TOWN_WAY_NODES_SQL = f"""SELECT 1000000000 + CAST(floor(c_custkey / 24.0e0) AS BIGINT) AS way_id, c_custkey AS node, c_custkey % 24 AS pos FROM customer
  UNION ALL SELECT 2000000000 + CAST(floor(c_custkey / 576.0e0) AS BIGINT) * 24 + c_custkey % 24, c_custkey, CAST(floor(c_custkey % 576 / 24.0e0) AS BIGINT) FROM customer
  UNION ALL SELECT 2000000000 + (CAST(floor(c_custkey / 576.0e0) AS BIGINT) - 1) * 24 + c_custkey % 24, c_custkey, 24 FROM customer WHERE c_custkey >= 576 AND c_custkey % 576 < 24
  UNION ALL SELECT way_id, node, CASE r WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 25 THEN 2 ELSE 3 END FROM ({_TOWN_RING_SQL}) WHERE r IN (0, 1, 24, 25)
  UNION ALL SELECT way_id, node, 4 FROM ({_TOWN_RING_SQL}) WHERE r = 0"""
TOWN_WAY_TAGS_SQL = f"""SELECT id, CASE kind WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'tertiary' ELSE 'unclassified' END AS highway,
  CASE WHEN along = 'row' AND k % 5 = 4 THEN 'yes' END AS oneway, CASE WHEN along = 'ring' THEN 'roundabout' END AS junction,
  CASE WHEN along = 'row' THEN CASE WHEN k % 3 = 2 THEN 'gravel' ELSE 'asphalt' END END AS surface, CASE WHEN along = 'column' AND k % 6 = 0 THEN 'bad' END AS smoothness,
  CASE WHEN along = 'row' THEN concat('row ', CAST(k AS VARCHAR(20))) END AS name, CASE WHEN along = 'column' AND k % 2 = 0 THEN concat('C', CAST(k AS VARCHAR(20))) END AS ref,
  CAST(NULL AS VARCHAR(20)) AS service, CAST(NULL AS VARCHAR(20)) AS access, CAST(NULL AS VARCHAR(20)) AS motor_vehicle
  FROM (SELECT way_id AS id, CASE CAST(floor(way_id / 1000000000.0e0) AS BIGINT) WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'ring' END AS along,
    CASE CAST(floor(way_id / 1000000000.0e0) AS BIGINT) WHEN 2 THEN way_id % 1000000000 % 24 ELSE way_id % 1000000000 END AS k,
    CASE CAST(floor(way_id / 1000000000.0e0) AS BIGINT) WHEN 1 THEN way_id % 4 WHEN 2 THEN (way_id % 1000000000 % 24 + 2) % 4 ELSE 0 END AS kind
    FROM (SELECT DISTINCT way_id FROM ({TOWN_WAY_NODES_SQL})))"""
TAGS = ["highway", "oneway", "junction", "surface", "smoothness", "name", "ref", "service", "access", "motor_vehicle"]


def _views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def _tag_map(pairs: list) -> F.Column:
    made = F.map_from_entries(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs)))
    return F.map_filter(made, lambda k, v: v.isNotNull())


def _ways(spark: SparkSession, way_nodes: str, way_tags: str, made=lambda rows: rows) -> DataFrame:
    """The ways. Tags are many times as large in memory as what a file's size says, so they are not broadcast."""
    points = spark.sql(way_nodes).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes"))
    tags = made(spark.sql(way_tags)).select("id", _tag_map([(t, F.col(t)) for t in TAGS]).alias("tags"))
    return points.join(tags.hint("merge"), points.way_id == tags.id).select("id", "nodes", "tags")


def order_network(spark: SparkSession, sf_dir: str) -> Network:
    _views(spark, sf_dir, ("part", "lineitem", "orders", "events"))
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), F.col(ref).alias("ref"), F.lit(role).alias("role"))
    relations = spark.sql(RESTRICTIONS_SQL).select(
        F.col("rel_id").alias("id"),
        F.array(member("way", "from_way", "from"), member("node", "via", "via"), member("way", "to_way", "to")).alias("members"),
        _tag_map([("type", F.col("kind")), ("restriction", F.col("said"))]).alias("tags"),
    )
    return Network(spark.sql(NODES_SQL), _ways(spark, WAY_NODES_SQL, WAY_TAGS_SQL), relations)


NO_RELATIONS = "id bigint, members array<struct<type: string, ref: bigint, role: string>>, tags map<string, string>"


def _apart(rows: DataFrame) -> DataFrame:
    """rows by id, through an aggregate: else the optimizer copies their expressions into all that is computed from them."""
    return rows.groupBy("id").agg(*(F.first(c).alias(c) for c in rows.columns if c != "id"))


def town(spark: SparkSession, sf_dir: str) -> Network:
    _views(spark, sf_dir, ("customer",))
    return Network(_apart(spark.sql(TOWN_NODES_SQL)), _ways(spark, TOWN_WAY_NODES_SQL, TOWN_WAY_TAGS_SQL, _apart), spark.createDataFrame([], NO_RELATIONS).filter("false"))


def lattice(spark: SparkSession, size: int = 24) -> Network:
    """Streets along every row and column of size x size points; every fifth row is one-way, and in the middle four points
    are a roundabout."""
    n = size * size
    nodes = spark.range(n).select("id", (57 + (F.col("id") % size) * 0.004).alias("lat"), (24 + F.floor(F.col("id") / size) * 0.007).alias("lon"), (F.col("id") % 43 == 0).alias("residential"), (F.col("id") % 211 == 200).alias("nogo"))
    line = spark.range(size).withColumn("k", F.col("id"))
    steps = F.sequence(F.lit(0), F.lit(size - 1))
    kinds = F.array(*map(F.lit, ("primary", "secondary", "tertiary", "unclassified")))
    grounds = F.array(*map(F.lit, ("asphalt", "asphalt", "gravel")))
    rows = line.select((F.col("k") + 1000).alias("id"), F.transform(steps, lambda i: F.col("k") * size + i).alias("nodes"), _tag_map([("highway", kinds[(F.col("k") % 4).cast("int")]), ("name", F.concat(F.lit("row "), "k")), ("surface", grounds[(F.col("k") % 3).cast("int")]), ("oneway", F.when(F.col("k") % 5 == 4, "yes"))]).alias("tags"))
    columns = line.select((F.col("k") + 2000).alias("id"), F.transform(steps, lambda i: i * size + F.col("k")).alias("nodes"), _tag_map([("highway", kinds[((F.col("k") + 2) % 4).cast("int")]), ("ref", F.when(F.col("k") % 2 == 0, F.concat(F.lit("C"), "k"))), ("smoothness", F.when(F.col("k") % 6 == 0, "bad"))]).alias("tags"))
    m = size // 2 * size + size // 2
    around = spark.range(1).select(F.lit(3000).cast("long").alias("id"), F.array(*(F.lit(x).cast("long") for x in (m, m + 1, m + size + 1, m + size, m))).alias("nodes"), _tag_map([("highway", F.lit("primary")), ("junction", F.lit("roundabout"))]).alias("tags"))
    return Network(nodes, rows.unionByName(columns).unionByName(around), spark.createDataFrame([], NO_RELATIONS))


def sql_prelude(nodes: str = NODES_SQL, way_nodes: str = WAY_NODES_SQL, way_tags: str = WAY_TAGS_SQL) -> str:
    """The order network, or the town, as common table expressions for DuckDB: nodes, way_nodes, way_tags, restrictions, roads,
    lines."""
    return f"""WITH RECURSIVE nodes AS ({nodes}), way_nodes AS ({way_nodes}), way_tags AS ({way_tags}), restrictions AS ({RESTRICTIONS_SQL}),
roads AS (
  SELECT *, CASE WHEN junction = 'roundabout' THEN 'roundabout' WHEN oneway = 'yes' THEN 'oneway' ELSE 'both' END AS direction FROM way_tags
  WHERE service IS NULL AND (access IS NULL OR access IN ('yes', 'permissive', 'public')) AND (motor_vehicle IS NULL OR motor_vehicle IN ('yes', 'permissive', 'public'))
    AND highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified', 'residential', 'motorway_link', 'trunk_link', 'primary_link', 'secondary_link', 'tertiary_link', 'living_street', 'track', 'escape', 'raceway', 'road')
), steps AS (
  SELECT way_id, pos, node AS p0, lead(node) OVER (PARTITION BY way_id ORDER BY pos) AS p1 FROM way_nodes
), lines AS (
  SELECT s.way_id * {WAY_STEP} + s.pos AS line, s.way_id, s.pos AS seq, s.p0, s.p1, r.direction,
    CASE WHEN r.name LIKE '%!_link' ESCAPE '!' THEN replace(r.name, '_link', '') ELSE r.name END AS name, r.ref,
    CASE WHEN r.highway LIKE '%!_link' ESCAPE '!' THEN replace(r.highway, '_link', '') ELSE r.highway END AS highway, r.surface, r.smoothness
  FROM steps s JOIN roads r ON s.way_id = r.id WHERE s.p1 IS NOT NULL
)"""
