"""Map elements from JSON: one document with an ``elements`` array, or one element a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.tags import relation_ok, way_ok
from roadloom.operators import areas
from roadloom.plans.networks import Network

ELEMENT = "type string, id string, lat string, lon string, nodes array<string>, members array<struct<type: string, ref: string, role: string>>, tags map<string, string>"
TYPES, MEMBER_TYPES = ["node", "way", "relation"], ["node", "way"]


class MapDataError(ValueError):
    pass


def elements(spark: SparkSession, path: str) -> DataFrame:
    """All elements of a file or folder, with their places (pos). Unknown keys are ignored. Files that end in .jsonl hold an
    element a line and can be split among tasks; others are documents, each read by one task."""
    if path.endswith(".jsonl"):
        return spark.read.schema(ELEMENT).option("mode", "FAILFAST").json(path).withColumn("pos", F.monotonically_increasing_id())
    found = spark.read.schema(f"elements array<struct<{', '.join(c.replace(' ', ': ', 1) for c in _columns())}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return found.select(F.posexplode("elements").alias("pos", "e")).select("e.*", F.col("pos").cast("long").alias("pos"))


def _columns() -> list[str]:
    return ["type string", "id string", "lat string", "lon string", "nodes array<string>", "members array<struct<type: string, ref: string, role: string>>", "tags map<string, string>"]


def problem() -> F.Column:
    """Why an element can't be used; null if it can."""
    number = lambda c, kind: F.col(c).isNull() | F.expr(f"try_cast({c} AS {kind})").isNull()
    bad_members = F.exists("members", lambda m: ~m["type"].isin(MEMBER_TYPES) | m["type"].isNull() | m["ref"].isNull())
    return (
        F.when(F.col("type").isNull() | ~F.col("type").isin(TYPES), "unknown element type")
        .when(number("id", "bigint"), "bad id")
        .when((F.col("type") == "node") & (number("lat", "double") | number("lon", "double")), "bad coordinate")
        .when((F.col("type") == "way") & F.col("nodes").isNull(), "no nodes")
        .when((F.col("type") == "relation") & (F.col("tags").isNull() | F.col("members").isNull()), "no tags or members")
        .when((F.col("type") == "relation") & bad_members, "unknown member type")
    )


def rejects(found: DataFrame) -> DataFrame:
    return found.withColumn("problem", problem()).filter("problem is not null")


def role() -> F.Column:
    return F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["ref"].cast("bigint").alias("ref"), F.when(m["role"].isin("from", "to", "via"), m["role"]).otherwise(F.coalesce(m["role"], F.lit("other"))).alias("role")))


def network(found: DataFrame, strict: bool = False) -> Network:
    """The nodes, ways and relations of elements(). Elements that can't be used are left out (see rejects()), or, strict,
    fail the query that meets them. Of a node that is there twice, the last counts (without places: the one of the greatest
    lat and lon)."""
    found = found.withColumn("problem", problem())
    if strict:
        stop = F.raise_error(F.concat(F.lit("map data: "), "problem", F.lit(" in element "), F.coalesce("id", F.lit("without id"))))
        found = found.filter(F.when(F.col("problem").isNull(), True).otherwise(stop.cast("boolean")))
    ok = found.filter("problem is null")
    place = F.max(F.struct(*(["pos"] if "pos" in found.columns else []), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))
    nodes = ok.filter("type = 'node'").groupBy(F.col("id").cast("bigint").alias("id")).agg(place.alias("p")).select("id", "p.lat", "p.lon", F.lit(False).alias("residential"), F.lit(False).alias("nogo"))
    ways = ok.filter("type = 'way'").select(F.col("id").cast("bigint").alias("id"), F.col("nodes").cast("array<bigint>").alias("nodes"), "tags")
    relations = ok.filter("type = 'relation'").select(F.col("id").cast("bigint").alias("id"), role().alias("members"), "tags")
    return Network(nodes, ways, relations)


def read(spark: SparkSession, path: str, strict: bool = False) -> Network:
    """A network by the kind of file: .json, .jsonl or .pbf. Extracts in .pbf hold everything of a region: of these, only usable
    roads, restrictions and the nodes of either are kept, and nodes are flagged by the areas around them."""
    if path.endswith((".json", ".jsonl")):
        return network(elements(spark, path), strict)
    if path.endswith(".pbf"):
        from roadloom.sources import pbf  # registers a data source, so only where it is asked for

        return selected(network(pbf.elements(spark, path), strict))
    raise MapDataError(f"{path}: .json, .jsonl or .pbf is expected")


def selected(net: Network) -> Network:
    """The roads of a network with all that they depend on, its turn restrictions, and its areas as flags of the nodes."""
    ways = net.ways.filter(way_ok())
    used = ways.select(F.explode("nodes").alias("id")).distinct()
    land = net.ways.filter(F.col("tags")["landuse"].isin("residential", "military"))
    lands = net.relations.filter(F.col("tags")["landuse"].isin("residential", "military"))
    member = lands.select(F.explode("members").alias("m")).filter("m.type = 'way'").select(F.col("m.ref").alias("id")).distinct()
    edges = land.unionByName(net.ways.join(member, "id", "left_semi")).dropDuplicates(["id"])
    corners = net.nodes.join(edges.select(F.explode("nodes").alias("id")).distinct(), "id", "left_semi")
    nodes = net.nodes.join(used, "id", "left_semi")
    homes, bans = (areas.polygons(areas.area_members(edges, lands, corners, use)) for use in ("residential", "military"))
    return Network(areas.flagged(nodes, homes, bans), ways, net.relations.filter(relation_ok()))
