"""The road graph: lines between consecutive nodes of usable ways, what meets at each node, and which turns are legal.

A line's number is way * WAY_STEP + its place in the way, so that lines have a total order (the order of ways, then along
each way) without a global sort. A way of more lines than that fails the query that meets it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions import tags as T
from roadloom.functions.geo import bearing, haversine

WAY_STEP = 1 << 20


def roads(ways: DataFrame) -> DataFrame:
    """(way_id, nodes, direction, name, ref, highway, surface, smoothness) of the ways that can be used."""
    return ways.filter(T.way_ok()).select(F.col("id").alias("way_id"), "nodes", T.direction().alias("direction"), *T.kept())


def lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(line, way_id, seq, p0, p1, direction, name, ref, highway, surface, smoothness): each two consecutive nodes of a road.

    A way that names a node which isn't there keeps the lines before it, and none after.
    """
    named = roads(ways)
    pairs = F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("p0"), F.slice("nodes", F.lit(2), F.size("nodes") - 1).alias("p1"))
    each = named.filter(F.size("nodes") > 1).select("way_id", F.posexplode(pairs), "direction", *T.KEPT)
    place = F.when(F.col("pos") < WAY_STEP, F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("too many nodes in way "), "way_id")).cast("int"))
    each = each.select((F.col("way_id") * WAY_STEP + place).alias("line"), "way_id", F.col("pos").alias("seq"), "col.p0", "col.p1", "direction", *T.KEPT)
    gaps = first_gaps(named, nodes)
    return each.join(gaps, "way_id", "left").filter(F.col("gap").isNull() | (F.col("seq") + 1 < F.col("gap"))).drop("gap")


def first_gaps(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, gap): the place of the first node that a way names but isn't there; only such ways. These ways count as
    broken, and turn restrictions don't find them."""
    points = named.select("way_id", F.posexplode("nodes").alias("pos", "node"))
    return points.join(nodes.select(F.col("id").alias("node")), "node", "left_anti").groupBy("way_id").agg(F.min("pos").alias("gap"))


def adjacency(lines_: DataFrame) -> DataFrame:
    """(node, line, other): each line from both its ends; a loop is there twice."""
    ends = F.array(F.struct(F.col("p0").alias("node"), F.col("p1").alias("other")), F.struct(F.col("p1").alias("node"), F.col("p0").alias("other")))
    return lines_.select("line", F.explode(ends).alias("e")).select("e.node", "line", "e.other")


def degrees(lines_: DataFrame) -> DataFrame:
    """(node, degree, junction): a junction is where more than two lines end."""
    return adjacency(lines_).groupBy("node").agg(F.count("*").alias("degree")).withColumn("junction", F.col("degree") > 2)


def directed(lines_: DataFrame) -> DataFrame:
    """(line, way_id, start, stop, direction): each line in the ways it may be driven."""
    both = F.when(F.col("direction") == "both", F.array(F.struct("p0", "p1"), F.struct(F.col("p1").alias("p0"), F.col("p0").alias("p1")))).otherwise(F.array(F.struct("p0", "p1")))
    return lines_.select("line", "way_id", "direction", F.explode(both).alias("e")).select("line", "way_id", F.col("e.p0").alias("start"), F.col("e.p1").alias("stop"), "direction")


def measured(lines_: DataFrame, nodes: DataFrame) -> DataFrame:
    """lines with the ends' coordinates, len_m and the bearing from p0 to p1."""
    at = nodes.select("id", "lat", "lon")
    out = lines_.join(at.toDF("p0", "lat0", "lon0"), "p0").join(at.toDF("p1", "lat1", "lon1"), "p1")
    place = [F.col(c) for c in ("lat0", "lon0", "lat1", "lon1")]
    return out.withColumn("len_m", haversine(*place)).withColumn("bearing", bearing(*place))


def parsed_relations(relations: DataFrame) -> DataFrame:
    """(rel_id, value, kind, via_count, problem, members) of turn restrictions; problem is null where they can be used."""
    vias = F.filter("members", lambda m: m["role"] == "via")
    found = relations.filter(T.relation_ok()).select(F.col("id").alias("rel_id"), T.restriction_value().alias("value"), vias.alias("vias"), "members")
    found = found.withColumn("kind", T.restriction_kind(F.col("value"))).withColumn("via_count", F.size("vias"))
    problem = F.when(F.col("kind").isNull(), "unknown restriction").when(F.col("via_count") == 0, "no via").when(F.col("via_count") > 1, "several vias").when(F.get("vias", 0)["type"] != "node", "via is no node")
    return found.withColumn("problem", problem)


def restrictions(relations: DataFrame, lines_: DataFrame, nodes: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """(rel_id, via, kind, from_lines, to_lines): each holds all lines of the relation's from and to ways.

    Restrictions without usable from or to ways, or whose via isn't there, are left out.
    """
    ok = parsed_relations(relations).filter("problem is null").withColumn("via", F.get("vias", 0)["ref"])
    ok = ok.join(nodes.select(F.col("id").alias("via")), "via", "left_semi")
    members = ok.select("rel_id", "via", "kind", F.explode("members").alias("m")).filter(F.col("m.role").isin("from", "to") & (F.col("m.type") == "way"))
    usable = lines_ if broken is None else lines_.join(broken, "way_id", "left_anti")
    joined = members.select("rel_id", "via", "kind", "m.role", F.col("m.ref").alias("way_id")).join(usable.select("way_id", "line"), "way_id")
    pick = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("line"))))
    both = joined.groupBy("rel_id", "via", "kind").agg(pick("from").alias("from_lines"), pick("to").alias("to_lines"))
    return both.filter((F.size("from_lines") > 0) & (F.size("to_lines") > 0))


def turn_pairs(found: DataFrame, kind: str) -> DataFrame:
    """(via, from_line, to_line) of the restrictions of a kind."""
    some = found.filter(F.col("kind") == kind)
    return some.select("via", F.explode("from_lines").alias("from_line"), "to_lines").select("via", "from_line", F.explode("to_lines").alias("to_line")).distinct()


def legal_turns(lines_: DataFrame, found: DataFrame) -> DataFrame:
    """(start, from_line, via, to_line, stop): what a driver may do after a line.

    Not back to where the line began; no turn that is forbidden; where some turns alone are allowed from a line, only those.
    """
    d = directed(lines_)
    # Restrictions go to the lines before these meet: there are far fewer lines than turns, and turns needn't move then.
    rules = found.select("via", F.struct("kind", "from_lines", "to_lines").alias("rule")).distinct().groupBy("via").agg(F.collect_list("rule").alias("rules"))
    about = lambda kind: F.filter("rules", lambda r: (r["kind"] == kind) & F.array_contains(r["from_lines"], F.col("from_line")))
    listed = lambda kind: F.flatten(F.transform(about(kind), lambda r: r["to_lines"]))
    into = d.select(F.col("line").alias("from_line"), "start", F.col("stop").alias("via")).join(rules, "via", "left")
    into = into.select("via", "from_line", "start", listed("not").alias("barred"), listed("only").alias("only"))
    out = d.select(F.col("line").alias("to_line"), F.col("start").alias("via"), "stop")
    turns = into.join(out, "via").filter(F.col("start") != F.col("stop"))
    open_ = ~F.array_contains("barred", F.col("to_line")) & ((F.size("only") == 0) | F.array_contains("only", F.col("to_line")))
    return turns.filter(F.col("barred").isNull() | open_).select("start", "from_line", "via", "to_line", "stop")


def start_turns(lines_: DataFrame, found: DataFrame) -> DataFrame:
    """(node, line, stop): what a driver may do who starts at a node. A line is out if a restriction forbids it together
    with all others there."""
    every = adjacency(lines_).groupBy("node").agg(F.collect_list("line").alias("here"))
    out = directed(lines_).select(F.col("start").alias("node"), "line", "stop")
    nots = found.filter("kind = 'not'").groupBy(F.col("via").alias("node")).agg(F.collect_list("to_lines").alias("nots"))
    both = out.join(every, "node").join(nots, "node", "left")
    others = F.filter("here", lambda x: x != F.col("line"))
    barred = F.exists("nots", lambda to: F.array_contains(to, F.col("line")) & F.forall(others, lambda x: F.array_contains(to, x)))
    return both.filter(~F.coalesce(barred, F.lit(False))).select("node", "line", "stop")


def roundabout_exits(lines_: DataFrame) -> DataFrame:
    """(entry, line, exit, steps): from each node on a roundabout, the lines that leave it, going around once at most; steps are
    the fewest lines on the roundabout before. Roundabouts may have any number of lines: the recursion's limits follow them."""
    spark = lines_.sparkSession
    d = directed(lines_)
    ring = d.filter("direction = 'roundabout'").select("start", "stop").distinct()
    leave = d.filter("direction <> 'roundabout'").select("start", "line", "stop")
    n = ring.count()
    limit = "spark.sql.cteRecursionRowLimit"
    if n * n > int(spark.conf.get(limit)) >= 0:
        spark.conf.set(limit, -1)
    return spark.sql(
        f"""
      WITH RECURSIVE around (entry, here, steps, seen) MAX RECURSION LEVEL {n + 1} AS (
        SELECT start, start, 0, array(start) FROM (SELECT DISTINCT start FROM {{ring}})
        UNION ALL
        SELECT a.entry, r.stop, a.steps + 1, array_append(a.seen, r.stop) FROM around a JOIN {{ring}} r ON a.here = r.start
        WHERE NOT array_contains(a.seen, r.stop)
      )
      SELECT a.entry, l.line, l.stop AS exit, min(a.steps) AS steps FROM around a JOIN {{leave}} l ON a.here = l.start GROUP BY a.entry, l.line, l.stop""",
        ring=ring,
        leave=leave,
    )
