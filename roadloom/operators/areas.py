"""Areas: rings stitched from ways, polygons with holes, the cells they touch, and what nodes are near.

Rings and polygons are plain Python, one area a group; finding the areas around a node is a join by cell. A polygon is
(outer, holes), each a closed ring of (lat, lon).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import EARTH_M, cell, polygon_area, wrap

Ring = list[tuple[float, float]]
POLYGONS = "area_id long, part int, outer array<struct<lat: double, lon: double>>, holes array<array<struct<lat: double, lon: double>>>, area_m2 double"
#: A node is residential if the polygons within NEAR_M make up a tenth of a circle of that radius; nogo if it lies deeper
#: than DEEP_M inside a polygon.
NEAR_M, DEEP_M = 500.0, 100.0
RESIDENTIAL_M2 = math.pi * NEAR_M**2 * 0.10


def stitched(ways: list[list[int]]) -> list[list[int]]:
    """Closed rings of node ids, made by joining ways end to end, turned round where needed. What doesn't close is left out."""
    todo = [list(w) for w in ways if w]
    out = []
    while todo:
        now = todo.pop(0)
        while now[0] != now[-1] or len(now) == 1:
            k = next((k for k, w in enumerate(todo) if now[-1] in (w[0], w[-1])), None)
            if k is None:
                break
            more = todo.pop(k)
            now += (more if more[0] == now[-1] else more[::-1])[1:]
        if len(now) > 3 and now[0] == now[-1]:
            out.append(now)
    return out


def inside(ring: Ring, lat: float, lon: float) -> bool:
    """Whether a point is in a ring, by crossings of a ray."""
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def polygons(members: DataFrame) -> DataFrame:
    """Polygons of areas, from (area_id, role, ord, points: the way's (id, lat, lon) in order). Inner rings go to the outer
    one that holds their first point; one in none is dropped."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        at: dict[int, tuple[float, float]] = {}
        ways: dict[str, list[list[int]]] = {"outer": [], "inner": []}
        for row in frame.sort_values("ord").itertuples():
            at |= {p["id"]: (p["lat"], p["lon"]) for p in row.points}
            ways["inner" if row.role == "inner" else "outer"].append([p["id"] for p in row.points])
        outers, inners = ([[at[i] for i in ring] for ring in stitched(ways[role])] for role in ("outer", "inner"))
        holes: list[list[Ring]] = [[] for _ in outers]
        for ring in inners:
            home = next((k for k, o in enumerate(outers) if inside(o, *ring[0])), None)
            if home is not None:
                holes[home].append(ring)
        point = lambda p: {"lat": p[0], "lon": p[1]}
        rows = [(frame.area_id.iloc[0], k, [point(p) for p in o], [[point(p) for p in h] for h in holes[k]], polygon_area(o[:-1]) - sum(polygon_area(h[:-1]) for h in holes[k])) for k, o in enumerate(outers)]
        return pd.DataFrame(rows, columns=["area_id", "part", "outer", "holes", "area_m2"])

    return members.groupBy("area_id").applyInPandas(work, POLYGONS)


def area_members(ways: DataFrame, relations: DataFrame, nodes: DataFrame, landuse: str) -> DataFrame:
    """What polygons() takes, of the closed ways and the relations with a landuse. Areas of ways have their ids negated."""
    own = ways.filter(F.col("tags")["landuse"] == landuse).select((-F.col("id")).alias("area_id"), F.lit("outer").alias("role"), F.lit(0).alias("ord"), "nodes")
    parts = relations.filter(F.col("tags")["landuse"] == landuse).select(F.col("id").alias("area_id"), F.posexplode("members").alias("ord", "m"))
    parts = parts.filter("m.type = 'way'").join(ways.select(F.col("id").alias("way_id"), "nodes"), F.col("m.ref") == F.col("way_id")).select("area_id", F.col("m.role").alias("role"), "ord", "nodes")
    each = own.unionByName(parts).select("area_id", "role", "ord", F.posexplode("nodes").alias("pos", "id"))
    each = each.join(nodes.select("id", "lat", "lon"), "id")
    return each.groupBy("area_id", "role", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "lat", "lon"))), lambda p: F.struct(p["id"].alias("id"), p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("points"))


def cells(found: DataFrame) -> DataFrame:
    """(area_id, part, cell_lat, cell_lon): every cell that a polygon's box reaches, once."""
    ends = (("lo", F.array_min), ("hi", F.array_max))
    box = found.select("area_id", "part", *(cell(f(F.col("outer").getField(c))).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in ends))
    rows = box.withColumn("cell_lat", F.explode(F.sequence("lo_lat", "hi_lat"))).withColumn("cell_lon", F.explode(F.sequence("lo_lon", "hi_lon")))
    return rows.select("area_id", "part", "cell_lat", "cell_lon")


def placed(lat: np.ndarray, lon: np.ndarray, rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point, whether it is in the polygon beside it (its outer ring, then its holes), and how many metres from the
    nearest edge, on a plane around the point."""
    of_row = np.repeat(np.arange(len(lat)), np.diff(rings.offsets.to_numpy()))
    each = rings.flatten()
    n = np.diff(each.offsets.to_numpy())
    flat = each.flatten()
    y, x = (flat.field(c).to_numpy() for c in ("lat", "lon"))
    end = np.cumsum(n)
    begin = end - n
    after = np.arange(1, len(y) + 1)
    after[end - 1] = begin  # a ring's last point leads to its first
    row = np.repeat(of_row, n)
    dy, dx = y - lat[row], x - lon[row]
    over = dy > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = (over != over[after]) & ((dx[after] - dx) * -dy / (dy[after] - dy) + dx > 0)
    odd = np.add.reduceat(cross.astype(np.int64), begin) % 2 == 1
    outer = np.concatenate(([True], of_row[1:] != of_row[:-1]))
    bad = np.bincount(of_row, np.where(outer, ~odd, odd), minlength=len(lat))
    dx = dx * np.cos(np.radians(lat))[row]
    ex, ey = dx[after] - dx, dy[after] - dy
    size = ex * ex + ey * ey
    t = np.clip(-(dx * ex + dy * ey) / np.where(size == 0, 1, size), 0, 1)
    away = np.full(len(lat), np.inf)
    np.minimum.at(away, row, np.hypot(dx + t * ex, dy + t * ey))
    return bad == 0, np.radians(away) * EARTH_M


def near_areas(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, area_id, part, area_m2, inside, edge_m): nodes and the polygons of the cells around them, as far as NEAR_M reaches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                inside_, edge = placed(*(b.column(k).to_numpy(zero_copy_only=False) for k in (4, 5)), b.column(6))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(inside_), pa.array(edge)], ["id", "area_id", "part", "area_m2", "inside", "edge_m"])

    # Cells get narrower towards the poles.
    wide = F.ceil(NEAR_M / (math.radians(0.01) * EARTH_M) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))).cast("int")
    around = nodes.select("id", "lat", "lon", F.least(wide, F.lit(18000)).alias("wide")).withColumn("i", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    around = around.withColumn("j", F.explode(F.sequence(-F.col("wide"), "wide")))
    around = around.select("id", "lat", "lon", wrap(cell(F.col("lat")) + F.col("i"), 9000).alias("cell_lat"), wrap(cell(F.col("lon")) + F.col("j"), 18000).alias("cell_lon"))
    pairs = around.join(cells(found), ["cell_lat", "cell_lon"]).select("id", "lat", "lon", "area_id", "part").distinct()
    rows = pairs.join(found, ["area_id", "part"]).select(F.col("id").cast("bigint"), F.col("area_id").cast("bigint"), F.col("part").cast("int"), F.col("area_m2").cast("double"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.concat(F.array("outer"), "holes"))
    return rows.mapInArrow(work, "id bigint, area_id bigint, part int, area_m2 double, inside boolean, edge_m double")


def flagged(nodes: DataFrame, residential: DataFrame, military: DataFrame) -> DataFrame:
    """nodes with residential and nogo set by the polygons around them; each polygon counts once."""
    homes = near_areas(nodes, residential).filter(F.col("inside") | (F.col("edge_m") <= NEAR_M)).groupBy("id").agg(F.sum("area_m2").alias("homes"))
    bans = near_areas(nodes, military).filter(F.col("inside") & (F.col("edge_m") > DEEP_M)).select("id").distinct().withColumn("ban", F.lit(True))
    both = nodes.drop("residential", "nogo").join(homes, "id", "left").join(bans, "id", "left")
    return both.withColumn("residential", F.coalesce(F.col("homes") > RESIDENTIAL_M2, F.lit(False))).withColumn("nogo", F.coalesce("ban", F.lit(False))).drop("homes", "ban")

