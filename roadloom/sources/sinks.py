"""Where generated routes go: JSON responses, GPX, well-known text."""

from __future__ import annotations

import json
import sys
import xml.etree.ElementTree as ET
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.sources.rules import FAMILIES


def response_frame(routes: DataFrame, request_id: str = "default-request-id") -> DataFrame:
    """One row ``response``: the JSON of all routes (coords, len_m, junctions, families, score, label)."""
    stats = F.struct("len_m", F.col("junctions").alias("junction_count"), *FAMILIES, "score", F.col("label").alias("cluster"))
    each = F.struct(F.transform("coords", lambda p: F.array(p["lat"], p["lon"])).alias("coords"), stats.alias("stats"))
    by_name = lambda a, b: F.when(a["route_id"] < b["route_id"], -1).when(a["route_id"] > b["route_id"], 1).otherwise(0)
    listed = routes.agg(F.array_sort(F.collect_list(F.struct("route_id", each.alias("r"))), by_name).alias("all"))
    return listed.select(F.to_json(F.struct(F.lit(request_id).alias("id"), F.struct(F.struct(F.transform("all", lambda x: x["r"]).alias("routes")).alias("ok")).alias("result"))).alias("response"))


def error_response(message: str, request_id: str = "default-request-id") -> str:
    return json.dumps({"id": request_id, "result": {"error": {"message": message}}})


def describe(route: dict[str, Any]) -> str:
    """Lengths in words: the whole, then each family by length."""
    lines = [f"Length: {route['len_m'] / 1000:.2f}km", f"Score: {route['score'] or 0:.2f}"]
    for family in FAMILIES:
        lines.append(f"{family}:")
        lines += [f" - {v}: {s['len_m'] / 1000:.2f}km, {s['percentage'] or 0:.2f}%" for v, s in sorted((route[family] or {}).items(), key=lambda x: (-x[1]["len_m"], x[0]))]
    return "\n".join(lines)


def gpx(routes: list[dict[str, Any]]) -> str:
    """A GPX 1.1 document with a route element for each route."""
    root = ET.Element("gpx", {"version": "1.1", "creator": "roadloom", "xmlns": "http://www.topografix.com/GPX/1/1"})
    for k, r in enumerate(routes):
        rte = ET.SubElement(root, "rte")
        ET.SubElement(rte, "name").text = f"r_{k}_c_{r['label']}"
        ET.SubElement(rte, "desc").text = describe(r)
        for p in r["coords"]:
            ET.SubElement(rte, "rtept", {"lat": repr(p["lat"]), "lon": repr(p["lon"])})
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def write(routes: DataFrame, to: str | None, split: bool = False) -> None:
    """Write a generation's routes (a few dozen rows) to standard output, a .json or a .gpx file; split: a GPX file each."""
    if to is None or to.endswith(".json"):
        text = response_frame(routes).first()["response"]
        sys.stdout.write(text + "\n") if to is None else Path(to).write_text(text)
    elif to.endswith(".gpx"):
        rows = [r.asDict(recursive=True) for r in routes.orderBy("route_id").collect()]
        if split:
            for k, r in enumerate(rows):
                Path(f"{to.removesuffix('.gpx')}-{k}.gpx").write_text(gpx([r]))
        else:
            Path(to).write_text(gpx(rows))
    else:
        raise ValueError(f"{to}: .json or .gpx is expected")


def wkt_point(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def wkt_cell(cell_lat: Column, cell_lon: Column) -> Column:
    """The square of a grid cell."""
    corner = lambda i, j: F.concat(((cell_lon + i) / 100).cast("string"), F.lit(" "), ((cell_lat + j) / 100).cast("string"))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *(corner(i, j) for i, j in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)))), F.lit("))"))


def write_wkt(nodes: DataFrame, points: DataFrame, folder: str) -> None:
    """Nodes near residential areas, those that aren't, and the grid, as CSV of well-known text."""
    for name, keep in (("residential", F.col("residential")), ("not_residential", ~F.col("residential"))):
        nodes.filter(keep).select("id", wkt_point(F.col("lat"), F.col("lon")).alias("wkt")).write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    points.select("cell_lat", "cell_lon").distinct().select(wkt_cell(F.col("cell_lat"), F.col("cell_lon")).alias("wkt")).write.mode("overwrite").csv(f"{folder}/grid", header=True)
