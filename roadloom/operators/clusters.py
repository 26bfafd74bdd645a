"""Clustering of routes and itineraries by where they go, and picking from clusters.

HDBSCAN in numpy, for the rows of one request: mutual reachability distances, their minimum spanning tree, the condensed
hierarchy, and the most stable clusters. Labels tell a request's rows apart and mean nothing else; -1 is noise. Distances are
computed a row at a time, so memory is linear in a request's rows, and time quadratic; requests are clustered side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROUTE_EPSILON, ITINERARY_EPSILON = 0.1, 0.01


def spanning_tree(points: np.ndarray, neighbours: int) -> np.ndarray:
    """(distance, a, b) of a minimum spanning tree over mutual reachability, in ascending order."""
    n = len(points)
    nth = min(neighbours, n) - 1

    def away(k: int) -> np.ndarray:
        return np.sqrt(((points - points[k]) ** 2).sum(axis=1))

    core = np.array([np.partition(away(k), nth)[nth] for k in range(n)])
    low, via, todo, out, now = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), [], 0
    for _ in range(n - 1):
        todo[now] = False
        reach = np.maximum(away(now), np.maximum(core[now], core))
        near = todo & (reach < low)
        low[near], via[near] = reach[near], now
        now = int(np.argmin(np.where(todo, low, np.inf)))
        out.append((low[now], via[now], now))
    return np.array(sorted(out)).reshape(-1, 3)


def hdbscan(points: np.ndarray, min_size: int = 2, epsilon: float = 0.0) -> np.ndarray:
    """Labels of points. Clusters that part below ``epsilon`` are kept together."""
    points = np.asarray(points, float)
    n = len(points)
    labels = np.full(n, -1)
    if n < min_size or n < 2:
        return labels
    # Dendrogram: node n + k joins two nodes at a height.
    size: list[int] = [1] * n
    kids: dict[int, tuple[int, int]] = {}
    height = [0.0] * n
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    owner = list(range(n))
    for dist, a, b in spanning_tree(points, min_size):
        x, y = top(int(a)), top(int(b))
        node = len(size)
        kids[node] = (owner[x], owner[y])
        size.append(size[owner[x]] + size[owner[y]])
        height.append(float(dist))
        root[y], owner[x] = x, node
    # Condensed clusters, from the root down: (born at, members that leave, children).
    def leaves(x: int) -> list[int]:
        out, below = [], [x]
        while below:
            y = below.pop()
            out += [y] if y < n else []
            below += kids.get(y, ())[::-1]
        return out

    clusters: list[dict] = []
    born = [(2 * n - 2, 0.0, -1)]
    while born:
        node, birth, above = born.pop()
        me = {"kids": [], "stable": 0.0, "points": leaves(node), "split": 0.0}
        if above >= 0:
            clusters[above]["kids"].append(len(clusters))
        clusters.append(me)
        while True:
            at = 1 / max(height[node], 1e-12)
            parts = [k for k in kids.get(node, ()) if size[k] >= min_size]
            if len(parts) == 2:
                me["stable"] += size[node] * (at - birth)
                me["split"] = height[node]
                born += [(k, at, len(clusters) - 1) for k in reversed(parts)]
                break
            me["stable"] += (size[node] - sum(size[k] for k in parts)) * (at - birth)
            if not parts:
                break
            node = parts[0]
    chosen = [not c["kids"] for c in clusters]
    for k in range(len(clusters) - 1, -1, -1):
        c = clusters[k]
        if c["kids"]:
            below = sum(clusters[j]["stable"] for j in c["kids"])
            whole = k > 0 and (c["stable"] >= below or c["split"] < epsilon)
            chosen[k] = whole
            c["stable"] = max(c["stable"], below) if not whole else c["stable"] if c["stable"] >= below else below
    if epsilon and clusters[0]["kids"] and clusters[0]["split"] < epsilon:
        chosen[0] = True
    if len(clusters) == 1:
        chosen[0] = height[2 * n - 2] < epsilon
    at, todo = 0, [0]
    while todo:
        k = todo.pop()
        if chosen[k]:
            labels[clusters[k]["points"]] = at
            at += 1
        else:
            todo += clusters[k]["kids"]
    return labels


def labelled(rows: DataFrame, key: str, vector: str, epsilon: float, by: str | None = None) -> DataFrame:
    """(key, label) of rows whose vectors are complete; those with a missing or NaN coordinate are noise. by: the column that
    tells requests apart, which are clustered each for itself; without it, all rows are one request's."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        points = [np.array(v, float) for v in frame[vector]]
        width = max((len(p) for p in points), default=0)
        ok = np.array([len(p) == width and np.isfinite(p).all() for p in points], bool)
        labels = np.full(len(frame), -1)
        if ok.any():
            labels[ok] = hdbscan(np.stack([p for p, good in zip(points, ok, strict=True) if good]), 2, epsilon)
        return pd.DataFrame({key: frame[key], "label": labels})

    return rows.select(key, vector, *([by] if by else [])).groupBy(*([by] if by else [])).applyInPandas(work, f"{key} {rows.schema[key].dataType.simpleString()}, label int")


def best_of_clusters(scored: DataFrame) -> DataFrame:
    """The best row of each cluster. scored: (route_id, label, score, ...); ties go to the first route_id."""
    best = Window.partitionBy("label").orderBy(F.desc("score"), "route_id")
    return scored.filter("label >= 0").withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")


def best_of_noise(scored: DataFrame, clusters: int) -> DataFrame:
    """The best rows outside clusters: three if there are more than ten clusters, else ten."""
    return scored.filter("label < 0").orderBy(F.desc("score"), "route_id").limit(3 if clusters > 10 else 10)


def picked(scored: DataFrame) -> DataFrame:
    best = best_of_clusters(scored)
    return best.unionByName(best_of_noise(scored, best.count()))


def deduped(itineraries: DataFrame, labels: DataFrame) -> DataFrame:
    """One itinerary of each cluster (the last by id), all noise, and all direct ones, which aren't clustered."""
    each = itineraries.join(labels, "itin_id", "left")
    alone = F.coalesce(F.col("label"), F.lit(-1)) < 0
    last = Window.partitionBy("label").orderBy(F.desc("itin_id"))
    some = each.filter(~alone).withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "label")
    return some.unionByName(each.filter(alone).drop("label"))
