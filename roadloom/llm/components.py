"""Connected components of a graph of links, by alternating large and small stars.

Each task first makes a star around the least node of what its own links connect. Then every node hooks its greater
neighbours to the least node of its neighbourhood, then its lesser ones, until nothing changes; each component is then a
star around its least node. A graph of ONE_TASK links at most is one task's work from the start. Minima are pre-aggregated before the shuffle and written to
a table, so that the join back on a node of very many links is one whose skewed partitions Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.scratch import Scratch
from roadloom.llm.textops import freed


#: Links that one task may hold, of 16 bytes each.
ONE_TASK = 1 << 20


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def starred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): of every node in links (a, b) that isn't the least of what they connect it to, that least."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        for z in (label[x], label[y]):
            np.minimum.at(label, z, low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _shortened(edges: DataFrame) -> DataFrame:
    """Links that connect what edges (u, v) connect: a star for each component of a task's edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy() for k in (0, 1)])
            rows += b.num_rows
            if rows >= 1 << 21:
                held, rows = [starred(*map(np.concatenate, zip(*held, strict=True)))], 0
        if held:
            u, v = starred(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(freed(work), "u bigint, v bigint")


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root): of every node in links (a, b) that isn't its component's least, the least. Null ends are no links."""
    # An edge (u, v) has v < u.
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = scratch.table(_shortened(scratch.table(edges, f"{name}-links")).distinct(), f"{name}-0")
    scratch.remove(f"{name}-links")
    before, turn = _mark(edges), 0
    if before[0] <= ONE_TASK:
        whole = scratch.table(_shortened(edges.coalesce(1)), f"{name}-1")
        scratch.remove(f"{name}-0")
        return whole.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while before[0]:
        turn += 1
        near = edges.groupBy("u").agg(F.min("v").alias("m"))  # a node's least neighbour is less than itself, or it has none less
        low = scratch.table(near, f"{name}-{turn}-low")
        # Large star: neighbours above v hook to the least of v's neighbourhood, v's own if it has none less.
        large = edges.join(low.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = scratch.table(large, f"{name}-{turn}-large")
        # Small star: what a node is hooked to hooks to the least of it.
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{turn}-least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.table(small, f"{name}-{turn}")
        for old in (f"{name}-{turn - 1}", f"{name}-{turn}-low", f"{name}-{turn}-large", f"{name}-{turn}-least"):
            scratch.remove(old)
        edges, now = after, _mark(after)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
