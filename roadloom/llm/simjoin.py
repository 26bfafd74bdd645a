"""Links between sets of word shingles with a Jaccard similarity of 0.75 or more, by R-trees over count vectors.

Texts come in groups that share something (a rare shingle, a band of a MinHash); any two similar ones share a group. Each text
is tied to the least of each of its groups (a star), and the components of these ties are the clusters: similar texts are in
one cluster. A cluster's texts meet in one task, with their sets:

1. Shingles are hashed into groups, and the groups' counts are a text's point in an R-tree.
2. For a text, the tree gives those whose overlap, bounded by the sum of the coordinates' minima, could suffice.
3. These are verified on the sets, best bound first, and only as long as they aren't connected yet.

A task returns links to the least text of each component that it finds, never all pairs. Clusters over a block's size are dealt to blocks by hash,
twice, and each block is linked within itself. What is in the largest component by then needs no comparison within it; the
rest of the cluster meets all blocks, two blocks a task, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.components import components, starred
from roadloom.llm.scratch import Scratch
from roadloom.llm.textops import freed, shingle_sets, word_hashes, words

#: Texts and shingles of a block; points of a leaf.
BLOCK, BLOCK_SHINGLES, LEAF = 1024, 1 << 22, 16
#: Groups that shingles are hashed into, and the set sizes from which on there are four times as many: a bound over few groups tells large sets apart badly.
GROUPS, TIERS = 64, (384, 1536, 6144)
#: Rows that ``small`` broadcasts at most, of some 30 bytes each.
BROADCAST_ROWS = 300_000
NONE = np.zeros((2, 0), np.int64)


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, and how many each has."""
    flat_words, counts = words(column)
    return shingle_sets(word_hashes(flat_words), counts)


def split(hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The set of each text, as bytes."""
    ends = np.cumsum(n)
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return [raw[8 * a : 8 * b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def node_ids(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set. Two of D different sets share one with odds of D * D / 2^65."""
    ends = np.cumsum(n)
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)), np.uint64, len(n)).view(np.int64)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of sizes a and b for 100 * overlap >= 75 * union."""
    return (3 * (a + b) + 6) // 7


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def points(members: list[np.ndarray], groups: int) -> np.ndarray:
    """The count vector of each set."""
    shift = np.uint64(64 - groups.bit_length() + 1)
    return np.stack([np.bincount((h >> shift).astype(np.int64), minlength=groups) for h in members]).astype(np.int32)


class Tree:
    """An R-tree of two levels over count vectors: leaves of LEAF points, packed in order of size, then of the vectors."""

    def __init__(self, n: np.ndarray, counts: np.ndarray):
        self.n = n
        self.points = counts
        band = np.searchsorted(np.unique(n)[:: max(1, len(np.unique(n)) // 16)], n, side="right")
        self.order = np.lexsort((counts[:, 2], counts[:, 1], counts[:, 0], band))
        cut = np.arange(0, len(n), LEAF)
        self.high = np.maximum.reduceat(counts[self.order], cut, axis=0)
        self.least, self.most = np.minimum.reduceat(n[self.order], cut), np.maximum.reduceat(n[self.order], cut)

    def near(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that could overlap enough with one of ``size`` shingles, and the bounds on their overlap."""
        leaves = np.flatnonzero((4 * self.most >= 3 * size) & (3 * self.least <= 4 * size))
        bound = np.minimum(self.high[leaves], point).sum(axis=1)
        leaves = leaves[bound >= needed(np.maximum(self.least[leaves], -(-3 * size // 4)), size)]
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = self.order[at[at < len(self.n)]]
        bound = np.minimum(self.points[rows], point).sum(axis=1)
        ok = bound >= needed(self.n[rows], size)
        return rows[ok], bound[ok]


def forest(node: np.ndarray, root: np.ndarray, n: np.ndarray, members: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """Links, of each text to the least, that connect what similar pairs of the texts connect, besides what has a root in common already. side: 0 or 1, if
    only texts of different sides are to be compared or in different components; all alike if any may be."""
    _, part = np.unique(root, return_inverse=True)
    if len(node) < 2 or part.max() == 0:
        return NONE
    ask, there = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(node)),) * 2
    if not len(there):
        return NONE
    groups = GROUPS << 2 * int(np.searchsorted(TIERS, np.median(n), side="right"))
    counts = points(members, groups)
    tree = Tree(n[there], counts[there])
    out = []
    for i in ask[np.argsort(n[ask], kind="stable")].tolist():
        rows, bound = tree.near(counts[i], int(n[i]))
        rows = there[rows]
        like = bound / (n[i] + n[rows] - bound)
        rows = rows[np.argsort(-like, kind="stable")]
        while len(rows := rows[part[rows] != part[i]]):
            j, rows = int(rows[0]), rows[1:]
            if similar(members[i], members[j]):
                out.append((node[i], node[j]))
                part[part == part[j]] = part[i]
    return np.stack(starred(*np.array(out).T)) if out else NONE


def linked(rows: DataFrame) -> DataFrame:
    """Links (a, b) in each (grp, lo, hi). rows: (grp, lo, hi, block, node, root, n, hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            grp, lo, hi, block, node, root, n = (t.column(k).to_numpy().astype(np.int64) for k in range(7))
            raw = t.column(7).to_pylist()
            start = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
            found = [NONE]
            for p, q in zip(start.tolist(), [*start[1:].tolist(), len(node)], strict=True):
                side = ((block[p:q] == hi[p]) & (lo[p] != hi[p])).astype(np.int8)
                found.append(forest(node[p:q], root[p:q], n[p:q], [np.frombuffer(x, np.uint64) for x in raw[p:q]], side))
            a, b = np.concatenate(found, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for x in batches:
            if not x.num_rows:
                continue
            keys = [x.column(k).to_numpy() for k in range(3)]
            turn = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if held and any(held[-1].column(k)[-1].as_py() != x.column(k)[0].as_py() for k in range(3)):
                yield done(pa.Table.from_batches(held))
                held = []
            if len(turn):
                cut = int(turn[-1]) + 1
                yield done(pa.Table.from_batches([*held, x.slice(0, cut)]))
                held, x = [], x.slice(cut)
            held.append(x)
        if held:
            yield done(pa.Table.from_batches(held))

    key = ["grp", "lo", "hi"]
    rows = rows.select(*key, "block", "node", "root", "n", "hashes")
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(freed(work), "a bigint, b bigint")


def small(rows: DataFrame, lists: str | None = None) -> DataFrame:
    """rows, to be broadcast if there are BROADCAST_ROWS at most (and as many elements of their ``lists``), else to be joined as
    Spark chooses."""
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few and lists:
        few = (rows.agg(F.sum(F.size(lists))).first()[0] or 0) <= BROADCAST_ROWS
    return F.broadcast(rows) if few else rows


def stars(postings: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(a, b): each text with the least of each of its groups, once. postings: (grp, node)."""
    least = scratch.table(postings.groupBy("grp").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last").select("grp", "b"), f"{name}-least")
    edges = scratch.table(postings.join(small(least), "grp").filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), name)
    scratch.remove(f"{name}-least")
    return edges


def link(scratch: Scratch, edges: DataFrame, of: DataFrame) -> DataFrame:
    """Links (a, b) that connect all texts which similar pairs within a cluster connect, written to tables.

    edges: (a, b), whose components are the clusters; of: (node, n, hashes), a row for each text in edges at least.
    """
    roots = components(edges, scratch, "clusters")
    clusters = roots.select("node", F.col("root").alias("grp")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("grp")).distinct())
    slim = scratch.table(of.select("node", "n").join(small(scratch.table(clusters, "of-clusters")), "node"), "in-clusters")
    enough = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = scratch.table(slim.groupBy("grp").agg(enough.alias("blocks")).filter("blocks > 1"), "large")
    dealt = slim.join(small(large), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = scratch.table(of.join(dealt.select("node", "grp", "blocks"), "node"), "members")
    scratch.settle()

    def in_blocks(rows: DataFrame, turn: int) -> DataFrame:
        block = F.pmod(F.xxhash64("node", F.lit(turn)), "blocks").cast("int")
        rows = rows.withColumn("block", block)
        return scratch.table(linked(rows.withColumn("lo", F.col("block")).withColumn("hi", F.col("block"))), f"links-{turn}")

    links = in_blocks(members.withColumn("root", F.col("node")), 0)
    if large.isEmpty():
        return links
    big = members.filter("blocks > 1")

    def rooted(turn: int) -> DataFrame:
        return big.join(components(links, scratch, f"roots-{turn}"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    links = links.unionByName(in_blocks(rooted(1), 1))
    now = scratch.table(rooted(2), "big")
    main = now.groupBy("grp", "root").agg(F.count("*").alias("m"), F.sum("n").alias("size")).groupBy("grp")
    main = main.agg(F.max(F.struct("m", "size", "root")).alias("main"), F.sum("m").alias("all"), F.sum("size").alias("size")).filter("all > main.m")

    def parts(count: str, size: str) -> F.Column:
        return F.greatest(F.ceil(F.expr(count) / BLOCK), F.ceil(F.expr(size) / BLOCK_SHINGLES)).cast("int")

    main = main.select("grp", F.col("main.root").alias("main"), parts("all - main.m", "size - main.size").alias("few"), parts("main.m", "main.size").alias("many"))
    now = now.join(small(scratch.table(main, "main")), "grp").withColumn("rest", F.col("root") != F.col("main"))
    at = F.xxhash64("node", F.lit(2))
    now = now.withColumn("block", F.when(F.col("rest"), F.pmod(at, "few")).otherwise(F.col("few") + F.pmod(at, "many")).cast("int"))
    now = now.withColumn("to", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
    now = now.withColumn("lo", F.least("block", "to")).withColumn("hi", F.greatest("block", "to"))
    return links.unionByName(scratch.table(linked(now), "links-2"))
