"""N-gram Jaccard join of whole texts: five-word shingles, similarity 0.75 or more, exact.

A count-vector R-tree over a whole corpus can't keep a search below all pairs: in 64 or more dimensions its boxes overlap. So
texts are put into clusters that no similar pair crosses, and each cluster has its R-tree; see ``simjoin``. The clusters:

1. A text that is similar to another lacks a quarter of its shingles at most in that one. So texts of which too many shingles
   are in no other text drop out. Half of all shingles (chosen by a bit of their hash) are enough for a first count, by
   packed postings; see ``ranges``.
2. What stays (one text in ten, in prose) is counted in full, as joins and sums over the shingles' hashes.
3. In one order of all shingles, the rarest first, similar sets have one in common among the first |A| - ceil(3|A| / 4) + 1
   of each. Texts with such a shingle in common are tied, and ties make the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm import simjoin
from roadloom.llm.components import components
from roadloom.llm.ranges import Postings, counted, enough
from roadloom.llm.scratch import Scratch
from roadloom.llm.simjoin import node_ids, sets
from roadloom.llm.textops import OWNER_BITS, chunks, freed

HASH_BITS = 64 - OWNER_BITS


def halved(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are in the chosen half, and their numbers of HASH_BITS - 1 bits."""
    x = hashes >> np.uint64(OWNER_BITS)
    chosen = (x & np.uint64(1)) == 0
    return chosen, x[chosen] >> np.uint64(1)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, n, half) of every text: its set's name and size, and how many shingles are in the chosen half."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in chunks(b.column(2)):
                h, n = sets(part)
                half = np.bincount(np.repeat(np.arange(len(n)), n)[halved(h)[0]], minlength=len(n))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(n)) for k in (0, 1)), pa.array(node_ids(h, n)), pa.array(n), pa.array(half)], names)

    names = ["doc_id", "mark", "node", "n", "half"]
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(freed(work), "doc_id bigint, mark bigint, node bigint, n bigint, half bigint")


def shared(docs: DataFrame, ranges: int) -> DataFrame:
    """(node, c): of how many shingles of the chosen half it is known that another text has them too; never too few."""

    def postings(b: pa.RecordBatch) -> Iterator[Postings]:
        for _, part in chunks(b.column(0)):
            h, n = sets(part)
            chosen, x = halved(h)
            owner = np.repeat(node_ids(h, n), n)[chosen]
            yield x, owner, np.zeros(len(x), np.int32)

    return counted(docs.select("text"), postings, ranges, ("node", "c"), HASH_BITS - 1).groupBy("node").agg(F.sum("c").alias("c"))


def set_table(texts: DataFrame) -> DataFrame:
    """(node, n, hashes) from (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in chunks(b.column(1)):
                h, n = sets(part)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n), pa.array(simjoin.split(h, n), pa.binary())], ["node", "n", "hashes"])

    return texts.select("node", "text").mapInArrow(freed(work), "node bigint, n bigint, hashes binary")


def each_shingle(of: DataFrame) -> DataFrame:
    """(grp: a shingle, node, n) from (node, n, hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in chunks(b.column(2)):
                n = b.column(1).slice(at, len(part)).to_numpy()
                h = np.frombuffer(b"".join(part.to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(b.column(0).slice(at, len(part)).to_numpy(), n)), pa.array(np.repeat(n, n).astype(np.int32))], ["grp", "node", "n"])

    return of.select("node", "n", "hashes").mapInArrow(freed(work), "grp bigint, node bigint, n int")


def prefixes(of: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, node): the shingles of each set's prefix that another one has; the rarest come first."""
    every = each_shingle(of)
    many = scratch.table(every.groupBy("grp").agg(F.count("*").alias("texts")).filter("texts > 1"), "frequency")
    known = every.join(many, "grp")
    alone = Window.partitionBy("node")
    # Shingles that no other set has come before all others, and take up their part of the prefix.
    place = F.row_number().over(alone.orderBy("texts", "grp")) + F.col("n") - F.count("*").over(alone)
    out = known.withColumn("place", place).filter(F.col("place") <= F.floor(F.col("n") / 4) + 1)
    return scratch.table(out.select("grp", "node"), "prefixes")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node, n_shingles, component_id, root): component_id is the least doc_id reachable by links, its own
    included; root names the component (null: no words), mark the text.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of one to four words is one shingle; a text
    without words, or null, has none and is linked with nothing. Rows that repeat a doc_id are texts each; a row without
    doc_id links like others but never names a component (null if there is none else). An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", "text")
    rows = scratch.table(signatures(docs), "signatures")
    info = scratch.table(rows.filter("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.first("n").alias("n"), F.first("half").alias("half")), "info")
    total = rows.agg(F.sum("half")).first()[0] or 0
    counts = scratch.table(shared(docs, enough(total)), "shared")
    scratch.settle()
    # Of a set of n shingles, floor(n / 4) at most may be missing in a similar one.
    alive = info.join(counts, "node", "left").filter(F.col("half") - F.coalesce("c", F.lit(0)) <= F.floor(F.col("n") / 4))
    wanted = simjoin.small(scratch.table(alive.select("node", F.col("at.doc_id").alias("id"), F.col("at.mark").alias("m")), "alive"))
    there = docs.withColumn("mark", F.xxhash64("text"))
    texts = there.join(wanted, (there.mark == wanted.m) & there.doc_id.eqNullSafe(wanted.id)).groupBy("node").agg(F.first("text").alias("text"))
    of = scratch.table(set_table(texts), "sets")
    scratch.settle()
    edges = simjoin.stars(prefixes(of, scratch), scratch)
    scratch.settle()
    roots = components(simjoin.link(scratch, edges, of), scratch)
    slim = rows.select("doc_id", "mark", "node", F.col("n").alias("n_shingles"))
    linked = scratch.table(slim.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "linked")
    least = scratch.table(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.table(linked.join(least, "root").select("node", "component_id", "root"), "named")
    scratch.only("signatures", "named")
    # A text without words is a component of its own: its rows join with nothing.
    both = slim.join(named, (slim.node == named.node) & (slim.n_shingles > 0), "left")
    return both.select("doc_id", "mark", slim.node, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the least doc_id (null last), the first by a hash of its text if
    several rows share it. Documents without words are linked with nothing and stay."""
    scratch = Scratch(docs.sparkSession, "representatives")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    first = join(docs).filter("n_shingles > 0").groupBy("root").agg(F.min(order).alias("keep"))
    kept = scratch.table(first.select(F.col("keep.doc_id").alias("kept_id"), F.col("keep.mark").alias("kept_mark")), "kept")
    said = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    spoken = docs.filter(said).withColumn("mark_of_text", F.xxhash64("text"))
    chosen = spoken.join(kept, (F.col("mark_of_text") == F.col("kept_mark")) & F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return chosen.dropDuplicates(["doc_id", "mark_of_text"]).drop("mark_of_text").unionByName(docs.filter(~said))
