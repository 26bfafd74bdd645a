"""Exact top-k search by inner product of integer vectors, by MaxScore over the postings of each shard.

A vector's components are its terms. A shard's postings list, for each term, the rows where it isn't zero. What a row can gain
from a query's term is bounded by the greatest product in the term's postings, or nothing if they are all below zero. With the
k-th best score so far as threshold, a query's terms of the least bounds, as many as can't reach the threshold even together,
are its non-essential ones. Rows that are in the postings of essential terms are scored by traversing these; the others can't
be among the k best. The non-essential terms are then probed one by one, the greatest bound first, only for rows that remain
competitive. Shards' results are merged by (score, vec_id).

Postings that hold more than half of a shard's rows are kept as whole columns.

Queries are shipped to the shards in blocks of at most QUERIES vectors, so that what is broadcast has a bound however
many queries there are; every block meets all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.scratch import Scratch

#: Most queries that are broadcast at once, and rows of a shard.
QUERIES, SHARD = 8192, 4096
#: Sums of products below this are exact in 64 bits; greater ones are added up as Python's integers.
EXACT = 1 << 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(embedding: str = "embedding") -> Column:
    """floor(256 * x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256))


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has only finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(embedding).isNotNull() & F.coalesce(finite, F.lit(False))


def stack(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of a matrix; short ones are filled with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Shard:
    """Some rows in order of their ids, and their postings."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.terms = np.ascontiguousarray(self.vectors.T)
        self.high, self.low = self.vectors.max(axis=0, initial=LEAST), self.vectors.min(axis=0, initial=MOST)
        self.size = max((abs(int(x)) for x in (*self.high, *self.low)), default=0)
        self.postings = [np.flatnonzero(t) for t in self.terms]
        self.whole = np.array([2 * len(p) > len(ids) for p in self.postings], bool)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k highest scores, ties to the smaller id."""
        if len(rows) > 4 * k:
            few = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[few], scores[few]
        order = np.lexsort((rows, -scores))[:k]  # rows are in order of their ids
        return rows[order], scores[order]

    def top(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of those that may be among the k best of all, if scores below ``floor`` are not."""
        width = min(len(query), len(self.terms))
        query = query[:width]
        most = max((abs(int(x)) for x in (query.max(initial=0), query.min(initial=0))))
        if most * self.size * max(width, 1) >= EXACT:
            exact = self.vectors[:, :width].astype(object) @ query.astype(object)
            scores = np.array([min(max(x, LEAST + 1), MOST) for x in exact], np.int64)
            return self.best(np.arange(len(scores)), scores, k)
        bound = np.maximum(np.maximum(query * self.high[:width], query * self.low[:width]), 0)
        order = np.argsort(-bound, kind="stable")
        if len(self.ids) > k and floor <= 0 and width:
            # A threshold to begin with: the rows that gain most from the term of the greatest bound.
            gain = query[order[0]] * self.terms[order[0]]
            some = np.argpartition(-gain, k - 1)[:k]
            floor = max(floor, int((self.vectors[some, :width] @ query).min()))
        rest = np.cumsum(bound[order][::-1])[::-1]  # what a term and those after it can add
        essential = int((rest >= floor).sum()) if floor > 0 else width
        scores, met = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), floor <= 0)
        lead = order[:essential]
        full = lead[self.whole[lead]]
        if len(full):
            scores += query[full] @ self.terms[full]
            met |= True
        for t in lead[~self.whole[lead]].tolist():
            at = self.postings[t]
            scores[at] += query[t] * self.terms[t, at]
            met[at] = True
        rows = np.flatnonzero(met)
        scores = scores[rows]
        for n in range(essential, width):
            ok = scores + rest[n] >= floor
            if not ok.all():
                rows, scores = rows[ok], scores[ok]
            scores = scores + query[order[n]] * self.terms[order[n], rows]
        return self.best(rows, scores, k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERIES) -> DataFrame:
    """(query_id, query_row, rank, vec_id, score): each query's k highest inner products, ties to the smaller vec_id.

    Both tables hold (vec_id, embedding); every query is a row of vectors too. Vectors that are null or hold null or non-finite
    components take no part; missing components of a shorter vector count as zero. A query's own row is no candidate; other
    rows that repeat its vec_id are. Rows that repeat a vec_id are candidates each, and queries each: query_row numbers them,
    in the order of their vectors (1 for a vec_id that one row has). Rows without a vec_id take no part. Components and scores
    beyond 64 bits count as the greatest or least such number; sums of any size are exact up to there. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "maxscore")
    ready = lambda df: df.filter(usable() & F.col("vec_id").isNotNull()).select("vec_id", whole().alias("v"))
    asked = ready(queries).withColumn("query_row", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")))
    asked = scratch.table(asked, "queries")
    rows = ready(vectors)
    n = asked.count()
    blocks = -(-n // block)
    found = None
    for i in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id", "query_row"), F.lit(blocks)) == i)
        taken = mine.select("vec_id", "query_row", "v").toArrow().combine_chunks()
        if not taken.num_rows:
            continue
        wanted = stack(taken.column(2).combine_chunks(), 0)
        shared = spark.sparkContext.broadcast((*(taken.column(c).to_numpy() for c in (0, 1)), wanted, [own_score(q) for q in wanted]))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, numbers, wanted, own = shared.value
            floors = [LEAST] * len(keys)
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(keys)

            def add(ids: np.ndarray, vectors: np.ndarray) -> None:
                shard = Shard(ids, vectors)
                for q, query in enumerate(wanted):
                    at, scores = shard.top(query, k + 1, floors[q])  # the query's own row may be one of them
                    ids_q, scores_q = np.concatenate((kept[q][0], shard.ids[at])), np.concatenate((kept[q][1], scores))
                    best = np.lexsort((ids_q, -scores_q))[: k + 1]
                    kept[q] = ids_q[best], scores_q[best]
                    if len(best) == k + 1:
                        floors[q] = int(scores_q[best[-1]])

            held, count = [], 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    count += b.num_rows
                if count >= SHARD:
                    t = pa.Table.from_batches(held).combine_chunks()
                    add(t.column(0).to_numpy(), stack(t.column(1).combine_chunks(), wanted.shape[1]))
                    held, count = [], 0
            if held:
                t = pa.Table.from_batches(held).combine_chunks()
                add(t.column(0).to_numpy(), stack(t.column(1).combine_chunks(), wanted.shape[1]))
            n_each = [len(x[0]) for x in kept]
            of = [np.repeat(x, n_each) for x in (keys, numbers, np.array(own, np.int64))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, of), *(pa.array(np.concatenate([x[c] for x in kept])) for c in (0, 1))], ["query_id", "query_row", "own", "vec_id", "score"])

        part = rows.mapInArrow(scan, "query_id bigint, query_row int, own bigint, vec_id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, query_row int, rank int, vec_id bigint, score bigint")
    # One row of the query's vec_id and own score is the query itself; if it isn't among the best, it needs no place.
    query = Window.partitionBy("query_id", "query_row")
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    found = found.withColumn("itself", itself).withColumn("n", F.row_number().over(query.orderBy(F.desc("itself")))).filter(~(F.col("itself") & (F.col("n") == 1)))
    best = query.orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def own_score(query: np.ndarray) -> int:
    """A vector's inner product with itself."""
    return min(sum(x * x for x in query.tolist()), MOST)


def search_every_50th(vectors: DataFrame) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by 50, against all rows."""
    slim = vectors.select("vec_id", "embedding")
    return search(slim, slim.filter(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e)::INT AS query_row FROM v
), s AS (
  SELECT q.vec_id AS query_id, q.query_row, n.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, n.e), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM n AS q JOIN n ON q.vec_id % 50 = 0 AND (q.vec_id <> n.vec_id OR q.query_row <> n.query_row)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_row ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, query_row, rank, vec_id, score FROM r WHERE rank <= 5
"""
