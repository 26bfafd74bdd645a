import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from roadloom.llm import mixing, sharding


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, free, out = Fraction(sum(sizes.values())), set(sizes), {}
    while free:
        unit = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if 3 * sizes[s] < unit * w[s]}
        if not over:
            return out | {s: unit * w[s] for s in free}
        out |= {s: Fraction(3 * sizes[s]) for s in over}
        free -= over
    return out


def test_mixing(documents, tmp_path):
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 7 > 2, "src0").otherwise(F.col("source")))
    got = mixing.taken(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, by = Counter(), defaultdict(int)
    source = {}
    for r in docs.collect():
        want[r.doc_id, size(r.text)] += 1
        by[r.source] += size(r.text)
        source[r.doc_id] = r.source
    assert Counter((r.doc_id, r.size) for r in got) == want
    goal, took, largest = brute_targets(by), Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by[s] and abs(r.target - goal[s]) < 1e-6 and r.taken in {k * r.size for k in range(4)}
        took[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(took[s] - goal[s]) <= largest[s] for s in goal)
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, got))
    assert mixing.taken(docs.limit(0)).count() == 0
    db = duckdb.connect()
    docs.select("doc_id", "text", "source").toPandas().to_parquet(tmp_path / "d.parquet")
    db.sql(f"create view documents as select * replace (doc_id::bigint as doc_id) from '{tmp_path}/d.parquet'")
    rows = [(None if r[0] is None else int(r[0]), *r[1:]) for r in db.sql(mixing.SQL).fetchall()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got)


def test_mixing_of_rows_alike(spark):
    """Many rows of one doc_id and size, or alike altogether, don't share their fate."""
    rows = [(None, f"a{k} " + "w " * 9, "a") for k in range(1000)] + [(None, "same " * 10, "b")] * 300 + [(k, "x " * 50, "c") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    took = Counter()
    for r in mixing.taken(docs).collect():
        took[r.source_size] += r.taken
    goal = brute_targets({"a": 10000, "b": 3000, "c": 5000})
    assert all(abs(took[n] - goal[s]) <= m for s, n, m in (("a", 10000, 10), ("b", 3000, 10), ("c", 5000, 50)))
    more = mixing.mix(docs.withColumn("more", F.lit(1)))
    assert {r.source: r.n for r in more.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()} == {"a": took[10000], "b": took[3000], "c": took[5000]}


def test_mix_repeats_rows(documents):
    one = mixing.mix(documents)
    assert mixing.repeated(one, ["doc_id"]).count() == one.agg(F.sum("copies")).first()[0]


def test_hypergeometric(spark):
    from math import comb

    total, good, n = 60, 25, 20
    df = spark.range(20000).select(F.expr(sharding.hypergeometric("(id + 0.5D) / 20000D", str(total), str(good), str(n))).alias("k"))
    got = Counter(r.k for r in df.collect())
    for k in range(n + 1):
        assert abs(got[k] / 20000 - comb(good, k) * comb(total - good, n - k) / comb(total, n)) < 2e-4


def test_matrix_adds_up(spark):
    rng = np.random.default_rng(3)
    n = rng.integers(0, 3000, 700)
    sizes = [int(n.sum()) // 3 + (s < int(n.sum()) % 3) for s in range(3)]
    got = sharding.matrix(spark.createDataFrame([(k, int(x)) for k, x in enumerate(n)], "part bigint, n bigint"), sizes, 5).collect()
    assert {r.part: sum(r.take) for r in got} == dict(enumerate(map(int, n)))
    assert [sum(r.take[s] for r in got) for s in range(3)] == sizes and min(min(r.take) for r in got) >= 0


def test_sharding(documents):
    got = sharding.shard_documents(documents).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_documents(documents.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard_documents(documents.limit(0)).count() == 0
    few = sharding.shard_documents(documents.limit(3)).collect()
    assert len(few) == 3 and {r.slot for r in few} == {0}


def test_shards_are_uniform(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    hits = np.zeros((8, 8))
    for r in sharding.shard(rows, ["k"]).collect():
        hits[r.k % 8, r.shard] += 1
    assert ((hits - 62.5) ** 2 / 62.5).sum() < 100


def test_sharding_of_rows_alike(spark):
    rows = spark.range(3000).selectExpr("if(id < 2500, 7L, id) AS doc_id", "if(id < 2500, 'the same', concat('text ', id)) AS text")
    slots = defaultdict(list)
    for r in sharding.shard_documents(rows).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(375)) for s in slots.values()) and len(slots) == 8
