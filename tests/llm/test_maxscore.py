from collections import Counter

import duckdb
import numpy as np
import pytest

from roadloom.llm import maxscore

from .conftest import SF


def whole(x):
    return int(min(max(np.floor(float(x) * 256), maxscore.LEAST), 2.0**63 - 1024)) if abs(float(x)) < 2**55 else (maxscore.MOST if x > 0 else maxscore.LEAST)


def brute(rows, k=5, every=50):
    ok = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, seen = [], Counter()
    for n, (q, a) in sorted(enumerate(ok), key=lambda x: (x[1][0], x[1][1])):
        if q % every == 0:
            seen[q] += 1
            dot = lambda b: max(min(sum(x * y for x, y in zip(a, b)), maxscore.MOST), maxscore.LEAST + 1)
            s = sorted((-dot(b), i) for m, (i, b) in enumerate(ok) if m != n)
            out += [(q, seen[q], r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 8192])
def test_search(spark, block):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    same = [1.0] * 8
    odd = [(100_000, None), (100_050, [None] * 64), (100_100, [float("nan")] * 64), (100_150, [float("inf")]), (None, same), (100_200, same), (100_201, same), (100_202, same), (100_203, same[:3]), (100_250, []), (100_204, same)]
    odd += [(100_300, same), (100_300, same), (100_300, [0.5, -0.5]), (100_200, same[:2])]  # queries that repeat a vec_id
    rows = e.unionByName(spark.createDataFrame(odd, e.schema)).repartition(5)
    want = brute([tuple(r) for r in rows.collect()])
    got = maxscore.search(rows, rows.filter("vec_id % 50 = 0"), block=block)
    assert sorted(map(tuple, got.collect())) == want
    assert maxscore.search_every_50th(rows.limit(0)).count() == 0


def test_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=6) * 10.0 ** rng.integers(0, 25)).tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, maxscore.search_every_50th(df).collect())) == brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_sparse_and_dense_shards(seed):
    """The shard's best rows are those of an exhaustive search, for any threshold that the best reach."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-40, 200, (700, 50)) * (rng.random((700, 50)) < rng.choice((0.05, 0.3, 1.0), 50))
    shard = maxscore.Shard(rng.permutation(700), vectors)
    for q in vectors[:40]:
        scores = shard.vectors @ q
        order = np.lexsort((shard.ids, -scores))[:6]
        for floor in (maxscore.LEAST, 0, int(scores[order[-1]])):
            at, got = shard.top(q, 6, floor)
            assert (shard.ids[at][:6] == shard.ids[order]).all() and (got[:6] == scores[order]).all()


def test_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
    got = maxscore.search_every_50th(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(db.sql(maxscore.SQL).fetchall())
