import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from roadloom.llm import components as components_of
from roadloom.llm import jaccard, ranges, simjoin
from roadloom.llm.components import components, starred
from roadloom.llm.scratch import Scratch

from .conftest import SF
from .test_textops import brute_sets


def brute(rows):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [brute_sets(t) for _, t in rows]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    for a, b in {p for ks in by.values() for p in combinations(ks, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = root(k)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), len(sets[k]), str(least.get(root(k)))) for k, (d, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(400)}"
    base = [[word() for _ in range(rng.choice((3, 8, 40, 120, 300)))] for _ in range(30)]
    passage = " ".join(word() for _ in range(60))
    rows = [edited(rng, b, k) for b in base for k in (0, 0, 1, 2, 3)]
    hot = [word() for _ in range(120)]
    rows += [edited(rng, hot, rng.randrange(7)) for _ in range(120)] + [" ".join(word() for _ in range(40)) + " " + passage for _ in range(30)]
    walk = list(hot[::-1])
    for _ in range(25):  # a chain: only neighbours are similar
        walk[rng.randrange(len(walk))] = word()
        walk[rng.randrange(len(walk))] = word()
        rows.append(" ".join(walk))
    rows += ["", None, " \n", "one", "One", "one two", "A b C d e", "a B c D e f", "a b c d e f"]
    rng.shuffle(rows)
    out = list(enumerate(rows, 1))
    return [*out, out[5], out[5], (None, rows[7]), (None, "nobody else says this at all"), (3, "another text under the same number")]


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 20)])
def test_join(spark, monkeypatch, seed, block):
    monkeypatch.setattr(simjoin, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS node", "1 AS n").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(df).collect())
    assert got == brute(rows)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_tree():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (40, 300)).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.where(rng.random(300) < rng.random() * 0.4, rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2), base[k % 40])) for k in range(300)]
    n = np.array([len(s) for s in sets])
    for groups in (64, 256):
        tree = simjoin.Tree(n, simjoin.points(sets, groups))
        assert (tree.points.sum(axis=1) == n).all() and tree.points.shape[1] == groups
        for k in range(300):
            rows, bound = tree.near(tree.points[k], int(n[k]))
            assert {j for j in range(300) if 7 * len(np.intersect1d(sets[k], sets[j])) >= 3 * (n[k] + n[j])} <= set(rows.tolist())
            assert all(b >= len(np.intersect1d(sets[k], sets[j])) for j, b in zip(rows, bound))


def test_packed():
    rng = np.random.default_rng(5)
    for top in (2, 10**6, 2**51):
        x = np.sort(rng.integers(0, top, 1000).astype(np.uint64))
        node = rng.integers(-(2**62), 2**62, 1000)
        for place in (np.zeros(1000, np.int32), rng.integers(0, 99, 1000).astype(np.int32)):
            again = ranges.unpack(ranges.pack(x, node, place))
            assert (again[0] == x).all() and (again[1] == node).all() and (again[2] == place).all()


def small_blocks(monkeypatch):
    monkeypatch.setattr(ranges, "PACKED", 400)
    monkeypatch.setattr(ranges, "IN_RANGE", 100)


def test_what_meets(spark, monkeypatch):
    """Ties, common postings and counts against brute force, with one very hot key; and no range gets many rows of it."""
    small_blocks(monkeypatch)
    rng = random.Random(3)
    rows = [(rng.choice((1, 1, rng.randrange(2**63), rng.randrange(400) << 50)), rng.randrange(500), rng.randrange(3)) for _ in range(6000)]
    df = spark.createDataFrame(rows, "x bigint, owner bigint, place int").repartition(5)
    postings = lambda b: iter([(b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy())])
    by = defaultdict(set)
    for x, o, _ in rows:
        by[x].add(o)
    got = sorted(map(tuple, ranges.common(df, postings, ranges.enough(6000), ("o", "p")).distinct().collect()))
    assert got == sorted({(o, p) for x, o, p in rows if len(by[x]) > 1})
    links = [(a, min(os)) for os in by.values() for a in os]
    u, v = starred(*np.array(links).T)
    a, b = np.array(ranges.stars(df, postings, 8).collect()).T
    assert dict(zip(*(x.tolist() for x in starred(a, b)))) == dict(zip(u.tolist(), v.tolist()))
    least = Counter(o for x, o in {r[:2] for r in rows} if len(by[x]) > 1)
    counts = Counter()
    for r in ranges.counted(df, postings, 8, ("o", "c"), 64).collect():
        counts[r.o] += r.c
    assert all(counts[o] >= n for o, n in least.items()) and set(counts) == set(least)


def test_large_group(spark, monkeypatch):
    """A large group of near copies: a spanning forest's links, not its pairs; small blocks and ranges give the same result."""
    monkeypatch.setattr(simjoin, "BLOCK", 50)
    small_blocks(monkeypatch)
    rng = random.Random(6)
    hot = [f"v{rng.randrange(400)}" for _ in range(60)]
    rows = list(enumerate([edited(rng, hot, rng.choice((0, 1, 2, 2, 3, 4))) for _ in range(600)] + [edited(rng, hot[:30] + hot, 1) for _ in range(60)], 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_duplicates(df).collect())
    assert got == brute(rows)


def test_starred():
    u, v = starred(np.array([7, 5, 9, 4]), np.array([5, 3, 8, 4]))
    assert dict(zip(u.tolist(), v.tolist())) == {7: 3, 5: 3, 9: 8}
    chain = np.random.default_rng(1).permutation(5000)
    u, v = starred(chain[1:], chain[:-1])
    assert sorted(u.tolist()) == list(range(1, 5000)) and not v.any()


@pytest.mark.parametrize("one_task", [components_of.ONE_TASK, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_of, "ONE_TASK", one_task)
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    parent = list(range(600))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in got} == {x: root(x) for x in range(600) if root(x) != x} and len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0
