import hashlib
import math
import re
from collections import Counter
from functools import reduce
from operator import xor
from statistics import mean

import pytest
from pyspark.sql import functions as F

from roadloom.llm import imatch


def brute_likeness(a, b):
    pairs = [(x, y) for x, y in zip(a.split(":"), b.split(":")) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


@pytest.mark.parametrize("bucket", [2000, 9])
def test_edited(spark, documents, monkeypatch, bucket):
    monkeypatch.setattr(imatch, "BUCKET_DOCS", bucket)
    docs = documents.filter("doc_id is null or doc_id <> -4").repartition(3)
    got = imatch.edited(docs).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)]
        third = len(t) // 3
        changed = t[: len(t) - third] + nxt[1][:third]
        r = by[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == brute_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == brute_likeness(r.fingerprint, by[nxt[0]].fingerprint)
    prints = {}
    for d, t in rows:
        assert prints.setdefault(t, by[d].fingerprint) == by[d].fingerprint
    assert mean(r.near_edited for r in got) > 2 * mean(r.near_next for r in got)


def test_fingerprint_is_of_band_terms(spark):
    texts = ["alpha beta common", "beta, ALPHA; common common", "alpha beta common onlyhere", "gamma common", "gamma delta common", "delta common"] + ["common"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in imatch.edited(docs).collect()}
    assert got[0] == got[1] == got[2] and got[3] != got[4] and got[6] == ":".join("-" * len(imatch.LEVELS))


def brute_prints(docs, texts):
    """Fingerprints in Python, from the terms' hashes that Spark gives."""
    spark = docs.sparkSession
    rows = [r.text or "" for r in docs.select("text").collect()]
    said = lambda t: {w for w in re.split(r"[\W_]+", t.lower()) if w}
    frequency = Counter(w for t in rows for w in said(t))
    least = max(imatch.LEAST_DOCS, math.ceil(len(rows) * imatch.LEAST_SHARE))
    band = [w for w, n in frequency.items() if least <= n <= max(least, int(len(rows) * imatch.MOST_SHARE))]
    hashed = spark.createDataFrame([(w,) for w in band], "w string").select("w", F.xxhash64("w").alias("t"))
    hashed = hashed.select("w", F.xxhash64("t", F.lit(-1)).alias("h"), *(F.xxhash64("t", F.lit(k)).alias(f"k{k}") for k in range(len(imatch.LEVELS)))).collect()
    by = {r.w: r for r in hashed}

    def one(t, k, level):
        mine = [by[w].h for w in said(t) if w in by and by[w][f"k{k}"] % 2**level == 0]
        return f"{reduce(xor, mine) % 2**64:016x}" if mine else "-"

    return [":".join(one(t, k, level) for k, level in enumerate(imatch.LEVELS)) for t in texts]


@pytest.mark.parametrize("largest", [1 << 20, 10])
def test_against_brute_force(spark, documents, monkeypatch, largest):
    monkeypatch.setattr(imatch, "LARGEST", largest)
    docs = documents.withColumn("text", F.regexp_replace("text", "[^A-Za-z0-9 ]", " ")).withColumn("doc_id", F.coalesce("doc_id", F.lit(10**6))).filter("doc_id <> -4")
    got = {r.doc_id: r.fingerprint for r in imatch.edited(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in rows], brute_prints(docs, [r.text or "" for r in rows]), strict=True))


def test_terms_of_one_document_are_in_no_lexicon(spark):
    rows = [(k, " ".join(f"t{k}x{j}" for j in range(50))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert imatch.lexicon(docs, 300).count() == 0
    assert {r.fingerprint for r in imatch.edited(docs).collect()} == {":".join("-" * len(imatch.LEVELS))}


def test_buckets_in_two_steps(spark, monkeypatch):
    """Many buckets, ids far apart, and ids that are bounds: each document's next one is right."""
    monkeypatch.setattr(imatch, "BUCKET_DOCS", 3)
    rows = [(k * k, f"{k} " * 9) for k in range(-1, 200) if k] + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").dropDuplicates(["doc_id"]).cache()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(text, reverse=True)
    for r in imatch.edited(docs).collect():
        t, nxt = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()


def test_many_documents_of_one_id_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BUCKET_DOCS", 5)
    rows = [(5, f"text number {k} " * (k % 4 + 1)) for k in range(60)] + [(k, f"other {k}") for k in range(40, 50)] + [(9, "long words here " * 20000), (5, "text number 3 " * 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashes = [r[0] for r in docs.select(F.xxhash64("text")).collect()]
    order = sorted(range(len(rows)), key=lambda k: (-rows[k][0], hashes[k]))
    want = Counter()
    for n, k in enumerate(order):
        t, nxt = rows[k][1], rows[order[(n + 1) % len(order)]][1]
        want[rows[k][0], hashlib.sha256((t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in imatch.edited(docs).collect()) == want


def test_few_documents(spark):
    one = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id bigint, text string")
    r = imatch.edited(one).first()
    assert r.edited_sha256 == hashlib.sha256(("a b c d e f g h i"[:12] + "a b c d e f g h i"[:5]).encode()).hexdigest()
    assert imatch.edited(one.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None), (None, "x y z"), (None, "x y z")], "doc_id bigint, text string")
    assert imatch.edited(none.withColumn("bucket", F.lit(1))).count() == 3
