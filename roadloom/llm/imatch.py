"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon holds the terms of a band of inverse document frequencies: those that at least LEAST_SHARE of all documents have
(and two documents), and at most MOST_SHARE. Documents are counted for each term, exactly, over the whole corpus. As the
counts add up to the documents' distinct terms, there are at most (distinct terms of a mean document) / LEAST_SHARE terms
in the band, however large the corpus; it is broadcast if it has LARGEST rows at most, and joined by term otherwise.

Each of LEVELS subsets of the lexicon keeps one term in 2^level, by the term's hash. Of each subset, a document's fingerprint
holds a hash of the distinct terms that it keeps: the exclusive or of the terms' hashes, which is that of the sorted list
whatever order they come in. (To sort them for each document, exploded terms have to be gathered again, which spilled over 5
times the input; this needs no list.) Subsets of many sizes make for texts of all lengths: a short one shows in the large
subsets, a long one in the small. Terms are named by 64-bit hashes.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.scratch import Scratch

#: One subset of the lexicon for each entry; it keeps one term in 2^entry.
LEVELS = (1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8)
#: The band: terms of at least so many documents and this share of them, and of at most that share.
LEAST_DOCS, LEAST_SHARE, MOST_SHARE = 2, 1e-4, 0.1
#: Most rows of a lexicon that is broadcast, of 12 bytes each.
LARGEST = 1 << 20
#: Documents that a bucket of neighbours is meant to hold. Over MOST_BUCKETS of them (131 million documents) buckets grow; their windows then spill.
BUCKET_DOCS, MOST_BUCKETS = 2000, 1 << 16


def terms(text: Column) -> Column:
    """The distinct runs of letters and digits of a lower-cased text, and an empty one."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, total: int, text: str = "text") -> DataFrame:
    """(term: its hash, subsets: a bit for each subset that keeps it, h: another hash) of the terms in the band."""
    each = docs.select(F.explode(terms(F.col(text))).alias("term")).filter("term <> ''").select(F.xxhash64("term").alias("term"))
    least = max(LEAST_DOCS, math.ceil(total * LEAST_SHARE))
    found = each.groupBy("term").count().filter(F.col("count").between(least, max(least, int(total * MOST_SHARE))))
    subsets = F.lit(0)
    for k, level in enumerate(LEVELS):
        kept = F.xxhash64("term", F.lit(k)).bitwiseAND((1 << level) - 1) == 0
        subsets = subsets + F.when(kept, 1 << k).otherwise(0)
    return found.select("term", subsets.alias("subsets"), F.xxhash64("term", F.lit(-1)).alias("h"))


def subset_hashes(on: Column) -> list[Column]:
    """Aggregates: the hash of the terms of each subset, null where there is none."""
    return [F.bit_xor(F.when(on & (F.col("subsets").bitwiseAND(1 << k) != 0), F.col("h"))) for k in range(len(LEVELS))]


def fingerprint(hashes: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits for each subset, or -."""
    return F.array_join(F.transform(hashes, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-"))), ":")


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets in which two fingerprints agree, of those where either has a term; 1 if neither has one."""
    zipped = F.arrays_zip(F.split(a, ":").alias("a"), F.split(b, ":").alias("b"))
    same = F.size(F.filter(zipped, lambda p: (p["a"] == p["b"]) & (p["a"] != "-")))
    used = F.size(F.filter(zipped, lambda p: (p["a"] != "-") | (p["b"] != "-")))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def fingerprints(texts: DataFrame, band: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each row of texts, named by ``keys``, the fingerprint of each of the text columns, as <column>_print."""
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("which"), terms(F.col(c)).alias("terms")) for k, c in enumerate(columns)))).alias("x")
    # An empty term, which every row has, keeps rows without terms in the lexicon.
    each = texts.select(*keys, one).select(*keys, "x.which", F.explode(F.array_union("x.terms", F.array(F.lit("")))).alias("said"))
    each = each.select(*keys, "which", F.xxhash64("said").alias("term"))
    empty = band.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(0).alias("subsets"), F.lit(0).cast("long").alias("h"))
    band = band.unionByName(empty)
    each = each.join(F.broadcast(band) if band.count() <= LARGEST else band, "term")
    aggregates = [F.array(*subset_hashes(F.col("which") == k)).alias(c) for k, c in enumerate(columns)]
    return each.groupBy(*keys).agg(*aggregates).select(*keys, *(fingerprint(F.col(c)).alias(f"{c}_print") for c in columns))


def neighbours(docs: DataFrame, total: int) -> tuple[DataFrame, Window]:
    """docs dealt into buckets of consecutive doc_ids, and a window in which each row's next one is the next document in
    descending order of doc_id (null last, ties by text), after the last the first.

    A bucket's greatest doc_ids are copied into the bucket above, and the greatest of all into the lowest, as ghosts that
    stand after its last row; so no window spans more than a bucket.
    """
    n = max(1, min(MOST_BUCKETS, -(-total // BUCKET_DOCS)))
    points = [(k + 1) / n for k in range(n)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, points)), F.lit(max(10_000, 20 * n))), F.max("doc_id")).first()
    bounds = sorted({*(found[0] or []), *([] if found[1] is None else [found[1]])})
    # A bucket is looked up in two steps, by the last bound of each stretch of bounds, then in that stretch.
    step = max(1, math.isqrt(len(bounds)))
    stretches = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    lists = F.array(*(F.array(*map(F.lit, x)) for x in stretches)) if bounds else F.array(F.array().cast("array<bigint>"))
    ends = F.array(*(F.lit(x[-1]) for x in stretches[:-1])) if len(stretches) > 1 else F.array().cast("array<bigint>")
    before = F.size(F.filter(ends, lambda b: b < F.col("doc_id")))
    listed = F.element_at(lists, before + 1)
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(before * step + F.size(F.filter(listed, lambda b: b < F.col("doc_id"))))
    top = F.col("doc_id").eqNullSafe(F.lit(bounds[-1] if bounds else None).cast("long"))
    own = F.struct(F.col("at").alias("bucket"), F.lit(0).alias("ghost"))
    above = F.struct(F.when(top, 0).otherwise(F.col("at") + 1).alias("bucket"), F.when(top, 2).otherwise(1).alias("ghost"))
    edge = F.when(top | F.coalesce(F.array_contains(listed, F.col("doc_id")), F.lit(False)), F.array(own, above)).otherwise(F.array(own))
    dealt = docs.withColumn("at", at).withColumn("place", F.explode(edge)).select(*docs.columns, "place.bucket", "place.ghost")
    return dealt, Window.partitionBy("bucket").orderBy(F.col("ghost") == 2, F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text is the text with its last third (rounded down) replaced by as much of the beginning of the next
    document, in descending order of doc_id, after the last the first. A null text is an empty one; a null doc_id comes
    last, ties come in order of a hash of the text, and each repeated row is a document. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "imatch")
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = slim.count()
    band = scratch.table(lexicon(slim, total), "lexicon")
    dealt, window = neighbours(slim, total)
    n = F.length("text").cast("long")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    changed = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third))
    placed = dealt.withColumn("next", F.lead("text").over(window)).withColumn("rank", F.row_number().over(window)).withColumn("n_chars", n)
    placed = placed.withColumn("edited", changed).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "rank", "ghost", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(placed.select(*keys, "text", "edited"), band, keys, ["text", "edited"])
    following = F.lead("text_print").over(Window.partitionBy("bucket").orderBy("rank"))
    out = prints.withColumn("next_print", following).filter("ghost = 0")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("text_print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("text_print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("text_print"), F.col("next_print")).alias("near_next"),
    )
