"""Mixing sources to target weights, in words.

Every source has a weight. Its target is its share of all words by weight, but at most ``epochs`` times its own words:
sources are clamped there in ascending order of cap over weight, and what they can't take goes to the others by weight,
until none is above (capped water-filling, over one row a source). A target is met by whole repetitions of the source and
a seeded sample of its documents for the rest. The sample is a prefix of the source in the order of a hash of doc_id and
text, cut where its words come nearest to the rest; the cut is found through sums of 4,096 hash ranges, so that no task sees a whole source.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.scratch import Scratch

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-0"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, text: str = "text", seed: str = SEED) -> DataFrame:
    """docs with their sizes, and the hash that orders a source's documents: mix_size, mix_key, mix_hash. Rows of one hash
    have the same doc_id, source and text."""
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    one = docs.withColumn("mix_size", word_count(text)).withColumn("mix_key", key)
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mix_size", F.md5(F.coalesce(text, F.lit(""))))
    return one.withColumn("mix_hash", F.md5(name))


def numbered(docs: DataFrame) -> DataFrame:
    """A sized() table in which rows of one hash are told apart by a number behind it."""
    alike = Window.partitionBy("mix_key", "mix_hash").orderBy("mix_size")
    return docs.withColumn("mix_hash", F.concat_ws("-", "mix_hash", F.lpad(F.row_number().over(alike).cast("string"), 12, "0")))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(mix_key, source_size, target) from (mix_key, source, source_size), a row for each source.

    Weights repeat over the sources by code point, the null source last.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    one = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("long"))
    one = one.withColumn("cap", F.col("source_size") * epochs)
    everything, below = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "mix_key")
    left = F.sum("source_size").over(everything) - (F.sum("cap").over(below.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    shares = F.sum("weight").over(everything) - (F.sum("weight").over(below.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
    one = one.withColumn("unit", left / shares)  # words for each unit of weight, if all sources before are clamped
    free = F.col("cap") / F.col("weight") > F.col("unit")
    unit = F.min_by(F.when(free, F.col("unit")), F.when(free, F.col("cap") / F.col("weight"))).over(everything)
    return one.select("mix_key", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("weight") * unit), F.col("cap").cast("double")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(mix_key, source_size, target, whole, cut) of a numbered() table: documents up to hash ``cut`` are taken whole + 1 times."""
    totals = docs.groupBy("mix_key").agg(F.first("source").alias("source"), F.sum("mix_size").alias("source_size"))
    goal = targets(totals, weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0)
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    part = F.substring("mix_hash", 1, 3).alias("part")
    sums = docs.groupBy("mix_key", part).agg(F.sum("mix_size").alias("held"))
    run = Window.partitionBy("mix_key").orderBy("part")
    sums = sums.withColumn("before", F.sum("held").over(run) - F.col("held"))
    edge = sums.join(goal, "mix_key").filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("held"))).select("mix_key", "part", "before", "rest")
    inside = Window.partitionBy("mix_key", "part").orderBy("mix_hash")
    near = docs.select("mix_key", part, "mix_hash", "mix_size").join(edge, ["mix_key", "part"])
    near = near.withColumn("until", F.col("before") + F.sum("mix_size").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    cuts = near.groupBy("mix_key").agg(F.coalesce(F.max(F.when(F.col("until") - F.col("mix_size") / 2 <= F.col("rest"), F.col("mix_hash"))), F.max("part")).alias("cut"))
    return goal.join(cuts, "mix_key", "left").select("mix_key", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, text: str = "text", seed: str = SEED) -> DataFrame:
    """docs with size (words), source_size, target, and copies: how often the mix takes the document, 0 to ``epochs``.

    A null text has size 0; null sources are one source. Rows of equal doc_id, source and text are documents each: of those
    at the cut, as many are taken as the target asks for. Reruns take the same. An empty table gives an empty table. Columns
    of these names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    kept = docs.drop("size", "source_size", "target", "copies")
    slim = scratch.table(numbered(sized(docs.select("doc_id", "source", text), text, seed).drop(text)), "sizes")
    by_source = scratch.table(plan(slim, weights, epochs), "plan")
    if set(kept.columns) <= {"doc_id", "source", text}:
        # The query asks for no text: its rows are the sizes that are written already.
        rows = slim.join(by_source, "mix_key")
    else:
        # Only rows that share the hash at the cut have to be numbered.
        both = sized(kept, text, seed).join(by_source, "mix_key")
        at_cut = F.col("mix_hash") == F.substring("cut", 1, 32)
        rows = both.filter(~at_cut).unionByName(numbered(both.filter(at_cut)))
    extra = (F.col("mix_hash") <= F.col("cut")).cast("int")
    return rows.withColumn("copies", (F.col("whole") + extra).cast("int")).withColumnRenamed("mix_size", "size").drop("mix_key", "mix_hash", "whole", "cut")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def taken(docs: DataFrame) -> DataFrame:
    one = mix(docs.select("doc_id", "source", "text"))
    return one.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS name FROM documents
), m AS (
  SELECT *, md5(concat('mix-0|', coalesce(doc_id::VARCHAR, 'null'), '|', size::VARCHAR, '|', name)) AS hash FROM d
), h AS (
  SELECT doc_id, source, size, concat(hash, '-', lpad((row_number() OVER (PARTITION BY source, hash))::VARCHAR, 12, '0')) AS hash FROM m
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((n - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap FROM s
), u AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER o - weight))::DOUBLE AS unit
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, CASE WHEN source IS NULL THEN 'null' ELSE 's' || source END ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT min_by(unit, cap::DOUBLE / weight) AS unit FROM u WHERE cap::DOUBLE / weight > unit
), t AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, weight * (SELECT unit FROM f)), cap::DOUBLE) AS target FROM w
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 3) ELSE 0 END AS whole FROM t
), r AS (
  SELECT h.doc_id, h.size, h.hash, g.source_size, g.target, g.whole, target - whole * source_size AS rest, g.source,
    sum(h.size) OVER (PARTITION BY h.source ORDER BY h.hash RANGE UNBOUNDED PRECEDING) AS until
  FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT source, max(hash) AS cut FROM r WHERE until - size / 2 <= rest GROUP BY source
)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * (whole + CASE WHEN r.hash <= c.cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""
