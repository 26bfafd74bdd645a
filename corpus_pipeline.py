"""A corpus pipeline: from raw documents to token ids, each stage one operator of roadloom.llm.

Stages take (spark, docs, sf_dir) and return the documents that they keep, with the columns of documents; the last one
adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import bpe, jaccard, langid, mixing, paragraphs
from roadloom.llm.queries import BYTE_BPE
from roadloom.llm.scratch import Scratch

#: Texts that need more phrases for each symbol than this in every language are in none of them: their longest matches
#: are hardly longer than single letters.
MOST_PHRASES = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are in one of the learned languages: not those without letters, nor gibberish."""
    found = langid.predict(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("phrase_rate") <= MOST_PHRASES)).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard.representatives(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that another document has already."""
    return paragraphs.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or sample each source's documents to its target; a document that is taken twice is there twice."""
    return mixing.repeated(mixing.mix(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids of the text."""
    return bpe.encode_corpus(docs, BYTE_BPE).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each one's result is written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
