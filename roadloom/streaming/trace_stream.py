"""Progress of searches that are still running, from the trace files as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.navigate import TRACE_TABLES
from roadloom.operators.trace import FILES


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A trace table as a stream of the files of a folder."""
    return spark.readStream.schema(TRACE_TABLES[name]).option("header", True).option("escape", '"').option("pathGlobFilter", f"{FILES[name]}-*.csv").csv(folder)


def progress(results: DataFrame) -> DataFrame:
    """(itinerary_id, result, n): how often each search chose, backed up, got stuck or was stopped. A row of state each."""
    return results.groupBy("itinerary_id", "result").agg(F.count("*").alias("n"))
