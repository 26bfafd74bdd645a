"""Queries over the traces of searches, as a viewer pages through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.navigate import TRACE_TABLES

PAGE = 20
# The trace tables' names on disk.
FILES = {
    "step_results": "DebugStreamStepResults",
    "weights": "DebugStreamForkChoiceWeights",
    "fork_choices": "DebugStreamForkChoices",
    "steps": "DebugStreamSteps",
    "itineraries": "DebugStreamItineraries",
    "waypoints": "DebugStreamItineraryWaypoints",
}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A trace table from CSV files, or folders of them, one or more a table."""
    return spark.read.schema(TRACE_TABLES[name]).option("escape", '"').csv(f"{folder}/{FILES[name]}-*.csv", header=True)


def write(trace: DataFrame, name: str, folder: str, part: int = 0) -> None:
    """A part of a trace table, as a folder of CSV files that read() finds."""
    trace.write.mode("overwrite").option("escape", '"').csv(f"{folder}/{FILES[name]}-{part}.csv", header=True)


def page(table: DataFrame, itinerary_id: str | None = None, step_num: int | None = None, number: int = 0, size: int = PAGE, then: list | None = None) -> DataFrame:
    """A page of a trace table, in order of itinerary, of ``then``, and of step."""
    if itinerary_id is not None:
        table = table.filter(F.col("itinerary_id") == itinerary_id)
    if step_num is not None:
        table = table.filter(F.col("step_num") == step_num)
    steps = ["step_num"] if "step_num" in table.columns else ["idx"] if "idx" in table.columns else []
    return table.orderBy("itinerary_id", *(then or []), *steps).offset(number * size).limit(size)


def route_until(steps: DataFrame, itinerary_id: str, step_num: int) -> DataFrame:
    """(step_num, points): the routes of an itinerary's steps up to one."""
    some = steps.filter((F.col("itinerary_id") == itinerary_id) & (F.col("step_num") <= step_num))
    return some.select("step_num", F.from_json("route", "array<array<double>>").alias("points"))


def decisions(results: DataFrame, choices: DataFrame, weights: DataFrame) -> DataFrame:
    """Each step's choices with their weights, and whether it was the one chosen."""
    both = choices.join(weights, ["itinerary_id", "step_num", "end_point_id"], "left")
    return both.join(results, ["itinerary_id", "step_num"], "left").withColumn("chosen", F.coalesce(F.col("end_point_id") == F.col("chosen_fork_point_id"), F.lit(False)))


def fork_decisions(weights: DataFrame) -> DataFrame:
    """(itinerary_id, step_num, end_point_id, weight): what each fork's weights lead to; null if nothing beyond the last
    segment may be used, or no choice is left. Ties go to the least point."""
    no = lambda kind: F.bool_or(F.col("weight_type") == kind)
    each = weights.groupBy("itinerary_id", "step_num", "end_point_id").agg(F.sum("weight_value").alias("weight"), no("ForkChoiceDoNotUse").alias("out"), no("LastSegmentDoNotUse").alias("over"))
    best = F.max(F.when(~F.col("out"), F.struct("weight", (-F.col("end_point_id")).alias("least"))))
    forks = each.groupBy("itinerary_id", "step_num").agg(F.bool_or("over").alias("over"), best.alias("best"))
    ok = ~F.col("over")
    return forks.select("itinerary_id", "step_num", F.when(ok, -F.col("best.least")).alias("end_point_id"), F.when(ok, F.col("best.weight")).alias("weight"))


def extent(itineraries: DataFrame) -> DataFrame:
    """The middle of all starts and finishes, and the box around them with a tenth of a degree to spare."""
    ends = itineraries.select(F.explode(F.array(F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")), F.struct(F.col("finish_lat").alias("lat"), F.col("finish_lon").alias("lon")))).alias("p"))
    return ends.agg(F.avg("p.lat").alias("lat"), F.avg("p.lon").alias("lon"), *((f(f"p.{c}") + d).alias(f"{n}_{c}") for c in ("lat", "lon") for f, n, d in ((F.min, "min", -0.1), (F.max, "max", 0.1))))
