"""Windows over event time, the same on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(rows: DataFrame, start: Column, end: Column, width: int, keys: list[str]) -> DataFrame:
    """How many spans of time touch each slot; a span over several slots counts in each."""
    first, last = (F.call_function("div", x, F.lit(width)) for x in (start, end))
    touched = rows.select(*keys, F.explode(F.sequence(first, last)).alias("slot"))
    return touched.groupBy(*keys, "slot").agg(F.count("*").alias("n"))


def idle_sessions(rows: DataFrame, ts: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Runs of events with no pause of ``gap``; on a stream, ``late`` is how long one waits for late events."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    found = timed.groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return found.select(*keys, F.unix_millis("session_window.start").alias("first_ms"), "n")


def once(rows: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """On a stream: one of the rows of each key that come within ``late`` of each other."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def moving(rows: DataFrame, ts: str, width: str, slide: str, keys: list[str], value: Column, late: str | None = None) -> DataFrame:
    """Sum and number of a value in windows of ``width`` that begin every ``slide``; on a stream, ``late`` is how long one waits for late events."""
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    found = timed.groupBy(*keys, F.window(ts, width, slide)).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return found.select(*keys, F.unix_millis("window.start").alias("start_ms"), "total", "n")
