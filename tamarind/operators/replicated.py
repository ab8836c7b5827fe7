"""Reads and merges of conflict-free replicated data kept as rows of dots (uri, replica, ver, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 40  # more than rows in a file


def merge(dots: DataFrame, replaced: DataFrame, keys: list[str]) -> DataFrame:
    """Dots of all deltas, once each, without those that another dot replaced; order and repetition don't matter."""
    return dots.distinct().join(replaced.select(*keys).distinct(), keys, "left_anti")


def last_written(dots: DataFrame) -> DataFrame:
    """Each replica's highest version and the value it wrote last; dots have a place (_file, _row), and of equal versions the first one counts.

    A dot without a value wrote nothing, but its version counts.
    """
    order = F.when(F.col("value").isNotNull(), F.col("ver").cast("decimal(38,0)") * F.lit(PLACES) - F.col("_row"))  # one number, so that rows are aggregated by hash
    file = dots.groupBy("uri", "replica", "_file").agg(F.max("ver").alias("ver"), F.max_by("value", order).alias("value"), F.max_by("ver", order).alias("_at"))
    first = F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("_at"), "_file")))
    return file.groupBy("uri", "replica").agg(F.max("ver").alias("ver"), first.alias("value"))


def counter(dots: DataFrame) -> DataFrame:
    """Sum over replicas of each one's value at its highest version."""
    last = last_written(dots)
    return last.groupBy("uri").agg(F.sum("value").alias("value"))


def register(alive: DataFrame) -> DataFrame:
    """All values that survive, ascending."""
    return alive.groupBy("uri").agg(F.sort_array(F.collect_set("value")).alias("values"))


def add_wins(alive: DataFrame) -> DataFrame:
    return alive.select("uri", "value").distinct()


def remove_wins(alive: DataFrame, flag: str = "flag") -> DataFrame:
    """Elements with a surviving true dot and no surviving false one."""
    return alive.groupBy("uri", "value").agg(F.bool_and(flag).alias("_all")).where("_all").drop("_all")


def delta(dots: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """What a peer lacks."""
    return dots.join(known.select(*keys).distinct(), keys, "left_anti")


def compactable(events: DataFrame, replaces: DataFrame, keys: list[str], before: int) -> DataFrame:
    """Events of the history that may go now: without a value, older than ``before``, and replaced only by events that hold no value and are replaced themselves.

    ``events`` has the keys, value and at; ``replaces`` has a row for each event
    (the keys) and each one that replaced it (the keys with ``by_`` before them).
    A caller repeats it on what is left.
    """
    by = [F.col(f"by_{k}").alias(k) for k in keys]
    firm = events.select(*keys).join(replaces.select(*keys).distinct(), keys, "left_anti")
    holding = events.where("value is not null").select(*keys).unionByName(firm).distinct()
    kept = replaces.select(*by, F.struct(*keys).alias("_old")).join(holding, keys, "left_semi").select("_old.*").distinct()
    return events.where(F.col("value").isNull() & (F.col("at") < before)).join(kept, keys, "left_anti")


def exchange(mine: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """What one peer has after it was sent what it lacks; each side sends the other its delta."""
    return mine.unionByName(delta(theirs, mine, keys))
