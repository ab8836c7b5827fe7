"""Bounded subscriber queues, sessions and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PARTS = 1024  # ranges of the first order column in which rows are numbered


def numbered(rows: DataFrame, keys: list[str], order: list[str], start: int = 0) -> DataFrame:
    """Sequence numbers of each queue; ``order`` begins with a number.

    Rows are numbered inside ranges of that number and what lies before is
    counted, so that one queue with most of the rows is numbered by many tasks.
    """
    low, high = rows.agg(F.min(order[0]), F.max(order[0])).first()
    part = F.call_function("div", F.col(order[0]) - F.lit(low or 0), F.lit(((high or 0) - (low or 0)) // PARTS + 1))
    dealt = rows.withColumn("_part", F.coalesce(part, F.lit(-1).cast("long")))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # PARTS + 1 rows a queue at most
    sizes = sizes.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(sizes, [*keys, "_part"]).withColumn("seq", F.col("_place") + F.col("_before") + start).drop("_part", "_place", "_before")


def bounded(rows: DataFrame, keys: list[str], limit: int, drop_oldest: bool) -> DataFrame:
    """Numbered rows that a queue of ``limit`` keeps: the first ones, or with ``drop_oldest`` the last."""
    if not drop_oldest:
        return rows.where(F.col("seq") < limit)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("seq").desc()))  # a task keeps the first ``limit`` of each queue only
    return rows.withColumn("_back", back).where(F.col("_back") <= limit).drop("_back")


def fetch(rows: DataFrame, keys: list[str], after: int, most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("seq")
    return rows.where(F.col("seq") > after).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def committed(rows: DataFrame, upto: int) -> DataFrame:
    return rows.where(F.col("seq") > upto)


def rate_limited(rows: DataFrame, keys: list[str], ms: Column, most: int, order: list) -> DataFrame:
    """Adds admitted: the first ``most`` of each key in each second of the clock."""
    second = F.call_function("div", ms, F.lit(1000))
    return rows.withColumn("_s", second).withColumn("admitted", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order)) <= most).drop("_s")


def fresh(rows: DataFrame, keys: list[str], stamp: str, order: list) -> DataFrame:
    """Rows whose stamp passes all earlier ones of the key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max(stamp).over(w)).where(F.col("_m").isNull() | (F.col(stamp) > F.col("_m"))).drop("_m")


def owners(rows: DataFrame, keys: list[str], owner: str, order: list) -> DataFrame:
    """Adds kicked (the owner that a registration replaces) and latest."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"kicked": F.lag(owner).over(w), "latest": F.lead(owner).over(w).isNull()})


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, with partial aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
