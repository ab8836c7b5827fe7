"""Key ranges: routing, overlaps, split keys, longest prefixes, and range sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(key: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (key >= lo)) & (hi.isNull() | (key < hi))


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return (hi1.isNull() | lo2.isNull() | (lo2 < hi1)) & (hi2.isNull() | lo1.isNull() | (lo1 < hi2))


PARTS = 4096  # pieces of the key space by which keys and ranges find each other


def _pieces(low: int, high: int):
    """Piece of an integer key, by equal widths between two keys; what lies outside is in the first or last."""
    width = max(1, (high - low) // PARTS + 1)
    return lambda key: F.when(key.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(PARTS), F.call_function("div", key - low, F.lit(width))))).cast("int")


def route(keys: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """The range that owns each key, by an equi-join on pieces of the key space: a range has a row for each piece it touches."""
    low, high = keys.agg(F.min(key), F.max(key)).first()
    piece = _pieces(low or 0, high or 0)
    first, last = F.coalesce(piece(F.col("lo")), F.lit(0)), F.coalesce(piece(F.col("hi") - 1), F.lit(PARTS))
    spread = ranges.where("lo is null or hi is null or lo < hi").withColumn("_piece", F.explode(F.sequence(first, last)))
    return keys.withColumn("_piece", piece(F.col(key))).join(spread, "_piece").where(inside(F.col(key), F.col("lo"), F.col("hi"))).drop("_piece")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ranges, left (lo, hi) and right (lo2, hi2), that overlap; a pair is found in the first piece that both touch."""
    ends = left.select(F.col("lo").alias("x")).unionByName(left.select(F.col("hi").alias("x"))).unionByName(right.select(F.col("lo2").alias("x"))).unionByName(right.select(F.col("hi2").alias("x")))
    low, high = ends.agg(F.min("x"), F.max("x")).first()
    piece = _pieces(low or 0, high or 0)
    spread = lambda df, lo, hi, first: df.withColumn(first, F.coalesce(piece(F.col(lo)), F.lit(0))).withColumn("_piece", F.explode(F.sequence(F.col(first), F.greatest(F.col(first), F.coalesce(piece(F.col(hi)), F.lit(PARTS))))))
    met = spread(left, "lo", "hi", "_a").join(spread(right, "lo2", "hi2", "_b"), "_piece").where(F.col("_piece") == F.greatest("_a", "_b"))
    return met.where(overlap(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))).drop("_piece", "_a", "_b")


def intersection(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> tuple[Column, Column]:
    """Bounds of what two ranges share; null is open."""
    return F.greatest(lo1, lo2), F.least(hi1, hi2)


def can_combine(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Whether one range ends where the other begins."""
    start, end = intersection(lo1, hi1, lo2, hi2)
    return F.coalesce(start == end, F.lit(False))


def combined(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> tuple[Column, Column]:
    """Bounds of both ranges together."""
    return F.when(lo1.isNotNull() & lo2.isNotNull(), F.least(lo1, lo2)), F.when(hi1.isNotNull() & hi2.isNotNull(), F.greatest(hi1, hi2))


def splittable(lo: Column, hi: Column, key: Column) -> Column:
    """Whether the key lies strictly inside."""
    return (lo.isNull() | (lo < key)) & (hi.isNull() | (key < hi))


def valid_split_set(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Of each set of half-open ranges, whether they tile the whole key space: each begins where one ends, one at the open start and one at the open end."""
    forward = F.coalesce(F.col("lo") < F.col("hi"), F.lit(True)).alias("forward")
    end = F.struct(F.col("hi").alias("at"), F.lit(1).alias("ends"), F.lit(0).alias("starts"), forward)
    start = F.struct(F.col("lo").alias("at"), F.lit(0).alias("ends"), F.lit(1).alias("starts"), forward)
    points = ranges.select(*keys, F.inline(F.array(end, start))).groupBy(*keys, "at").agg(F.sum("ends").alias("ends"), F.sum("starts").alias("starts"), F.bool_and("forward").alias("forward"))
    tiled = F.bool_and((F.col("ends") == 1) & (F.col("starts") == 1) & F.col("forward"))
    return points.groupBy(*keys).agg((tiled & (F.count_if(F.col("at").isNull()) == 1)).alias("valid"))


def split_key(loads: DataFrame, key: str, load: str) -> DataFrame:
    """Least integer key at which half of the load is reached, by totals of PARTS pieces of the key space first, then inside one."""
    cut = loads.groupBy(key).agg(F.sum(load).alias("load"))
    low, high = loads.agg(F.min(key), F.max(key)).first()
    ranged = cut.withColumn("part", _pieces(low or 0, high or 0)(F.col(key)))
    parts = ranged.groupBy("part").agg(F.sum("load").alias("total"))
    w = Window.orderBy("part")  # PARTS + 1 rows at most
    parts = parts.withColumns({"before": F.sum("total").over(w) - F.col("total"), "all": F.sum("total").over(Window.partitionBy())})
    part = parts.where((F.col("before") * 2 < F.col("all")) & ((F.col("before") + F.col("total")) * 2 >= F.col("all")))
    cum = F.col("before") + F.sum("load").over(Window.partitionBy("part").orderBy(key))
    return ranged.join(part, "part").withColumn("cum", cum).where(F.col("cum") * 2 >= F.col("all")).agg(F.min(key).alias("split_key"), F.min("cum").alias("load_below"))


def longest_prefix(rows: DataFrame, prefixes: DataFrame, value: str) -> DataFrame:
    """Adds the longest prefix of each value, by an equi-join on the lengths that prefixes have."""
    lengths = sorted(prefixes.agg(F.collect_set(F.length("prefix"))).first()[0])
    tried = rows.select(value).distinct().select(value, F.explode(F.array(*(F.substring(value, 1, n) for n in lengths))).alias("prefix")).distinct()
    best = tried.join(prefixes, "prefix").groupBy(value).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return rows.join(best, value, "left")


def merge_ranges(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Closed ranges merged where they touch or overlap."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + 1), 1).otherwise(0)
    return rows.withColumn("_reach", reach).withColumn("_i", F.sum(opens).over(w)).groupBy(*keys, "_i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_i")


def subtract_ranges(left: DataFrame, right: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """What closed ranges of ``left`` cover and none of ``right`` does, merged."""

    def steps(df: DataFrame, a: int, b: int) -> DataFrame:
        opens = F.struct(F.col(lo).alias("_at"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
        shuts = F.struct((F.col(hi) + 1).alias("_at"), F.lit(-a).alias("_a"), F.lit(-b).alias("_b"))
        return df.select(*keys, F.inline(F.array(opens, shuts)))

    points = steps(left, 1, 0).unionByName(steps(right, 0, 1)).groupBy(*keys, "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_at")
    cover = points.select(*keys, F.col("_at").alias(lo), (F.lead("_at").over(w) - 1).alias(hi), F.sum("_a").over(w).alias("_a"), F.sum("_b").over(w).alias("_b"))
    return merge_ranges(cover.where("_a > 0 and _b = 0").select(*keys, lo, hi), keys, lo, hi)


def hash32(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def assign(rows: DataFrame, nodes: DataFrame, key: str, node: str, points: int = 16) -> DataFrame:
    """Adds the node whose point on a hash ring is the first at or after the key's, the least point after the last.

    The ring has ``points`` rows a node; its arcs are looked up by the hash's upper ten bits.
    """
    ring = nodes.select(node, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"))
    ring = ring.groupBy(hash32(F.concat_ws("-", node, "_k")).alias("_to")).agg(F.min(node).alias(node))
    w = Window.orderBy("_to")  # the ring alone
    arcs = ring.withColumn("_from", F.coalesce(F.lag("_to").over(w) + 1, F.lit(0)))
    last = ring.agg((F.max("_to") + 1).alias("_from"), F.min_by(node, "_to").alias(node)).withColumn("_to", F.lit((1 << 32) - 1)).where("_from <= _to")
    arcs = arcs.unionByName(last).withColumn("_part", F.explode(F.sequence(F.shiftright("_from", 22), F.shiftright("_to", 22))))
    placed = rows.withColumn("_at", hash32(F.col(key))).withColumn("_part", F.shiftright("_at", 22))
    return placed.join(arcs, "_part").where("_at between _from and _to").drop("_part", "_at", "_from", "_to")


def common_ranges(left: DataFrame, right: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """What closed ranges of both sides cover, merged."""

    def steps(df: DataFrame, a: int, b: int) -> DataFrame:
        opens = F.struct(F.col(lo).alias("_at"), F.lit(a).alias("_a"), F.lit(b).alias("_b"))
        shuts = F.struct((F.col(hi) + 1).alias("_at"), F.lit(-a).alias("_a"), F.lit(-b).alias("_b"))
        return df.select(*keys, F.inline(F.array(opens, shuts)))

    points = steps(left, 1, 0).unionByName(steps(right, 0, 1)).groupBy(*keys, "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    w = Window.partitionBy(*keys).orderBy("_at")
    cover = points.select(*keys, F.col("_at").alias(lo), (F.lead("_at").over(w) - 1).alias(hi), F.sum("_a").over(w).alias("_a"), F.sum("_b").over(w).alias("_b"))
    return merge_ranges(cover.where("_a > 0 and _b > 0").select(*keys, lo, hi), keys, lo, hi)


def effective_route(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Of each service's leader ranges (epoch, id, lo, hi) the ones that serve: those of the least epoch, tiled from the first start on.

    The next range is the one of least start at or after the end of the last, of
    least id among equal starts; an open end is the last.  A service's ranges are
    its catalogue, one array in order.
    """
    oldest = ranges.groupBy(*keys).agg(F.min("epoch").alias("epoch"))
    found = ranges.join(oldest, [*keys, "epoch"])
    row = F.struct("lo", "id", "hi")  # an open start sorts first
    listed = found.groupBy(*keys, "epoch").agg(F.sort_array(F.collect_list(row)).alias("_all"))
    none = F.struct(F.lit(False).alias("begun"), F.lit(None).cast("long").alias("reach"), F.array().cast(f"array<{found.select(row.alias('r')).schema['r'].dataType.simpleString()}>").alias("route"))

    def step(state: Column, x: Column) -> Column:
        fits = ~state["begun"] | F.coalesce(x["lo"] >= state["reach"], F.lit(False))  # nothing follows an open end
        return F.when(fits, F.struct(F.lit(True).alias("begun"), x["hi"].alias("reach"), F.array_append(state["route"], x).alias("route"))).otherwise(state)

    return listed.select(*keys, "epoch", F.inline(F.aggregate("_all", none, step)["route"]))
