"""Sharding by Hilbert-curve order, with DataFrame operations only.

Several metadata dimensions are quantised into equal numbers of cells, the
Hilbert index of a row's cell orders the rows, and the order is cut into runs
of equal row counts.  Rows of a shard then lie close in all dimensions, so that
min/max statistics of several columns prune files at once.

The global rank of a row is the number of rows in smaller (cell, sub-cell)
groups plus its rank inside its own.  Sub-cells are hash ranges whose number
follows the row count, so a cell that holds a third of all rows is ranked by
many tasks and no global sort or single-partition window over rows is needed.

Strings are quantised like numbers, by their place among all rows: the distinct
values are counted, put in order by ranges, and the values at which the running
count passes each quantile are the bounds.

Defined cases: a null dimension is in its dimension's cell 0.  Repeated ids are
placed one by one.  An empty table gives no rows.  Input columns that carry an
output's name are replaced; other names don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared



def _string_bounds(values: DataFrame, cuts: int) -> list[str]:
    """The values of the one string column at which the share of rows up to them passes each k / cuts."""
    counts = values.toDF("v").where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    parts = shared.settle(counts.repartitionByRange(shared.partitions(values.sparkSession), "v").withColumn("part", F.spark_partition_id()), "values")
    sums = sorted(tuple(r) for r in parts.groupBy("part").agg(F.sum("n")).collect())  # a row a partition
    total, before, at = sum(n for _, n in sums), {}, 0
    for part, n in sums:
        before[part], at = at, at + n
    if not total:
        return []
    start = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("part"))
    upto = start + F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cell = lambda rank: F.call_function("div", rank * cuts, F.lit(total))
    placed = parts.withColumn("upto", upto).where(cell(F.col("upto")) > cell(F.col("upto") - F.col("n")))
    bounds = sorted(r[0] for r in placed.where(F.col("upto") < total).select("v").collect())  # fewer than ``cuts``
    shared.discard(parts)
    return bounds


def quantise(df: DataFrame, dims: dict[str, str], bits: int) -> dict[str, Column]:
    """Cells of columns between quantiles: of numbers approximate ones from one aggregate row, of strings exact ones."""
    count = 2**bits
    text = {n for n, c in dims.items() if isinstance(df.schema[c].dataType, T.StringType)}
    cuts = [k / count for k in range(1, count)]
    numbers = [F.percentile_approx(c, cuts, 10000).alias(n) for n, c in dims.items() if n not in text]
    row = df.agg(*numbers).first() if numbers else {}
    cells = {}
    for n, c in dims.items():
        kind = "string" if n in text else "double"
        found = _string_bounds(df.select(c), count) if n in text else sorted(set(row[n] or ()))
        cells[n] = F.when(F.col(c).isNull(), 0).otherwise(_passed(F.array(*(F.lit(b) for b in found)).cast(f"array<{kind}>"), F.col(c).cast(kind)))
    return cells


def _passed(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= value))


def hilbert(cells: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve, from the highest bit down, by rotated and reflected Gray codes."""
    n = len(cells)
    full = 2**n - 1
    gray_inverse, entry, turn = [], [], []
    for w in range(2**n):
        g, x = w, w
        while x := x >> 1:
            g ^= x
        gray_inverse.append(g)
        k = 2 * ((w - 1) // 2) if w else 0
        entry.append(k ^ (k >> 1))
        last = (w - 1 if w % 2 == 0 else w) if w else 0
        turn.append(((last ^ (last + 1)).bit_length() - 1) % n if w else 0)
    table = lambda xs: F.array(*map(F.lit, xs))
    inverse, entry, turn = table(gray_inverse), table(entry), table(turn)
    rotr = lambda x, k: (F.call_function("shiftrightunsigned", x, k).bitwiseOR(F.call_function("shiftleft", x, F.lit(n) - k))).bitwiseAND(F.lit(full))
    rotl = lambda x, k: (F.call_function("shiftleft", x, k).bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(n) - k))).bitwiseAND(F.lit(full))

    def step(acc: Column, bit: Column) -> Column:
        label = sum((F.call_function("shiftleft", F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)), F.lit(k)) for k, c in enumerate(cells)), F.lit(0))
        w = F.element_at(inverse, rotr(label.bitwiseXOR(acc["e"]), (acc["d"] + 1) % n) + 1)
        e = acc["e"].bitwiseXOR(rotl(F.element_at(entry, w + 1), (acc["d"] + 1) % n))
        return F.struct(e.alias("e"), ((acc["d"] + F.element_at(turn, w + 1) + 1) % n).alias("d"), (acc["h"] * 2**n + w).alias("h"))

    zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), zero, step, lambda acc: acc["h"])


def hilbert_shards(df: DataFrame, dims: list[str], shards: int, order: list[str], bits: int = 4) -> DataFrame:
    """Adds curve (Hilbert index), shard and slot (rank in its shard); shard sizes differ by one row at most.

    dims: columns of the curve; ``order``: columns that break ties inside a cell.
    The rows are read for the quantiles and for their place, and written once with it.
    """
    df = df.drop("curve", "shard", "slot")
    sub, rank, before = (shared.fresh_name(df, n) for n in ("_sub", "_rank", "_before"))
    total = df.count()
    subs = math.isqrt(total) + 1  # so neither a cell's sub-cells nor a sub-cell's rows grow faster than the root of all rows
    cells = quantise(df, {c: c for c in dims}, bits)
    names = [shared.fresh_name(df, f"_c{k}") for k in range(len(dims))]
    placed = df.withColumns(dict(zip(names, cells.values(), strict=True)))
    placed = placed.withColumn("curve", hilbert([F.col(n) for n in names], bits)).withColumn(sub, F.pmod(F.xxhash64(*order), F.lit(subs)))
    placed = shared.settle(placed.drop(*names), "curve")
    # prefix sums in three levels: runs of 256 cells, cells, sub-cells
    groups = shared.settle(placed.groupBy("curve", F.col(sub).alias("sub")).agg(F.count("*").alias("n")), "cells")
    by_cell = groups.groupBy("curve").agg(F.sum("n").alias("n")).withColumn("run", F.call_function("shiftright", F.col("curve"), F.lit(8)))
    by_run = by_cell.groupBy("run").agg(F.sum("n").alias("n"))
    up = lambda *keys: F.coalesce(F.sum("n").over((Window.partitionBy(*keys[:-1]) if keys[:-1] else Window).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_run = by_run.select("run", up("run").alias("b0"))  # 2 ** (dims * bits - 8) rows at most
    by_cell = by_cell.select("curve", "run", up("run", "curve").alias("b1")).join(by_run, "run").select("curve", (F.col("b0") + F.col("b1")).alias("b1"))
    groups = groups.select("curve", "sub", up("curve", "sub").alias("b2")).join(by_cell, "curve").select("curve", F.col("sub").alias(sub), (F.col("b1") + F.col("b2")).alias(before))
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy("curve", sub).orderBy(*order)) - 1)
    ranked = ranked.join(groups, ["curve", sub]).withColumn(rank, F.col(rank) + F.col(before))
    first = lambda s: F.call_function("div", s * total + (shards - 1), F.lit(shards))  # noqa: E731  least rank with rank * shards >= s * total
    ranked = ranked.withColumn("shard", F.call_function("div", F.col(rank) * shards, F.lit(max(total, 1))).cast("int"))
    return ranked.withColumn("slot", F.col(rank) - first(F.col("shard").cast("long"))).select(*df.columns, "curve", "shard", "slot")


def write_shards(placed: DataFrame, path: str, shards: int) -> None:
    """One folder a shard, rows in curve order, so that min/max statistics are narrow in every dimension."""
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    rows = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = shared.settle(rows, "metadata")  # the texts are read once
    out = hilbert_shards(rows, ["source", "lang", "size"], shards, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang")
