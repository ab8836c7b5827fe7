"""Line dedup over overlapping three-line windows, with DataFrame operations only.

A document's lines are the pieces of its text between newlines.  Every three
consecutive lines form a window; a window that occurs more than once in the
corpus keeps its first occurrence, in order of (id, text, line number), and all
lines that a later occurrence covers are removed, overlapping ones once.

Windows are compared by two independent 64-bit hashes.  They are counted with
partial aggregation, so a passage in a third of all documents costs one row a
task; only windows that do repeat are joined back, hot ones by a broadcast of at
most a thousand.

Defined cases: documents of fewer than three lines, empty and null texts are
left as they are.  Repeated rows with the same id and text count as one
document and are cut alike.  A text whose lines all go becomes the empty
string.  Other columns pass through, whatever their names; those named like an
output are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW = 3


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the deduplicated text, n_lines, and removed (numbers of removed lines, from 0, ascending)."""
    docs = docs.drop("n_lines", "removed")
    t, all_, gone, kept, id2, t2 = (shared.fresh_name(docs, n) for n in ("_t", "_lines", "_gone", "_kept", "_id", "_t2"))
    keyed = docs.withColumns({t: F.xxhash64(F.col(text)), all_: F.split(F.col(text), "\n", -1)})
    at = F.sequence(F.lit(1), F.size(all_) - (window - 1))
    lines = [lambda i, k=k: F.element_at(all_, i + k) for k in range(window)]
    pair = lambda i: F.struct(F.xxhash64(*(f(i) for f in lines)).alias("h1"), F.xxhash64(F.lit(7), *(f(i) for f in lines)).alias("h2"))
    windows = keyed.where(F.size(all_) >= window).select(F.col(doc_id).alias("id"), F.col(t).alias("t"), F.posexplode(F.transform(at, pair)).alias("at", "w"))
    place = F.struct("id", "t", "at")
    seen = windows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")
    later = shared.join_counted(windows, seen, "w", "n").where(place != F.col("first"))
    covered = later.select("id", "t", F.explode(F.sequence(F.col("at"), F.col("at") + (window - 1))).alias("n"))
    covered = covered.groupBy(F.col("id").alias(id2), F.col("t").alias(t2)).agg(F.sort_array(F.collect_set("n")).alias("removed"))
    joined = keyed.join(covered, keyed[doc_id].eqNullSafe(F.col(id2)) & (F.col(t) == F.col(t2)), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = joined.withColumn(gone, F.map_from_arrays(F.col("removed"), F.col("removed")))
    left = F.filter(all_, lambda line, i: ~F.map_contains_key(gone, i))
    out = out.withColumn(kept, F.when(F.col("removed").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    out = out.withColumns({text: F.col(kept), "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(all_)), "removed": removed})
    return out.select(*docs.columns, "n_lines", "removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


SQL = """
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, text, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] as k from (select doc_id, text, l, unnest(range(1, len(l) - 1)) as i from d where len(l) >= 3)),
f as (select *, row_number() over (partition by k order by doc_id, i) as r from w),
c as (select distinct doc_id, i + j as n from f, (values (0), (1), (2)) as o(j) where r > 1),
x as (select doc_id, list(n) as gone from c group by doc_id),
k as (select d.doc_id, d.text as old, len(d.l) as n_lines, coalesce(len(x.gone), 0) as n_removed,
  case when x.gone is null then d.text else coalesce((select string_agg(d.l[p], chr(10) order by p) from (select unnest(range(1, len(d.l) + 1)) as p) where not list_contains(x.gone, p)), '') end as text
  from d left join x on d.doc_id = x.doc_id)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(n_removed as bigint) as n_removed, md5(text) as text_md5, cast(length(text) as bigint) as n_chars from k
"""
