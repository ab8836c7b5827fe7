"""Chat formatting from reply trees, with DataFrame operations only.

Turns are nodes of a reply tree.  Root-to-leaf paths are enumerated by
iterative self-joins that double the distance to the ancestor each round, so
``log2(depth)`` joins suffice.  Paths are ranked by the mean score of their
nodes, and the chosen ones become one conversation each.

Template: ``### role: text</turn>`` and a newline per turn.  In roles and texts
``\\`` is written ``\\\\``, ``<`` as ``\\l``, ``#`` as ``\\h`` and ``:`` in roles as ``\\c``, so no
control string can occur inside them and reading back is exact.

A linear table of turns becomes a tree by ``linked``, in which every row is a
node: rows are numbered by turn, then role and text, null turns last.

Defined cases: null texts and roles are empty.  The rows without a conversation
id are one conversation.  A node whose parent is null or missing is a root.
Nodes on a cycle have no root and are left out.  In a tree, rows that repeat a
node's id keep the least (parent, role, text, score), as a child could not tell
them apart, and rows without a node id are left out.  An empty table gives no
rows.  Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

OPEN, CLOSE = "### ", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(c: Column) -> Column:
    """Inverse of escape: doubled backslashes are set aside first."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))), "\\")


def linked(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A linear table of turns as reply trees: each row answers the one before it."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long")
    rows = rows.withColumn("node", place)
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(nodes: DataFrame, most: int = 1) -> DataFrame:
    """Nodes of the ``most`` best paths of each conversation: conv, path (rank from 1), depth (from 0), role, text.

    nodes: conv, node, parent, score, role, text.  Ties go to the smaller leaf.
    """
    rows = nodes.where("node is not null").groupBy("conv", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("conv", "node", "m.*")
    nodes = shared.settle(rows.withColumn("id", F.monotonically_increasing_id()), "chat-nodes")  # from here on a node is one number
    above = nodes.select(F.col("conv").alias("_conv"), F.col("node").alias("_node"), F.col("id").alias("up"))
    answers = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("parent") == F.col("_node"))
    tree = shared.settle(nodes.select("conv", "node", "parent", "id", "score").join(above, answers, "left").select("conv", "node", "id", "up", F.coalesce("score", F.lit(0.0)).alias("score")), "chat-tree")

    # up: the ancestor 2 ** k steps above, null where the root is nearer; total: scores of the steps passed, own included.
    # A node leaves the rounds when it has reached its root, and stays only while one that still climbs looks it up.
    moved = tree.select("id", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    most_steps, jumps, roots, still = 2 * tree.count(), [], [moved.where("up is null")], None
    while True:
        climbing = moved.where("up is not null")
        left = climbing.agg(F.count("*"), F.max("steps")).first()
        if not left[0] or left[1] > most_steps:  # what still climbs then is on a cycle
            break
        jumps.append(climbing.select("id", "up"))
        there = moved.where("up is null") if still is None else moved.where("up is null").unionByName(still)
        asked = climbing.select(F.col("up").alias("id")).distinct()
        still = shared.settle(there.join(asked, "id", "left_semi"), "chat-roots")
        above = climbing.unionByName(still).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("total").alias("t2"))
        ahead = climbing.join(above, "up")
        moved = shared.settle(ahead.select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("total") + F.col("t2")).alias("total")), "chat-jumps")
        roots.append(moved.where("up is null"))
    reach = reduce(DataFrame.unionByName, roots).select("id", "steps", "total")
    inner = tree.where("up is not null").select(F.col("up").alias("id")).distinct()
    leaves = tree.select("conv", "node", "id").join(inner, "id", "left_anti").join(reach, "id")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy((F.col("total") / F.col("steps")).desc(), F.col("node")))
    marks = [shared.settle(leaves.withColumn("path", rank).where(F.col("path") <= most).select("path", "id", (F.col("steps") - 1).alias("depth")), "chat-marks")]
    for k in reversed(range(len(jumps))):  # a leaf's ancestors: each sum of powers of two above it once
        high = reduce(DataFrame.unionByName, marks).where(F.col("depth") >= 1 << k)
        marks.append(shared.settle(high.join(jumps[k], "id").select("path", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth")), "chat-marks"))
    path = reduce(DataFrame.unionByName, marks)
    return path.join(nodes.select("id", "conv", "role", "text"), "id").select("conv", "path", "depth", "role", "text")


def format_paths(path: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv, path, formatted, and loss: spans (start, end; code points, end exclusive) of the texts to train on, with their end marks left out."""
    path = path.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    turn = path.select("conv", "path", F.struct("depth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained).alias("on")).alias("t"))
    turns = turn.groupBy("conv", "path").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    walk = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(t["on"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).alias("start"), (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return turns.select("conv", "path", F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"), walk.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and masked (texts under the loss mask, in order), both from ``formatted`` and ``loss`` alone."""
    pieces = F.filter(F.split("formatted", CLOSE, -1), lambda p: p != "")
    cut = lambda p: F.instr(p, ": ")
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), F.instr(p, ": ") - 1 - len(OPEN))).alias("role"), unescape(F.substring(p, cut(p) + 2, F.length(p))).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "masked": masked})


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    made = F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for k, role in enumerate(("user", "assistant"))))
    extra = spark.range(1).select(F.inline(made))
    rows = shared.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    out = read_back(format_paths(chosen_paths(linked(rows))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    mask = F.array_join("masked", "")
    return out.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(mask).cast("long").alias("loss_chars"), F.sha2(mask, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, length(text) + len(regexp_extract_all(text, '[\\<#]')) + length(role) + len(regexp_extract_all(role, '[\\<#:]')) + 14 as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from e group by conv_id
"""
