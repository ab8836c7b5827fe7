"""Embedding near-dedup by cover-tree dual traversal: exact threshold pairs.

Vectors of a label are unit-normalised, so cosine >= c is a distance of at most
``sqrt(2 - 2c)``.  Equal vectors are first collapsed to one with a multiplicity.

The upper levels of the tree are tables.  A cell of more than ``BLOCK`` vectors
gets centres, a few chosen by hash, and its vectors go to the nearest one, dealt
over tasks of bounded size; this repeats until all cells are small.  The dual
traversal of these levels is a join: pairs of cells go down together to their
children and stay while the distance of their centres is within the threshold
plus both covering radii.  Each small cell then gets one cover tree, nested
levels with halving radii, and each pair of cells that is left meets in a task,
where pairs of nodes go down by the same bound.  What reaches single vectors is
decided by the cosine in double precision.

Links are never expanded into rows: a task sums each vector's links and sends
what joins its vectors into components.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label, link with nothing.  Vectors of
different length are not compared.  Every row is a vector of its own and gets a
row back, also where ids are null, repeated or not integers; a component's id is
the least one in it.  Vectors are scaled by powers of two, so that no finite
one over- or underflows.  An empty table gives no rows.  Only the named columns
are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import components

LEAST = 0.98
BLOCK = 2048  # vectors of a cell that is not divided
FEW, FAN = 8, 64  # centres of a divided cell, expected
DEALT = 16384  # vectors that look for their centre together
ROUNDS = 16  # after which cells that centres did not divide are cut by hash
LEAF = 16  # points of a node that is not divided
LEVELS = 40  # halvings of the radius below 2
NEAR = 1e-7  # by which bounds are widened against rounding


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length from a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is about 1."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])


def unit(raw: np.ndarray) -> np.ndarray:
    raw = scaled(raw)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


class Tree:
    """Cover tree of unit vectors: nodes in flat arrays, a node's points side by side in ``order``.

    Node k has the point ``centre[k]``, covers its points within ``radius[k]``,
    and has children ``down[k]`` to ``upto[k]``, none if it is a leaf.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        order = np.arange(len(points))
        centre, radius, down, upto, begin, end = [0], [0.0], [0], [0], [0], [len(points)]
        radius[0] = float(np.sqrt(self._squares(0, order).max())) if len(points) else 0.0
        level, first = 1, 0
        while first < len(centre) and level <= LEVELS:
            last, reach = len(centre), 2.0 ** (1 - level)
            for k in range(first, last):
                if end[k] - begin[k] <= LEAF or radius[k] <= 0:
                    continue
                down[k] = len(centre)
                mine = order[begin[k] : end[k]]
                square = np.maximum(2.0 - 2.0 * (points[mine] @ points[mine].T), 0.0)
                near, free, at = square <= reach * reach, np.ones(len(mine), bool), int(np.flatnonzero(mine == centre[k])[0])
                pieces, place = [], begin[k]
                while at >= 0:  # nested: the node's own centre comes first and stays one
                    got = np.flatnonzero(near[at] & free)
                    got = got if free[at] and len(got) else np.array([at])
                    free[got] = False
                    for names, x in ((centre, int(mine[at])), (radius, float(np.sqrt(square[at, got].max()))), (down, 0), (upto, 0), (begin, place), (end, place + len(got))):
                        names.append(x)
                    pieces.append(mine[got])
                    place += len(got)
                    at = int(free.argmax()) if free.any() else -1
                upto[k] = len(centre)
                order[begin[k] : end[k]] = np.concatenate(pieces)
            first, level = last, level + 1
        self.order, self.centre, self.radius = order, np.array(centre), np.array(radius) + NEAR
        self.down, self.upto, self.begin, self.end = (np.array(x) for x in (down, upto, begin, end))

    def _squares(self, centre: int, to: np.ndarray) -> np.ndarray:
        return np.maximum(2.0 - 2.0 * (self.points[to] @ self.points[centre]), 0.0)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last child of nodes; a leaf is its own child."""
        leaf = self.upto[node] == 0
        return np.where(leaf, node, self.down[node]), np.where(leaf, node + 1, self.upto[node])


def _product(xa: np.ndarray, xb: np.ndarray, ya: np.ndarray, yb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of the ranges xa..xb and ya..yb of each row, and the row."""
    n, m = xb - xa, yb - ya
    owner = np.repeat(np.arange(len(n)), n * m)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    return xa[owner] + k // m[owner], ya[owner] + k % m[owner], owner


def dual(a: Tree, b: Tree, reach: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of point pairs that no bound rules out; with ``same`` the trees are one and each pair comes once."""
    stack = [(np.array([0]), np.array([0]))]
    while stack:
        x, y = stack.pop()
        done = (a.upto[x] == 0) & (b.upto[y] == 0)
        if done.any():
            i, j, owner = _product(a.begin[x[done]], a.end[x[done]], b.begin[y[done]], b.end[y[done]])
            once = ~(same & (x[done] == y[done])[owner]) | (i < j)
            yield a.order[i[once]], b.order[j[once]]
            x, y = x[~done], y[~done]
        if not len(x):
            continue
        (xa, xb), (ya, yb) = a.children(x), b.children(y)
        many = (xb - xa) * (yb - ya) > 256
        kept = []
        i, j, owner = _product(xa[~many], xb[~many], ya[~many], yb[~many])
        apart = np.linalg.norm(a.points[a.centre[i]] - b.points[b.centre[j]], axis=1)
        ok = apart <= reach + a.radius[i] + b.radius[j]
        if same:
            ok &= (x[~many] != y[~many])[owner] | (i <= j)
        kept.append((i[ok], j[ok]))
        for k in np.flatnonzero(many).tolist():  # all children against all children at once
            for s in range(xa[k], xb[k], 1024):
                u, v = np.arange(s, min(s + 1024, xb[k])), np.arange(ya[k], yb[k])
                limit = reach + a.radius[u][:, None] + b.radius[v][None]
                ok = 2.0 - 2.0 * (a.points[a.centre[u]] @ b.points[b.centre[v]].T) <= limit * limit
                if same and x[k] == y[k]:
                    ok &= u[:, None] <= v[None]
                i, j = np.nonzero(ok)
                kept.append((u[i], v[j]))
        i, j = (np.concatenate(part) for part in zip(*kept, strict=True))
        for s in range(0, len(i), 2048):
            stack.append((i[s : s + 2048], j[s : s + 2048]))


def _united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label``, the least number of each part so far, after joining x and y of each pair."""
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            return label
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != label[label]).any():
            label = label[label]


def _plant(frame: pa.Table) -> pa.Table:
    """The cover tree of a cell, with the vectors' numbers and multiplicities."""
    raw = scaled(matrix(frame.column("v")))
    tree = Tree(raw / np.sqrt((raw * raw).sum(1, keepdims=True)))
    made = pickle.dumps((tree, raw, frame.column("rep").to_numpy(), frame.column("times").to_numpy()), 5)
    return pa.table({"cell": frame.column("cell").slice(0, 1), "tree": pa.array([made], pa.binary())})


def _meet(least: float):
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))

    def run(frame: pa.Table) -> pa.Table:
        trees = [pickle.loads(x) for x in frame.column("tree").to_pylist()]
        same = len(trees) == 1
        (a, raw_a, ids_a, times_a), (b, raw_b, ids_b, times_b) = trees[0], trees[-1]
        shift = 0 if same else len(ids_a)
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        norm_a, norm_b = (np.sqrt((x * x).sum(1)) for x in (raw_a, raw_b))
        degree, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in dual(a, b, reach, same):
            for s in range(0, len(i), 65536):
                x, y = i[s : s + 65536], j[s : s + 65536]
                ok = np.einsum("ij,ij->i", raw_a[x], raw_b[y]) / (norm_a[x] * norm_b[y]) >= least
                x, y = x[ok], y[ok]
                degree += np.bincount(x, times_b[y], len(ids)).astype(np.int64) + np.bincount(y + shift, times_a[x], len(ids)).astype(np.int64)
                label = _united(label, x, y + shift)
        some, joined = np.flatnonzero(degree), np.flatnonzero(label != np.arange(len(ids)))
        first, second = np.concatenate([ids[some], ids[joined]]), np.concatenate([np.full(len(some), -1), ids[label[joined]]]).astype(np.int64)
        links = np.concatenate([degree[some], np.zeros(len(joined), np.int64)])
        return pa.table({"a": first, "b": second, "links": links, "edge": np.arange(len(first)) >= len(some)})

    return run


def _nearest(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Members of a cell with the number and distance of the nearest of its centres."""
    v, c = unit(matrix(rows.column("v"))), unit(matrix(centres.column("v")))
    square = np.maximum(2.0 - 2.0 * (v @ c.T), 0.0)
    child = square.argmin(1)
    far = np.linalg.norm(v - c[child], axis=1)
    return pa.table({"parent": rows.column("cell"), "child": centres.column("child").to_numpy()[child], "far": far, "v": rows.column("v"), "rep": rows.column("rep"), "times": rows.column("times")})


def _divided(rows: DataFrame, sizes: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Members (cell, v, rep, times) of cells that are too large, in children; and these: parent, cell, centre, radius."""
    large = sizes.where(F.col("n") > BLOCK)
    members = rows.join(large, "cell")
    wanted = F.least(F.greatest(2 * F.col("n") / BLOCK, F.lit(FEW)), F.lit(FAN))
    chosen = members.where(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 40)) < wanted / F.col("n") * (1 << 40))
    centres = shared.settle(chosen.select("cell", F.col("rep").alias("child"), "v"), "centres")
    found = centres.select("cell").distinct()  # a cell without a centre waits for the next round
    groups = F.ceil(F.col("n") / DEALT)
    dealt = members.join(found, "cell", "left_semi").withColumn("group", F.pmod(F.xxhash64(F.lit(3), "rep"), groups)).select("cell", "group", "v", "rep", "times")
    spread = centres.join(large, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("group"), "child", "v")
    made = dealt.groupBy("cell", "group").cogroup(spread.groupBy("cell", "group")).applyInArrow(lambda x, y: _nearest(x, y), "parent string, child long, far double, v array<double>, rep long, times long")
    name = F.concat_ws("/", "parent", F.col("child").cast("string"))
    made = shared.settle(made.withColumn("cell", name), "cells")
    kids = made.groupBy("parent", "child", "cell").agg(F.max("far").alias("radius")).join(centres.select(F.col("cell").alias("parent"), "child", F.col("v").alias("centre")), ["parent", "child"])
    return made.select("cell", "v", "rep", "times"), shared.settle(kids.select("parent", "cell", "centre", "radius"), "levels")


def _cut(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that centres did not divide, cut by hash; their pieces all meet."""
    large = sizes.where(F.col("n") > BLOCK).withColumn("cuts", F.ceil(F.col("n") / BLOCK))
    made = rows.join(large, "cell").withColumn("parent", F.col("cell")).withColumn("cell", F.concat_ws("#", "parent", F.pmod(F.xxhash64(F.lit(9), "rep"), "cuts").cast("string")))
    made = shared.settle(made.select("parent", "cell", "v", "rep", "times"), "cells")
    kids = made.select("parent", "cell").distinct().select("parent", "cell", F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("double").alias("radius"))
    return made.drop("parent"), kids


def _descended(pairs: DataFrame, kids: DataFrame, reach: float) -> DataFrame:
    """Pairs of cells (a, b and their centres and radii) with both sides a level down, as far as the covering radii allow a link."""
    for side in ("a", "b"):
        below = kids.select(F.col("parent").alias("_p"), F.col("cell").alias("_cell"), F.col("centre").alias("_centre"), F.col("radius").alias("_radius"))
        pairs = pairs.withColumn("_one", F.col("a") == F.col("b") if side == "a" else F.col("_one")).join(below, F.col(side) == F.col("_p"), "left")
        pairs = pairs.withColumns({f"c{side}": F.when(F.col("_p").isNull(), F.col(f"c{side}")).otherwise(F.col("_centre")), f"r{side}": F.when(F.col("_p").isNull(), F.col(f"r{side}")).otherwise(F.col("_radius")), side: F.coalesce("_cell", side)}).drop("_p", "_cell", "_centre", "_radius")
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    direction = lambda c: F.transform(c, lambda x: x / F.array_max(F.transform(c, lambda y: F.abs(y))))
    pairs = pairs.where(~F.col("_one") | (F.col("a") <= F.col("b"))).drop("_one")
    u, v = direction(F.col("ca")), direction(F.col("cb"))
    dot = F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot / F.sqrt(norm(u) * norm(v))))
    return pairs.where((F.col("a") == F.col("b")) | F.coalesce(apart <= reach + F.col("ra") + F.col("rb") + NEAR, F.lit(True)))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (least id reachable by links) and kept (the row is its component's first)."""
    rows, back = shared.numbered(vectors, vec_id, "node", *dict.fromkeys([embedding, label]))
    rows = rows.select("node", F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    good = good.withColumn("part", F.concat_ws(":", F.size("v").cast("string"), "label"))
    # equal vectors: one representative and its multiplicity
    classes = shared.settle(good.groupBy("part", "v").agg(F.min("node").alias("rep"), F.count("*").alias("times")), "vectors")
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))

    # the upper levels
    left, small = classes.select(F.col("part").alias("cell"), "v", "rep", "times"), []
    no_centre, no_radius = F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    roots = left.select(F.col("cell").alias("a")).distinct()
    pairs = roots.select("a", no_centre.alias("ca"), no_radius.alias("ra"), F.col("a").alias("b"), no_centre.alias("cb"), no_radius.alias("rb"))
    for seed in range(ROUNDS + 1):
        sizes = shared.settle(left.groupBy("cell").agg(F.count("*").alias("n")), "sizes")
        small.append(left.join(sizes.where(F.col("n") <= BLOCK), "cell", "left_semi"))
        if sizes.where(F.col("n") > BLOCK).isEmpty():
            break
        done, kids = _divided(left, sizes, seed) if seed < ROUNDS else _cut(left, sizes)
        divided = kids.select(F.col("parent").alias("cell")).distinct()
        waiting = left.join(sizes.where(F.col("n") > BLOCK), "cell", "left_semi").join(divided, "cell", "left_anti")
        left = done.unionByName(waiting)
        pairs = shared.settle(_descended(pairs, kids, reach), "pairs")
    else:
        small.append(left)
    placed = small[0]
    for more in small[1:]:
        placed = placed.unionByName(more)

    # meetings of small cells
    trees = shared.settle(placed.groupBy("cell").applyInArrow(_plant, "cell string, tree binary"), "trees")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("cell"))
    meeting = sides.join(trees, "cell")
    made = shared.settle(meeting.select("a", "b", "tree").groupBy("a", "b").applyInArrow(_meet(least), "a long, b long, links long, edge boolean"), "meetings")
    shared.discard(trees)

    # back to all rows: links to the other copies, and to what the copies' representative has
    links = made.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    repeated = classes.where("times > 1").select(F.struct("part", "v").alias("key"), "rep", "times")
    keyed = good.select("node", F.struct("part", "v").alias("key"))
    copies = classes.where("times = 1").select(F.col("rep").alias("node"), "rep", "times").unionByName(shared.join_counted(keyed, repeated, "key", "times").select("node", "rep", "times"))
    copies = shared.settle(copies, "copies")
    # what the representative has is joined once a class, and its copies by count
    counted = copies.groupBy("rep").agg(F.count("*").alias("n")).join(links, "rep", "left")
    linked = shared.join_counted(copies, counted, "rep", "n").select("node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    edges = made.where("edge").select("a", "b").unionByName(copies.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")))
    found = components(edges)
    all_ = rows.select("node").join(linked, "node", "left").join(found, "node", "left")
    component = F.coalesce("component", "node")
    all_ = all_.select("node", component.alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("node") == component).alias("kept"))
    return shared.least_ids(all_, back, "node", "component", vec_id, "component_id").select(F.col(vec_id).alias("vec_id"), "n_links", "component_id", "kept")


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))


SQL = """
with recursive
v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
n as (select *, sqrt(list_sum([x * x for x in e])) as norm from v
      where label is not null and e is not null and len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0),
g as (select * from n where norm > 0 and isfinite(norm)),
l as (select x.vec_id as a, y.vec_id as b from g x join g y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id
      where list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
r(vec_id, c) as (select a, a from l union select l.b, r.c from r join l on r.vec_id = l.a where r.c < l.b),
m as (select vec_id, min(c) as c from r group by vec_id),
k as (select a, count(*) as n_links from l group by a)
select i.vec_id, coalesce(k.n_links, 0) as n_links, least(i.vec_id, coalesce(m.c, i.vec_id)) as component_id, i.vec_id = least(i.vec_id, coalesce(m.c, i.vec_id)) as kept
from (select distinct vec_id from embeddings where vec_id is not null) i left join k on k.a = i.vec_id left join m on m.vec_id = i.vec_id
"""
