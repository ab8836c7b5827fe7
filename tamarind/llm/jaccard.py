"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is cut into fragments.  A document is cut into the
pieces that fall into them; each fragment counts on its own, and the counts are
summed per document or per pair.  Two documents link when their n-gram sets
have a Jaccard similarity of ``percent`` hundredths or more.

1. The first quarter of the hash order is cut into fragments, which count the
   n-grams that only one document has.  A document with more of these than a
   partner could lack links with nothing; most documents end here, exactly.
   N-grams that several documents of a batch have are sent once, without them.
2. Documents with equal sets become one class.  The classes' whole sets are cut
   into fragments, which count each n-gram's document frequency from tallies of
   batches; n-grams of one class can't be shared and are left out.  Classes look
   their frequencies up in groups of bounded size: a fragment with a hot n-gram
   is dealt over several.  The same bound is applied again.
3. The global order is now rare n-grams first.  Classes that could link share
   an n-gram of their prefixes; length bounds use the n-grams left, and parity
   bits of the whole sets bound their symmetric difference from below.  A class
   first pairs with the most central class in any of its prefix n-grams; after
   the links found have been joined into components, only pairs of different
   components that share a prefix n-gram remain.
   No group is expanded into all pairs, and no link between components is lost.
4. Candidates are verified: of each pair the class with more pairs is the hub,
   and a hub's pairs are dealt by their other class into groups of bounded
   n-grams, which get the hub's set once each.  Fragments of a group's sets
   count partial overlaps separately, and the sums per pair decide exactly.

N-grams are compared by 64-bit hashes.

Defined cases: null and empty texts and texts without words have an empty set
and link with nothing; a text with fewer words than the shingle size is one
n-gram.  Every row is a document of its own and gets a row back, also where ids
are null, repeated or not integers; a component's id is the least one in it, and
null only where all its rows lack one.  An empty table gives no rows.  Only the
named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan, shared
from .components import components

FIRST = 4  # one in so many n-grams, by hash, is in the first fragments
FRAGMENTS = 12  # at least; a number that followed the cluster's settings would cut documents finer for nothing
FRAGMENT_BYTES = 24 << 20  # text for which there is one fragment in step 1
TALLY_GRAMS = 2_000_000  # n-grams that a task holds before it sends them to their fragments
CLASS_GRAMS = 1_000_000  # n-grams of classes for which there is one fragment in step 2
GROUP_GRAMS = 2_000_000  # n-grams of classes that look up their frequencies together
PIECE = 100_000  # n-grams of a hub's other classes in a group, and of a set in a fragment, in step 4
PARITY = 8  # words of 64 parity bits a class
RECENT = 48  # earlier prefix n-grams of a class that are looked at to emit a pair once


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def _fragments(hashes: np.ndarray, count: int, zone: int) -> np.ndarray:
    """Fragment of each hash: equal ranges of the first 1/zone of the hash order."""
    return ((hashes >> np.uint64(32)) * np.uint64(count * zone) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    edges = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(x) else []


def _flat(column, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column.to_pylist())])


def _lone(frame: pa.Table) -> pa.Table:
    """In one fragment: how many n-grams of each document no other document has; and the set sizes that were sent to it."""
    owners = [np.frombuffer(d, np.int64)[np.frombuffer(x, np.int32)] for d, x in zip(frame.column("docs").to_pylist(), frame.column("owners").to_pylist(), strict=True)]
    kinds, at, times = np.unique(_flat(frame.column("lone"), np.uint64), return_index=True, return_counts=True)
    many = np.unique(_flat(frame.column("many"), np.uint64))
    alone = times == 1
    if len(many):
        alone &= many[np.minimum(np.searchsorted(many, kinds), len(many) - 1)] != kinds
    docs, dead = np.unique(np.concatenate([np.zeros(0, np.int64), *owners])[at[alone]], return_counts=True)
    sized, n = _flat(frame.column("sized"), np.int64), _flat(frame.column("sizes"), np.int64)
    return pa.table({"doc": np.concatenate([docs, sized]), "n": pa.array(np.concatenate([np.zeros(len(docs), np.int64), n])), "dead": np.concatenate([dead.astype(np.int64), np.zeros(len(sized), np.int64)])})


def _first_fragments(size: int, count: int):
    none = np.zeros(0, np.int64)

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        """The n-grams held, by fragment: those that one document of them has with their owners, the others once and without."""
        h, owner, docs, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        kinds, at, times = np.unique(h, return_index=True, return_counts=True)
        owner, single, part = owner[at], times == 1, _fragments(kinds, count, FIRST)
        out: dict[str, list] = {k: [] for k in ("docs", "owners", "lone", "many", "sized", "sizes")}
        where = []
        for a, b in _runs(part):
            one = single[a:b]
            few, index = np.unique(owner[a:b][one], return_inverse=True)
            where.append(int(part[a]))
            for name, x in zip(out, (few, index.astype(np.int32), kinds[a:b][one], kinds[a:b][~one], none, none), strict=True):
                out[name].append(x)
        where.append(int(docs[0] % count))  # all sizes go together to any one
        for name, x in zip(out, (none, none, none, none, docs, n), strict=True):
            out[name].append(x)
        return _batch(fragment=pa.array(where, pa.int32()), **{k: _binary(x) for k, x in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, end, data, offsets in scan.slices(batch.column(1)):
                h, first = scan.shingles(scan.words(data, offsets), size)
                n = np.diff(first)
                keep = _fragments(h, count, FIRST) < count
                held.append((h[keep], np.repeat(ids[row:end], n)[keep], ids[row:end], n.astype(np.int64)))
                if sum(len(x[0]) for x in held) > TALLY_GRAMS:
                    yield sent(held)
            scan.release()
        if held:
            yield sent(held)

    return run


def _parity(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """PARITY words a set, with a bit for each bucket of hashes that holds an odd number of the set's n-grams.

    Each bit in which two sets differ stands for at least one n-gram that only one of them has.
    """
    bucket = (h >> np.uint64(6)) % np.uint64(PARITY)
    bit = np.uint64(1) << (h & np.uint64(63))
    out = []
    for k in range(PARITY):
        odd = np.zeros(len(h) + 1, np.uint64)
        np.bitwise_xor.accumulate(np.where(bucket == k, bit, np.uint64(0)), out=odd[1:])
        out.append((odd[first[1:]] ^ odd[first[:-1]]).view(np.int64))
    return list(np.stack(out, axis=1))


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in scan.slices(batch.column(1)):
                h, first = scan.shingles(scan.words(data, offsets), size)
                sets = [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield _batch(doc=batch.column(0).slice(row, end - row), n=pa.array(np.diff(first), pa.int64()), digest=pa.array([hashlib.sha256(x).digest() for x in sets], pa.binary()), odd=pa.array(_parity(h, first), pa.list_(pa.int64())), grams=pa.array(sets, pa.binary()))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's set in pieces, one a fragment of the hash order."""
    for batch in batches:
        docs = batch.column("doc").to_pylist()
        counts = batch.column("fragments").to_pylist()
        out: dict[str, list] = {k: [] for k in ("fragment", "doc", "grams")}
        for doc, raw, count in zip(docs, batch.column("grams").to_pylist(), counts, strict=True):
            h = np.frombuffer(raw, np.uint64)
            part = _fragments(h, count, 1)
            for a, b in _runs(part):
                out["fragment"].append(int(part[a]))
                out["doc"].append(doc)
                out["grams"].append(h[a:b])
        yield _batch(fragment=pa.array(out["fragment"], pa.int32()), doc=pa.array(out["doc"], pa.int64()), grams=_binary(out["grams"]))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fragment's n-grams in a batch, once each, with their number of classes."""
    for batch in batches:
        part = np.repeat(batch.column("fragment").to_numpy(), [len(x) // 8 for x in batch.column("grams").to_pylist()])
        h = _flat(batch.column("grams"), np.uint64)
        order = np.lexsort((h, part))
        h, part = h[order], part[order]
        new = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (part[1:] != part[:-1])]))
        times = np.diff(np.append(new, len(h)))
        h, part = h[new], part[new]
        runs = _runs(part)
        yield _batch(fragment=pa.array([part[a] for a, _ in runs], pa.int32()), grams=_binary([h[a:b] for a, b in runs]), times=_binary([times[a:b].astype(np.int64) for a, b in runs]))
        scan.release()


def _frequencies(frame: pa.Table) -> pa.Table:
    """In one fragment: the n-grams of more than one class with their frequencies, and over how many groups its classes are dealt."""
    kinds, of = np.unique(_flat(frame.column("grams"), np.uint64), return_inverse=True)
    times = np.bincount(of, _flat(frame.column("times"), np.int64), len(kinds)).astype(np.int64)
    more = times > 1
    return pa.table({"fragment": frame.column("fragment").slice(0, 1), "groups": pa.array([1 + int(times.sum()) // GROUP_GRAMS], pa.int32()), "grams": _binary([kinds[more]]), "dfs": _binary([np.minimum(times[more], 2**31 - 1).astype(np.int32)])})


def _shared(pieces: pa.Table, table: pa.Table) -> pa.Table:
    """In one group: each class's n-grams that another class has too, with their frequencies."""
    kinds, df = _flat(table.column("grams"), np.uint64), _flat(table.column("dfs"), np.int32)
    out: dict[str, list] = {"doc": [], "live": [], "grams": [], "dfs": []}
    for doc, raw in zip(pieces.column("doc").to_pylist(), pieces.column("grams").to_pylist(), strict=True) if len(kinds) else ():
        h = np.frombuffer(raw, np.uint64)
        at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
        live = kinds[at] == h
        if live.any():
            out["doc"].append(doc)
            out["live"].append(int(live.sum()))
            out["grams"].append(h[live])
            out["dfs"].append(df[at[live]])
    return pa.table({"doc": pa.array(out["doc"], pa.int64()), "live": pa.array(out["live"], pa.int64()), "grams": _binary(out["grams"]), "dfs": _binary(out["dfs"])})


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix n-grams of each class in the global order, rare ones first."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("gram", "doc", "n", "live", "at", "weight", "odd", "recent")}
        for doc, n, live, need, odd, grams, dfs in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "live", "need", "odd", "grams", "dfs")), strict=True):
            h, df = np.concatenate([np.frombuffer(x, np.uint64) for x in grams]), np.concatenate([np.frombuffer(x, np.int32) for x in dfs])
            order = np.lexsort((h, df))[: live - need + 1]
            prefix = h[order].view(np.int64).tolist()
            weight = float(df.sum()) / n  # n-grams that no other class has count as none
            for k, g in enumerate(prefix):
                out["gram"].append(g)
                out["recent"].append(prefix[max(0, k - RECENT) : k])
            m = len(prefix)
            for name, x in (("doc", [doc] * m), ("n", [n] * m), ("live", [live] * m), ("at", range(m)), ("weight", [weight] * m), ("odd", [odd] * m)):
                out[name].extend(x)
        yield _batch(**{k: pa.array(out[k], pa.int64()) for k in ("gram", "doc", "n", "live", "at")}, weight=pa.array(out["weight"], pa.float64()), odd=pa.array(out["odd"], pa.list_(pa.int64())), recent=pa.array(out["recent"], pa.list_(pa.int64())))


def _joined_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in parts])) for parts in batch.column("grams").to_pylist()]
        yield _batch(doc=batch.column("doc"), n=batch.column("n"), grams=_binary(sets))


def _overlaps(key, sets, pairs):
    """In one fragment of a group: the partial overlap of each candidate pair."""
    found = {d: np.frombuffer(x, np.uint64) for d, x in zip(sets.column("doc").to_pylist(), sets.column("grams").to_pylist(), strict=True)}
    columns = [pairs.column(c).to_pylist() for c in ("a", "b", "na", "nb")]
    empty = np.zeros(0, np.uint64)
    both = []
    last, kinds = None, empty
    for x, y, nx, ny in sorted(zip(*columns, strict=True)):
        if x != last:
            last, kinds = x, found.get(x, empty)
        other = found.get(y, empty)
        if len(kinds) and len(other):
            at = np.minimum(np.searchsorted(kinds, other), len(kinds) - 1)
            both.append((x, y, nx, ny, int((kinds[at] == other).sum())))
    made = zip(*both, strict=True) if both else ((),) * 5
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("a", "b", "na", "nb", "part"), made, strict=True)})


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b): fragments count partial overlaps, which are summed per pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("pairs"))
    nodes = shared.settle(ends.join(sets.select("doc", "n"), ends["node"] == F.col("doc")).select("node", "n", "pairs"), "nodes")
    # sets that could link have sizes within ``percent``, so a hub's size bounds those of its other classes
    total = nodes.agg(F.coalesce(F.sum(F.col("n") * F.col("pairs")), F.lit(0))).first()[0]
    groups = max(1, total // (16 * PIECE), shared.partitions(pairs.sparkSession))
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.struct("pairs", (-F.col("node")).alias("low"), "n").alias(f"rank_{c}"))
    sized = pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b")
    sized = sized.withColumn("hub", F.greatest("rank_a", "rank_b")).withColumn("other", F.when(F.col("hub.low") == -F.col("a"), F.col("b")).otherwise(F.col("a")))
    held = F.col("hub.pairs") * F.col("hub.n")
    bucket = F.pmod(F.xxhash64("other"), F.ceil(held / PIECE))
    large = (held > PIECE) | (F.col("hub.n") > PIECE)
    # small hubs share a group by hash
    group = F.when(large, F.xxhash64("hub.low", bucket)).otherwise(F.pmod(F.xxhash64("hub.low"), F.lit(groups)))
    asked = sized.select("a", "b", "na", "nb", group.alias("group"), F.greatest(F.lit(4), F.ceil(F.col("hub.n") / PIECE)).cast("int").alias("fragments"))
    asked = shared.settle(asked, "asked")
    sent = asked.select("group", "fragments", F.explode(F.array("a", "b")).alias("doc")).distinct()
    cut = sets.select("doc", "grams").join(sent, "doc")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, group = batch.column("doc"), batch.column("group")
            rows = _batch(doc=np.arange(batch.num_rows), fragments=batch.column("fragments"), grams=batch.column("grams"))
            for made in _cut(iter([rows])):
                at = made.column("doc")
                yield _batch(group=group.take(at), fragment=made.column("fragment"), doc=doc.take(at), grams=made.column("grams"))

    parts = _mapped(cut, pieces, "group long, fragment int, doc long, grams binary")
    asked = asked.select("group", F.explode(F.sequence(F.lit(0), F.col("fragments") - 1)).alias("fragment"), "a", "b", "na", "nb")
    counted = parts.groupBy("group", "fragment").cogroup(asked.groupBy("group", "fragment")).applyInArrow(_overlaps, "a long, b long, na long, nb long, part long")
    sums = counted.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return sums.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _feasible(x: str, y: str, percent: int, first: bool):
    """Whether the overlap a link needs is allowed by the n-grams left, by prefix places and by parity bits.

    With ``first``, no earlier n-gram that both have was seen among the recent ones.
    """
    lx, ly, nx, ny, ix, iy = (F.col(f"{s}.{c}") for c in ("live", "n", "at") for s in (x, y))
    earlier = F.least(ix, iy)
    if first:
        earlier = F.least(earlier, F.greatest(ix - RECENT, F.lit(0)) + F.greatest(iy - RECENT, F.lit(0)))
    best = F.least(lx, ly, earlier + F.least(lx - ix, ly - iy))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.odd")[k].bitwiseXOR(F.col(f"{y}.odd")[k])) for k in range(PARITY)])
    return ((100 + percent) * best >= percent * (nx + ny)) & ((100 + percent) * (nx + ny - apart) >= 2 * percent * (nx + ny))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links, itself included) of each row."""
    rows, back = shared.numbered(docs, doc_id, "doc", text)
    found = linked_rows(rows.select("doc", F.col(text).alias("text")), size, percent)
    out = shared.least_ids(found, back, "doc", "component", doc_id, "component_id")
    return out.select(F.col(doc_id).alias("doc_id"), "n_shingles", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, but of each component only the one of least number: the least id, where ids are unique integers."""
    number = shared.fresh_name(docs, "_node")
    rows, back = shared.numbered(docs, doc_id, number, *docs.columns)
    found = linked_rows(rows.select(F.col(number).alias("doc"), F.col(text).alias("text")), size, percent)
    gone = found.where("doc <> component").select(F.col("doc").alias(number))
    return rows.join(gone, number, "left_anti").select(*docs.columns)


def linked_rows(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n_shingles, component) of all rows (doc, text), whose numbers must be unique."""
    least = F.ceil(F.col("n") * percent / 100.0).cast("long")  # overlap that a link needs at least

    # 1: bounds from the first fragments
    count = max(FRAGMENTS, -(-shared.text_bytes(rows, "text") // FRAGMENT_BYTES))
    cut = _mapped(rows, _first_fragments(size, count), "fragment int, docs binary, owners binary, lone binary, many binary, sized binary, sizes binary")
    lone = cut.groupBy("fragment").applyInArrow(_lone, "doc long, n long, dead long")
    docs_n = shared.settle(lone.groupBy("doc").agg(F.max("n").alias("n"), F.sum("dead").alias("dead")), "bounds")
    maybe = docs_n.where((F.col("n") > 0) & (F.col("dead") <= F.col("n") - least)).select("doc")

    # 2: classes of equal sets, frequencies in all fragments
    sets = shared.settle(_mapped(rows.join(maybe.hint("merge"), "doc", "left_semi"), _sets(size), "doc long, n long, digest binary, odd array<long>, grams binary"), "sets").where("n > 0")
    classes = sets.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("m"))
    member = shared.settle(shared.join_counted(sets.select("doc", "digest", "n", "odd"), classes, "digest", "m").select("doc", "rep", "n", "odd"), "classes")
    reps = sets.join(member.where("doc = rep").select("doc"), "doc", "left_semi")
    pieces = max(FRAGMENTS, -(-(member.where("doc = rep").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // CLASS_GRAMS))
    cut = shared.settle(_mapped(reps.select("doc", "grams", F.lit(pieces).alias("fragments")), _cut, "fragment int, doc long, grams binary"), "pieces")
    counted = _mapped(cut, _tally, "fragment int, grams binary, times binary").groupBy("fragment").applyInArrow(_frequencies, "fragment int, groups int, grams binary, dfs binary")
    counted = shared.settle(counted, "frequencies")
    dealt = cut.join(counted.select("fragment", "groups"), "fragment").withColumn("group", F.pmod(F.xxhash64("doc"), F.col("groups")).cast("int"))
    tables = counted.select("fragment", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "grams", "dfs")
    live = dealt.select("fragment", "group", "doc", "grams").groupBy("fragment", "group").cogroup(tables.groupBy("fragment", "group")).applyInArrow(lambda x, y: _shared(x, y), "doc long, live long, grams binary, dfs binary")
    live = shared.settle(live, "live")
    shared.discard(cut)
    shared.discard(counted)
    sizes = member.where("doc = rep").select("doc", "n", "odd")
    kept = live.groupBy("doc").agg(F.sum("live").alias("live")).join(sizes, "doc").withColumn("need", least).where("live >= need")
    whole = live.drop("live").join(kept, "doc").groupBy("doc", "n", "live", "need", "odd").agg(F.collect_list("grams").alias("grams"), F.collect_list("dfs").alias("dfs"))

    # 3: candidates from prefixes
    prefix = shared.settle(_mapped(whole, _prefixes, "gram long, doc long, n long, live long, at long, weight double, odd array<long>, recent array<long>"), "prefixes")
    groups = prefix.groupBy("gram").agg(F.count("*").alias("m"), F.max(F.struct("weight", (-F.col("doc")).alias("low"), "doc", "n", "live", "at", "odd")).alias("hub")).where("m > 1")
    tagged = shared.join_counted(prefix, groups, "gram", "m")
    star = tagged.where("doc <> hub.doc").select(F.struct("doc", "n", "live", "at", "odd").alias("x"), F.col("hub").alias("y")).where(_feasible("x", "y", percent, False))
    star = star.groupBy("x.doc").agg(F.max(F.struct("y.weight", "y.low", "y.doc")).alias("y")).select(F.least("doc", "y.doc").alias("a"), F.greatest("doc", "y.doc").alias("b"))
    tried = shared.settle(star.distinct(), "pairs")
    grams = shared.settle(_mapped(whole.select("doc", "n", "grams"), _joined_sets, "doc long, n long, grams binary"), "class-sets")
    links = shared.settle(_verified(tried, grams, percent), "links")
    joined = shared.settle(components(links), "joined")
    labelled = tagged.drop("weight").join(joined, tagged["doc"] == joined["node"], "left").withColumn("comp", F.coalesce("component", "doc")).drop("node", "component")
    hubs = labelled.where("doc = hub.doc").select("gram", F.col("comp").alias("main"), "m")
    labelled = shared.join_counted(labelled.drop("hub", "m"), hubs, "gram", "m")
    apart = labelled.where("comp <> main")
    first = ~F.arrays_overlap("x.recent", "y.recent")
    rest = apart.alias("x").join(labelled.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.doc") < F.col("y.doc"))) & _feasible("x", "y", percent, True) & first)
    rest = rest.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = shared.settle(rest, "pairs")
    more = shared.settle(_verified(rest, grams, percent), "links")

    # components over classes, then over all documents
    same = member.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(more).unionByName(same))
    for made in (live, prefix, tried, grams, joined, rest, links, more, member):
        shared.discard(made)
    found = docs_n.select("doc", "n").join(found, docs_n["doc"] == found["node"], "left")
    return found.select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, size=4, percent=85)


SQL = r"""
with recursive
w as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
e as (select a, b from l union select b, a from l),
r(doc_id, c) as (select a, a from e union select e.b, r.c from r join e on r.doc_id = e.a where r.c < e.b),
m as (select doc_id, min(c) as c from r group by doc_id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) as component_id
from w left join n on w.doc_id = n.doc_id left join m on w.doc_id = m.doc_id
"""
