"""Benchmark decontamination with training suffix arrays.

Each task takes slices of training documents as its shard, builds a suffix
array over their word sequence, and finds test suffixes in it by binary search.
The array orders whole suffixes, by doubling the compared length, so a test
suffix's neighbours in it give its longest verbatim match and the range that
begins with its window gives all places.

Only training suffixes that run through test vocabulary for a window's length
can begin with a test window, so only they are put in the array; and only test
windows whose hash occurs at such a suffix are searched.  Both leave out
nothing that could match, and the work follows the text and its matches, not
the product of texts and test set.  Occurrences are kept as distinct (document,
window) pairs and never paired with each other, so repetitive texts cost no more.

The test set is read in blocks of bounded size.  Each block is broadcast,
searched for in all documents, and destroyed before the next; where there are
several, the hits are written and joined back by the text's digest.

Defined cases: null and empty texts have no words and no matches.  An item
without words is never found; one of fewer than ``window`` words is one window.
A null item id is the empty string.  Repeated items count once by id; repeated
documents are judged alike.  With no items nothing is contaminated.  Columns of
the input pass through; those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan, shared

WINDOW = 13
BLOCK_BYTES = 16 << 20  # test text in one broadcast block; an item that is longer has a block of its own
RESULT = "n_words long, hits array<struct<start:long,end:long>>, matches array<struct<item_id:string,item_start:long,doc_start:long,length:long>>, n_hit long, item_ids array<string>"
KINDS = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string()))])
_MULT = np.uint64(0x9FB21C651E98DF25)


def _window_hashes(words: np.ndarray, at: np.ndarray, left: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the ascending lengths: which places of ``at`` have so many words left, and the hashes of these words."""
    h, on, done = np.zeros(len(at), np.uint64), np.arange(len(at)), 0
    for size in lengths:
        keep = left[on] >= size
        on, h = on[keep], h[keep]
        for k in range(done, size):
            h = scan.mix(h * _MULT + words[at[on] + k].astype(np.uint64))
        done = size
        yield size, on, scan.mix(h + np.uint64(size))


class Block:
    """Words of some items as numbers (0 after each), and their distinct windows with the items that have each."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        data, offsets = scan.buffers(texts)
        w = scan.words(data[offsets[0] : offsets[-1]], offsets - offsets[0], scan.WORD_CHARS)
        names, of = np.unique(np.array(ids, dtype=object), return_inverse=True) if ids else (np.zeros(0, object), np.zeros(0, np.int64))
        self.ids = names
        self.vocabulary, known = np.unique(w.hash, return_inverse=True)
        sizes = np.diff(w.first)
        doc = w.doc
        self.words = np.zeros(len(known) + len(sizes) + window, np.int32)
        self.words[np.arange(len(known)) + doc] = known + 1
        self.first = (w.first[:-1] + np.arange(len(sizes))).astype(np.int64)  # each row's first word
        self.row_item = of.astype(np.int32)
        left = w.first[1:][doc] - np.arange(len(known))
        at = np.flatnonzero(left >= np.minimum(sizes, window)[doc])
        base, length = at + doc[at], np.minimum(sizes, window)[doc[at]]
        self.lengths = np.unique(length).tolist()
        hashes = np.zeros(len(at), np.uint64)
        for size, on, h in _window_hashes(self.words, base, left[at], self.lengths):
            mine = length[on] == size
            hashes[on[mine]] = h[mine]
        self.hash, some, kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.base, self.length = base[some], length[some]  # a place of each distinct window
        item = self.row_item[doc[at]]
        order = np.lexsort((base, item, kind))  # each item's first place of a window, by window
        i, x = item[order], kind[order]
        new = np.ones(len(order), bool)
        new[1:] = (i[1:] != i[:-1]) | (x[1:] != x[:-1])
        self.places, self.upto = base[order[new]].astype(np.int64), np.searchsorted(x[new], np.arange(len(self.hash) + 1))

    def rows(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


def _suffix_array(seq: np.ndarray, starts: np.ndarray, run: np.ndarray) -> np.ndarray:
    """``starts`` in the order of their suffixes up to the next 0, by doubling the compared length; ``run`` is their length."""
    rank = np.zeros(len(seq) + 1, np.int64)
    kinds, of = np.unique(seq[starts], return_inverse=True)
    rank[starts] = of + 1
    size, longest, groups = 1, int(run.max()) if len(run) else 0, len(kinds)
    while size < longest and groups < len(starts):
        pair = rank[starts] * np.int64(len(starts) + 2) + rank[np.minimum(starts + size, len(seq))] * (run > size)
        kinds, of = np.unique(pair, return_inverse=True)
        rank[starts] = of + 1
        groups, size = len(kinds), size * 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _compare(seq: np.ndarray, at: np.ndarray, words: np.ndarray, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of (suffix of seq - query of ``length`` words), and how many words agree."""
    same, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
    open_ = np.flatnonzero(length > 0)
    while len(open_):
        a, b = seq[np.minimum(at[open_] + same[open_], len(seq) - 1)], words[np.minimum(query[open_] + same[open_], len(words) - 1)]
        differ = (a != b) | (a == 0)
        sign[open_[differ]] = np.sign(a[differ] - b[differ])
        open_ = open_[~differ]
        same[open_] += 1
        open_ = open_[same[open_] < length[open_]]
    return sign, same


def _bound(seq: np.ndarray, array: np.ndarray, words: np.ndarray, query: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """Binary searches, all at once: the first suffix not below each query, or the first above all that begin with it."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(array), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        sign, _ = _compare(seq, array[mid], words, query[open_], length[open_])
        right = sign <= 0 if upper else sign < 0
        lo[open_[right]], hi[open_[~right]] = mid[right] + 1, mid[~right]
    return lo


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All k with first <= k < last of each row, and the row's number."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[owner], owner


def _search(w: scan.Words, block: Block) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """Occurrences (word, words covered), and for each document and item with one: (document, item, item's word, document's word, length) of a longest match.

    A match begins with a window.  The document's first occurrence of each
    window meets the item's first place of it; of pairs that follow each other
    only the first is extended.  So matches are the longest where neither text
    nor item repeats the window, and else the longest of those from first places.
    """
    none = np.zeros(0, np.int64)
    nothing = (none, none), (none, none, none, none, none)
    if not len(block.hash) or not len(w.hash):
        return nothing
    at = np.minimum(np.searchsorted(block.vocabulary, w.hash), len(block.vocabulary) - 1)
    ids = np.where(block.vocabulary[at] == w.hash, at + 1, 0).astype(np.int32)
    doc = w.doc
    seq = np.zeros(len(ids) + len(w.first), np.int32)  # a 0 after each document
    seq[np.arange(len(ids)) + doc] = ids
    stop, starts = np.flatnonzero(seq == 0), np.flatnonzero(seq)
    which = np.searchsorted(stop, starts)
    run = stop[which] - starts
    # windows that may occur: those whose hash a training suffix begins with
    there, held = np.zeros(len(block.hash), bool), np.zeros(len(stop), bool)
    for size, on, h in _window_hashes(seq, starts, run, block.lengths):
        k = np.minimum(np.searchsorted(block.hash, h), len(block.hash) - 1)
        hit = (block.hash[k] == h) & (block.length[k] == size)
        there[k[hit]] = True
        held[which[on[hit]]] = True
    asked = np.flatnonzero(there)
    if not len(asked):
        return nothing
    starts, run = starts[held[which]], run[held[which]]  # runs of test words with a window in them, whole
    array = _suffix_array(seq, starts, run)
    query, length = block.base[asked], block.length[asked]
    lo, hi = (_bound(seq, array, block.words, query, length, upper) for upper in (False, True))
    k, of = _spread(lo, hi)
    place, window = array[k], asked[of]
    owner = np.searchsorted(w.first[1:] + np.arange(len(w.first) - 1), place, "left")
    covered = block.length[window]
    # one occurrence of a window in each document, the first one, stands for all of them
    order = np.lexsort((place, window, owner))
    o, x = owner[order], window[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    one = order[new]
    item_row, pair = _spread(block.upto[window[one]], block.upto[window[one] + 1])
    start = block.places[item_row]
    row = block.rows(start)
    p, d = place[one][pair], owner[one][pair]
    item = block.row_item[row]
    # a pair whose words before agree, and whose pair before is kept as well, continues a match that is found from there
    begin = np.flatnonzero(~_continued(p, start))
    p, d, item, start, row = p[begin], d[begin], item[begin], start[begin], row[begin]
    _, size = _compare(seq, p, block.words, start, np.full(len(p), len(seq) + len(block.words), np.int64))
    best = np.lexsort((p, start, -size, item, d))
    new = np.ones(len(best), bool)
    new[1:] = (d[best][1:] != d[best][:-1]) | (item[best][1:] != item[best][:-1])
    best = best[new]
    first_word = w.first[:-1]
    return (place - owner, covered), (d[best], item[best], start[best] - block.first[row[best]], p[best] - d[best] - first_word[d[best]], size[best])


def _continued(p: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether (p - 1, start - 1) is among the pairs too: then the match from there includes this one's."""
    if not len(p):
        return np.zeros(0, bool)
    width = np.int64(start.max() + 2)
    key = p * width + start
    known = np.sort(key)
    before = key - width - 1
    at = np.minimum(np.searchsorted(known, before), len(known) - 1)
    return known[at] == before


def _judge(text: pa.Array, block: Block | None, given: list | None = None) -> dict[str, list]:
    """The results of a batch for one block, or with ``given`` those that blocks gave before."""
    out: dict[str, list] = {f.name: [] for f in KINDS}
    for row, end, data, offsets in scan.slices(text):
        w = scan.words(data, offsets, scan.WORD_CHARS)
        if given is None:
            (word, covered), found = _search(w, block)
            edge = np.bincount(word, minlength=len(w.hash) + 1) - np.bincount(word + covered, minlength=len(w.hash) + 1)
            hit = np.cumsum(edge[:-1]) > 0
            many: list[list[dict]] = [[] for _ in range(end - row)]
            for d, i, s, p, n in zip(*(x.tolist() for x in found), strict=True):
                many[d].append({"item_id": block.ids[i], "item_start": s, "doc_start": p, "length": n})
        else:
            hit, many = np.zeros(len(w.hash), bool), []
            for d in range(end - row):
                spans, matches = given[row + d] or ((), ())
                for span in spans:
                    hit[w.first[d] + span["start"] : w.first[d] + span["end"]] = True
                best: dict[str, dict] = {}  # of an item whose rows are in several blocks
                for m in matches:
                    if m["item_id"] not in best or m["length"] > best[m["item_id"]]["length"]:
                        best[m["item_id"]] = m
                many.append(list(best.values()))
        sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
        n_hit = sums[w.first[1:]] - sums[w.first[:-1]]
        for d, matches in enumerate(many):
            a, b = w.first[d], w.first[d + 1]
            spans = []
            if n_hit[d]:
                x = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(x == 1), np.flatnonzero(x == -1), strict=True)]
            matches.sort(key=lambda m: m["item_id"])
            for name, x in zip(out, (int(b - a), spans, matches, int(n_hit[d]), [m["item_id"] for m in matches]), strict=True):
                out[name].append(x)
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, hits (word spans inside test windows), matches (a longest one for each item, with its places), n_hit and item_ids to ``docs``."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    count = max(1, -(-shared.text_bytes(items, "t") // BLOCK_BYTES))
    result = T.StructType.fromDDL(RESULT)
    docs = docs.drop(*result.names)
    schema = T.StructType([*docs.schema.fields, *result.fields])

    def block(k: int):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).toArrow()
        return spark.sparkContext.broadcast(Block(rows.column("i").to_pylist(), rows.column("t").combine_chunks(), window))

    def searched(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = _judge(batch.column(batch.schema.get_field_index(text)), sent.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[f.name], f.type) for f in KINDS)], names=[*batch.schema.names, *KINDS.names])
                scan.release()

        return run

    if count == 1:
        return docs.mapInArrow(searched(block(0)), schema)
    # several blocks: one pass each over the texts, of which only those that are hit are written
    found, digest = [], F.sha2(F.col(text).cast("binary"), 256)
    only = T.StructType([T.StructField(text, docs.schema[text].dataType), *result.fields])
    for k in range(count):
        sent = block(k)
        hits = docs.select(text).mapInArrow(searched(sent), only).where("n_hit > 0").select(digest.alias("digest"), "hits", "matches")
        found.append(shared.settle(hits.dropDuplicates(["digest"]), "hits"))
        sent.destroy()
    merged = reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))
    names = [shared.fresh_name(docs, n) for n in ("_digest", "_hits", "_matches")]
    columns = docs.columns
    joined = docs.withColumn(names[0], digest).join(merged.toDF(*names), names[0], "left").drop(names[0])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, matches = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names[1:])
            made = _judge(batch.column(batch.schema.get_field_index(text)), None, [None if h is None else (h, m) for h, m in zip(hits, matches, strict=True)])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[f.name], f.type) for f in KINDS)], names=[*columns, *KINDS.names])

    return joined.mapInArrow(united, schema)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **named) -> DataFrame:
    """``docs`` without those of whose words a twentieth or more lie in test windows."""
    return find_matches(docs, benchmark, **named).where(~contaminated()).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_matches(docs, shared.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("item_ids"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as k from (select item, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select doc_id, i, dw.n, item from dw join bw on dw.k = bw.k and dw.n = bw.n),
h as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h on d.doc_id = h.doc_id left join t on d.doc_id = t.doc_id
"""
