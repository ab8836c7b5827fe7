"""Packing of documents into sequences by bounded-space online best fit.

Each partition keeps a fixed number of open windows.  A document's tokens, with
the end mark, are cut at the window size; the rest goes whole into the window
it fits best.  If none has room, the fullest window is emitted; if more than
``SLACK`` places of it are free, the piece is cut to fill it first.  When a
partition ends, its open windows are leftovers.  Leftovers of up to ``FAN``
partitions are packed again by one task, level by level, until one task is
left, which fills windows to the last place.

Tokens come from a tokenizer file of the ``tokenizers`` library that lower-cases
and drops white space.  Its words never span white space, so each distinct word
is encoded once and its ids are reused.  A task's memory of words is bounded by
their number and by the bytes of their ids, keyed by 64-bit hashes, and dropped
with the task; unknown words are encoded a few thousand at a time.

Defined cases: a null or empty text is its end mark alone.  Repeated rows are
packed one by one.  No documents, no sequences.  Very long texts are cut into
full windows.  Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan, shared

SIZE = 4096
OPEN = 64  # windows a partition keeps open
SLACK = 32
FAN = 64
END = 2
MEMORY_WORDS = 500_000
MEMORY_IDS = 4_000_000  # ids of remembered words
ENCODE_WORDS, ENCODE_BYTES = 4096, 1 << 18  # that one call of the tokenizer gets
_TOKENIZERS: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of white-space-separated words, remembered by hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = Tokenizer.from_file(path)
        self.tokenizer = _TOKENIZERS[path]
        self.forget()

    def forget(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def learn(self, w: scan.Words, fresh: np.ndarray, hashes: np.ndarray) -> None:
        """fresh: numbers of words to encode."""
        start, end = w.start[fresh], w.end[fresh]
        part = np.maximum(np.arange(len(fresh)) // ENCODE_WORDS, np.cumsum(end - start) // ENCODE_BYTES)
        counts, flats = [self.count], [self.ids]
        for at in np.split(np.arange(len(fresh)), np.flatnonzero(np.diff(part)) + 1) if len(fresh) else ():
            made = self.tokenizer.encode_batch_fast([w.data[a:b].tobytes().decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], add_special_tokens=False)
            parts = [x.ids for x in made]
            counts.append(np.fromiter(map(len, parts), np.int32, len(parts)))
            flats.append(np.fromiter(chain.from_iterable(parts), np.uint32, int(counts[-1].sum())))
        self.ids, count, known = np.concatenate(flats), np.concatenate(counts), np.concatenate([self.known, hashes])
        at = np.concatenate([self.at, len(self.ids) - np.cumsum(count[len(self.at) :][::-1], dtype=np.int64)[::-1]])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.count = known[order], at[order], count[order]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        return k, self.known[k] == h if len(self.known) else np.zeros(len(h), bool)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> scan.Words:
        """Words with fewer forms, by steps of the tokenizer that don't depend on the rest of a word.

        A capital is lower-cased unless a mark may follow it, with which it
        would first be composed.  A full stop or comma that ends a word after
        an ASCII letter is always a piece of its own.
        """
        after = np.append(data[1:], np.uint8(32))
        after[offsets[1:-1][offsets[1:-1] > 0] - 1] = 32
        before = np.concatenate([np.zeros(1, np.uint8), data[:-1]]) if len(data) else data
        before[offsets[:-1][offsets[:-1] < len(data)]] = 0
        letter = scan.LOWER[before]
        cut = ((data == 44) | (data == 46)) & ~scan.NOT_SPACE[after[: len(data)]] & (letter >= 97) & (letter <= 122)
        if b"<|" not in data.tobytes():  # a special token's text must not appear by lower-casing
            data = data + ((data >= 65) & (data <= 90) & (after[: len(data)] < 128)).astype(np.uint8) * np.uint8(32)
        return scan.words(data, offsets, scan.NOT_SPACE, lower=False, cut=cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents and the first id of each, end marks included."""
        w = self._words(data, offsets)
        kinds, sample, kind = np.unique(w.hash, return_index=True, return_inverse=True)
        k, there = self._find(kinds)
        if not there.all():
            if len(self.known) + (~there).sum() > MEMORY_WORDS or len(self.ids) > MEMORY_IDS:  # all of this slice's words are then learnt anew
                self.forget()
                there[:] = False
            self.learn(w, sample[~there], kinds[~there])
            k, _ = self._find(kinds)
        docs = len(offsets) - 1
        # words and end marks in text order
        place = np.arange(len(kind)) + w.doc
        at, count = np.zeros(len(kind) + docs, np.int64), np.ones(len(kind) + docs, np.int64)
        at[place], count[place] = self.at[k][kind], self.count[k][kind]
        stop = np.ones(len(at), bool)
        stop[place] = False
        total = int(count.sum())
        begin = np.cumsum(count) - count
        ids = self.ids[np.arange(total) + np.repeat(at - begin, count)] if total else np.zeros(0, np.uint32)
        ids[begin[stop]] = END
        return ids, np.concatenate([[0], begin[stop] + 1])


class Packer:
    """Windows of one task. Pieces are (doc, start, ids, doc tokens)."""

    def __init__(self, name: int, size: int, most: int):
        self.name, self.size, self.most, self.made = name, size, most, 0
        self.free: list[tuple[int, int]] = []  # (room left, window), ascending
        self.pieces: dict[int, list] = {}
        self.out: list[tuple] = []

    def _emit(self, window: int, open_: bool = False) -> None:
        offset, number = 0, self.name << 32 | self.made
        self.made += 1
        for doc, start, ids, total in self.pieces.pop(window):
            self.out.append((doc, start, len(ids), ids.tobytes(), total, number, offset, open_))
            offset += len(ids)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if len(ids) >= self.size:
                self.pieces[-1] = [(doc, start, ids[: self.size], total)]
                self._emit(-1)
                start, ids = start + self.size, ids[self.size :]
                continue
            k = bisect.bisect_left(self.free, (len(ids), -1))
            if k < len(self.free):
                room, window = self.free.pop(k)
                self.pieces[window].append((doc, start, ids.copy(), total))  # a view would hold its whole slice
                if room > len(ids):
                    bisect.insort(self.free, (room - len(ids), window))
                else:
                    self._emit(window)
                return
            if len(self.free) >= self.most:
                room, window = self.free.pop(0)
                if room > SLACK:
                    self.pieces[window].append((doc, start, ids[:room], total))  # emitted at once
                    start, ids = start + room, ids[room:]
                self._emit(window)
                continue
            window = self.made + len(self.free) + 1
            while window in self.pieces:
                window += 1
            self.pieces[window] = []
            bisect.insort(self.free, (self.size, window))

    def close(self, last: bool) -> None:
        """Leftovers stay open for another level; the last one fills windows to the end."""
        left = [x for _, window in self.free for x in self.pieces[window]]
        if not last:
            for _, window in self.free:
                self._emit(window, True)
            self.free = []
            return
        self.free, self.pieces = [], {}
        room, whole = self.size, []
        for doc, start, ids, total in left:
            while len(ids):
                whole.append((doc, start, ids[:room], total))
                start, ids, room = start + len(whole[-1][2]), ids[room:], room - len(whole[-1][2])
                if not room:
                    self.pieces[0], whole, room = whole, [], self.size
                    self._emit(0)
        if whole:
            self.pieces[0] = whole
            self._emit(0)

    def take(self, kind: pa.DataType) -> pa.RecordBatch:
        rows, self.out = list(zip(*self.out, strict=True)) or [[]] * 8, []
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(rows, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SIZE, most: int = OPEN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        packer = Packer(TaskContext.get().partitionId(), size, most)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, end, data, offsets in scan.slices(batch.column(1)):
                ids, begin = encoder.encode(data, offsets)
                for d in range(end - row):
                    packer.add(names[row + d], 0, ids[begin[d] : begin[d + 1]], int(begin[d + 1] - begin[d]))
                yield packer.take(arrow_kind)
            scan.release()
        packer.close(False)
        yield packer.take(arrow_kind)

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer((level << 24) + TaskContext.get().partitionId(), size, most)
            for batch in batches:
                rows = batch.to_pydict()
                for doc, start, ids, total in zip(rows["doc_id"], rows["start"], rows["ids"], rows["doc_tokens"], strict=True):
                    packer.add(doc, start, np.frombuffer(ids, np.uint32), total)
                yield packer.take(arrow_kind)
            packer.close(last)
            yield packer.take(arrow_kind)

        return run

    packed = shared.settle(docs.mapInArrow(first, schema), "packed")
    done = [packed.where("not open")]
    tasks, level = docs.rdd.getNumPartitions(), 1
    while True:
        tasks = max(1, -(-tasks // FAN))
        left = packed.where("open").withColumn("_task", (F.call_function("shiftright", F.col("sequence_id"), F.lit(32)) % F.lit(tasks)).cast("int"))
        left = left.repartitionByRange(tasks, "_task") if tasks > 1 else left.coalesce(1)
        left = left.sortWithinPartitions("_task", "sequence_id", "offset").drop("_task")
        packed = shared.settle(left.mapInArrow(again(level, tasks == 1), schema), "packed")
        done.append(packed.where("not open"))
        if tasks == 1:
            break
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
