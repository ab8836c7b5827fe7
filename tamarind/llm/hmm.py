"""A hidden Markov language model: Baum-Welch across partitions, exact forward likelihood.

States emit word classes (hash ranges of bounded number; the end mark has its
own), and a class emits its words in proportion to their smoothed corpus
counts.  So the trained tables are bounded, while counts cover every training
word.  A word never seen in training has the base model's probability of it in
every state.  All probabilities of next tokens sum to one.

Training starts from seeded random emissions.  Each of ``ROUNDS`` Baum-Welch
rounds covers all training documents, whatever their number and length: tasks
run forward-backward over whole texts and emit expected counts, which Spark
sums per class.  So that long texts advance beside each other, they are cut into
segments; each later segment's transfer matrix gives the exact forward state it
is entered with and the exact backward state it is left with, so the counts are
those of the uncut text.  The segments' classes are cut once for all rounds.

Scoring needs each token's corpus count.  Documents are dealt into chunks of
bounded size, a chunk's distinct words are joined with the count table, and the
scaled forward recursion then runs over whole texts: texts of over ``BLOCK``
tokens are cut into blocks, whose recursions start from each state and are
chained exactly.

Words are counted by 64-bit hashes.

Defined cases: null and empty texts are an end mark alone.  Repeated rows are
scored one by one.  A null id is a training row.  Without training rows every
token is unseen.  Columns of the input pass through; those named like an
output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan, shared

STATES = 6
CLASSES = 1 << 15
END, UNSEEN = CLASSES, CLASSES + 1
END_HASH = np.uint64(0x5EED0FE17D0C0DE5)
ROUNDS = 14
SEGMENT = 1536
RUN = 1 << 20  # tokens of the documents that advance together; a longer document is a run of its own
RESCALE = 8  # steps between scalings; a step takes no more than about ten digits
TASK_BYTES = 64 << 20  # classes (two bytes a token) that a task of a round reads, where there are more tasks than cores
BLOCK = 2048
CHUNK_BYTES = 8 << 20  # text that a task of scoring holds
HELD = 1_000_000  # distinct words that a task holds before it passes their counts on
PRIOR = 2000.0  # words that the class distribution weighs in each state
STAY = 0.95


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end mark after each document, and the first of each document."""
    w = scan.words(data, offsets)
    docs = len(offsets) - 1
    h = np.full(len(w.hash) + docs, END_HASH, np.uint64)
    h[np.arange(len(w.hash)) + w.doc] = w.hash
    return h, w.first + np.arange(docs + 1)


def token_runs(column: pa.Array, slices: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of several slices together, so that short texts advance with many others."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        base = np.cumsum([0, *(len(h) for h, _ in held)])
        out = np.concatenate([h for h, _ in held]), np.concatenate([np.zeros(1, np.int64), *(f[1:] + b for (_, f), b in zip(held, base, strict=False))])
        held.clear()
        return out

    for _, _, data, offsets in scan.slices(column):
        held.append(tokens(data, offsets))
        if len(held) == slices:
            yield joined()
    if held:
        yield joined()


def classes(h: np.ndarray) -> np.ndarray:
    return np.where(h == END_HASH, END, (h & np.uint64(CLASSES - 1)).astype(np.int64))


def _longest_first(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    return order, np.searchsorted(-size[order], -np.arange(longest), "left")


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: class x state

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emitted: np.ndarray, base: np.ndarray) -> "Model":
        """Smoothed: one visit of each start and move, and the class distribution ``base`` in each state."""
        k = len(start)
        start = (start + 1) / (start.sum() + k)
        move = (move + 1) / (move.sum(1, keepdims=True) + k)
        emit = (emitted + PRIOR * base[:, None]) / (emitted.sum(0) + PRIOR)
        return cls(start, move, emit)

    def expect(self, kinds: np.ndarray, active: np.ndarray, doc: np.ndarray, nth: np.ndarray, sums: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> None:
        """Adds the expected counts of a run of whole documents, given as ``segments`` makes it.

        Only the states' ratios count, so each class's emissions are divided by the largest.
        """
        k = len(self.start)
        emit = np.ascontiguousarray((self.emit / np.maximum(self.emit.max(1, keepdims=True), 1e-300)).T)
        kinds = kinds.astype(np.intp)
        e = emit.take(kinds, axis=1)
        at = np.concatenate([[0], np.cumsum(active), [len(kinds)]]).tolist()
        size = [*active.tolist(), 0]
        n, forth = size[0], np.ascontiguousarray(self.move.T)
        lead, leave, entered, later = self._borders(e, at, active, doc, nth)
        alpha, scale = np.empty_like(e), {}
        a = np.multiply(lead, e[:, :n], out=alpha[:, :n])
        for t in range(1, len(active)):
            a = np.matmul(forth, a[:, : size[t]], out=alpha[:, at[t] : at[t + 1]])
            a *= e[:, at[t] : at[t + 1]]
            if t % RESCALE == 0:
                scale[t] = 1 / np.add.reduce(a, 0)
                a *= scale[t]
        beta, held = np.empty((k, n)), np.empty((k, n))
        found = np.zeros((k, k))
        for t in range(len(active) - 1, -1, -1):
            m, more = size[t], size[t + 1]
            a = alpha[:, at[t] : at[t + 1]]
            if more:
                w = np.multiply(e[:, at[t + 1] : at[t + 2]], beta[:, :more], out=held[:, :more])
                if t + 1 in scale:
                    w *= scale[t + 1]
                found += a[:, :more] @ w.T
                np.matmul(self.move, w, out=beta[:, :more])
            if more < m:
                beta[:, more:m] = leave[:, more:m] / np.add.reduce(a[:, more:] * leave[:, more:m], 0)
            a *= beta[:, :m]
        if len(later):  # moves over the borders of segments
            found += entered[:, later] @ (e[:, later] * beta[:, later]).T
        for j in range(k):
            sums[:, j] += np.bincount(kinds, alpha[j], len(sums))
        moves += found * self.move
        starts += alpha[:, :n][:, nth == 0].sum(1)

    def _borders(self, e: np.ndarray, at: list[int], active: np.ndarray, doc: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each segment: the prior of its first state, what follows its last state, the state before it (all up to a factor); and the later segments.

        A segment's transfer matrix leads from the state of its first token to
        that of its last one; only documents of several segments need them.
        """
        k, n = len(self.start), len(doc)
        lead, leave, entered = np.repeat(self.start[:, None], n, 1), np.ones((k, n)), np.zeros((k, n))
        many = np.flatnonzero(np.isin(doc, doc[nth > 0]))
        if not len(many):
            return lead, leave, entered, many
        forth = np.ascontiguousarray(self.move.T)
        matrix = np.zeros((k, k, len(many)))  # from, to, segment
        matrix[np.arange(k), np.arange(k)] = e[:, many]
        for t, m in enumerate(np.searchsorted(many, active).tolist()):  # segments are in order of length
            if not t:
                continue
            if not m:
                break
            a = np.matmul(forth, matrix[:, :, :m])
            a *= e.take(at[t] + many[:m], axis=1)
            if t % RESCALE == 0:
                a /= a.sum((0, 1))
            matrix[:, :, :m] = a
        number = nth[many]
        order = np.lexsort((number, doc[many]))
        before = np.empty(len(many), np.int64)  # the segment before, among the many
        before[order[1:]] = order[:-1]
        by_number = [np.flatnonzero(number == x) for x in range(int(number.max()) + 1)]
        for now in by_number[1:]:
            then = before[now]
            end = np.einsum("in,ijn->jn", lead[:, many[then]], matrix[:, :, then])
            entered[:, many[now]] = end / end.sum(0)
            lead[:, many[now]] = forth @ entered[:, many[now]]
        for now in reversed(by_number[1:]):
            follow = self.move @ np.einsum("ijn,jn->in", matrix[:, :, now], leave[:, many[now]])
            leave[:, many[before[now]]] = follow / follow.sum(0)
        return lead, leave, entered, many[number > 0]

    def likelihood(self, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each document's classes by the scaled forward recursion."""
        k = len(self.start)
        size = np.diff(first)
        pieces = -(-size // BLOCK)
        doc = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        copies = np.where(nth == 0, 1, k)  # a later block starts from each state
        row = np.repeat(np.arange(len(doc)), copies)
        state = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        begin = first[:-1][doc] + nth * BLOCK
        length = np.minimum(first[1:][doc] - begin, BLOCK)
        order, active = _longest_first(length[row])
        at0 = begin[row][order]
        a = np.where((nth[row] == 0)[:, None], self.start, self.move[state])[order]
        logs = np.zeros(len(row))
        ends = np.empty((len(row), k))
        for t, m in enumerate(active.tolist()):
            if m < len(a):
                ends[m : len(a)] = a[m:]
            a = a[:m] @ self.move if t else a[:m]
            a *= self.emit.take(kind[at0[:m] + t], axis=0)
            if t % RESCALE == RESCALE - 1:
                s = np.add.reduce(a, 1)
                a /= s[:, None]
                logs[:m] += np.log10(s)
        ends[: len(a)] = a
        s = ends.sum(1)
        ends /= s[:, None]
        logs += np.log10(s)
        final, log = np.empty_like(ends), np.empty(len(row))
        final[order], log[order] = ends, logs
        where = np.cumsum(copies) - copies
        head = np.cumsum(pieces) - pieces
        total, v = log[where[head]].copy() if len(size) else np.zeros(0), final[where[head]].copy() if len(size) else np.zeros((0, k))
        for n in range(1, int(pieces.max()) if len(pieces) else 0):
            d = np.flatnonzero(pieces > n)
            r = where[head[d] + n][:, None] + np.arange(k)
            top = log[r].max(1)
            mixed = np.einsum("dk,dkj->dj", v[d] * 10 ** (log[r] - top[:, None]), final[r])
            s = mixed.sum(1)
            total[d] += top + np.log10(s)
            v[d] = mixed / s[:, None]
        return total


def segments(kind: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole documents of about RUN tokens, cut into segments: classes step by step, segments with so many steps, each segment's document and number in it.

    The longest segments of a run come first, so that those with a step more are always the first ones.
    """
    size = np.diff(first)
    longest = np.argsort(-size, kind="stable")
    run = (np.cumsum(size[longest]) - size[longest]) // RUN
    for docs in np.split(longest, np.flatnonzero(np.diff(run)) + 1) if len(longest) else ():
        pieces = -(-size[docs] // SEGMENT)
        doc = np.repeat(docs, pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[:-1][doc] + nth * SEGMENT
        length = np.minimum(first[1:][doc] - begin, SEGMENT)
        order, active = _longest_first(length)
        step = np.repeat(np.arange(len(active)), active)
        which = np.arange(len(step)) - np.repeat(np.cumsum(active) - active, active)
        yield kind[begin[order][which] + step].astype(np.uint16), active.astype(np.int32), doc[order].astype(np.int32), nth[order].astype(np.int32)


RUN_COLUMNS = {"kinds": np.uint16, "active": np.int32, "doc": np.int32, "nth": np.int32}


def cut_segments(texts: DataFrame) -> DataFrame:
    """The runs of ``segments`` of the one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, first in token_runs(batch.column(0), 6):
                for made in segments(classes(h), first):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], names=list(RUN_COLUMNS))
            scan.release()

    return texts.mapInArrow(run, ", ".join(f"{c} binary" for c in RUN_COLUMNS))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token of the one text column occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            kinds, of = np.unique(h, return_inverse=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(of, c).astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for _, _, data, offsets in scan.slices(batch.column(0)):
                held.append(np.unique(tokens(data, offsets)[0], return_counts=True))
                if sum(len(h) for h, _ in held) > HELD:
                    yield merged()
        if held:
            yield merged()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Corpus:
    """Token counts of the training text: ``table`` (h, c), all of them (n), distinct ones (v), and (c + 0.5) summed per class."""

    def __init__(self, texts: DataFrame):
        self.table = shared.settle(count_tokens(texts), "vocabulary")
        kind = F.when(F.col("h") == int(END_HASH), END).otherwise(F.col("h").bitwiseAND(F.lit(CLASSES - 1))).alias("kind")
        rows = self.table.groupBy(kind).agg(F.sum("c"), F.count("*")).collect()  # CLASSES + 1 rows at most
        self.n, self.v = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.mass = np.zeros(CLASSES + 1)
        for kind, n, v in rows:
            self.mass[kind] = n + 0.5 * v
        self.whole = self.n + 0.5 * (self.v + 1)

    @property
    def base(self) -> np.ndarray:
        return self.mass / max(self.mass.sum(), 1.0)


def train(docs: DataFrame, corpus: Corpus, text: str = "text", states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Baum-Welch on all rows of ``docs``, in every round."""
    context = docs.sparkSession.sparkContext
    cut = shared.settle(cut_segments(docs.select(F.col(text).alias("text"))), "segments")
    rows = cut.coalesce(max(2 * context.defaultParallelism, -(-2 * corpus.n // TASK_BYTES)))
    base = corpus.base
    rng = np.random.default_rng(seed)
    empty = lambda: (np.zeros((CLASSES + 1, states)), np.zeros((states, states)), np.zeros(states))
    model = Model(np.full(states, 1 / states), np.full((states, states), (1 - STAY) / (states - 1)) + np.eye(states) * (STAY - (1 - STAY) / (states - 1)), base[:, None] * rng.uniform(0.5, 1.5, (CLASSES + 1, states)))
    model.emit /= np.maximum(model.emit.sum(0), 1e-300)

    def counter(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = sent.value
            sums, moves, starts = empty()
            for batch in batches:
                for made in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    model.expect(*(np.frombuffer(x, kind) for x, kind in zip(made, RUN_COLUMNS.values(), strict=True)), sums, moves, starts)
            at = np.flatnonzero(sums.any(1))
            scan.release()
            kind = np.concatenate([at, -1 - np.arange(states), [-1 - states]])
            rows = np.concatenate([sums[at], moves, starts[None]])
            yield pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(states))], names=["kind", *(f"s{j}" for j in range(states))])

        return run

    for _ in range(rounds):
        sent = context.broadcast(model)
        made = rows.mapInArrow(counter(sent), "kind long, " + ", ".join(f"s{j} double" for j in range(states)))
        got = made.groupBy("kind").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(states))).toArrow()
        sums, moves, starts = empty()
        if len(got):
            kind, values = got.column(0).to_numpy(), np.stack([got.column(f"s{j}").to_numpy() for j in range(states)], 1)
            sums[kind[kind >= 0]] = values[kind >= 0]
            for j in range(states):
                moves[j] = values[kind == -1 - j].sum(0)
            starts = values[kind == -1 - states].sum(0)
        model = Model.from_counts(starts, moves, sums, base)
        sent.destroy()
    shared.discard(cut)
    return model


def score(docs: DataFrame, corpus: Corpus, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) to ``docs``, or to the columns ``keep`` of it."""
    spark = docs.sparkSession
    result = T.StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    docs = docs.drop(*result.names)
    kept = [c for c in docs.columns if keep is None or c in keep]
    number = shared.fresh_name(docs, "_chunk")
    count = max(shared.partitions(spark), -(-shared.text_bytes(docs, text) // CHUNK_BYTES))
    dealt = docs.withColumn(number, F.pmod(F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")]), F.lit(count)).cast("int")).repartition(number)
    unseen = 0.5 / corpus.whole
    emit = np.concatenate([model.emit * (1 - unseen), np.full((1, len(model.start)), unseen)])
    sent = spark.sparkContext.broadcast((Model(model.start, model.move, emit), corpus.mass, corpus.whole, corpus.n))
    where, at = docs.columns.index(text), len(docs.columns)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each chunk, as far as ``HELD`` of them allow."""
        held: dict[int, list[np.ndarray]] = {}

        def merged() -> Iterator[pa.RecordBatch]:
            for c, parts in held.items():
                kinds = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), c, np.int32)), pa.array(kinds.view(np.int64))], names=["chunk", "h"])
            held.clear()

        for batch in batches:
            chunk = batch.column(at).to_numpy()
            for row, end, data, offsets in scan.slices(batch.column(where)):
                h, first = tokens(data, offsets)
                of = np.repeat(chunk[row:end], np.diff(first))
                for c in np.unique(chunk[row:end]).tolist():
                    held.setdefault(c, []).append(np.unique(h[of == c]))
                if sum(len(x) for parts in held.values() for x in parts) > HELD:
                    yield from merged()
            scan.release()
        yield from merged()

    counts = dealt.mapInArrow(distinct, "chunk int, h long").join(corpus.table, "h").select("chunk", "h", "c")

    def judge(docs, counts):
        model, mass, whole, trained = sent.value
        known, pick = np.unique(counts.column("h").to_numpy().view(np.uint64), return_index=True)
        often = counts.column("c").to_numpy()[pick]
        out: list[list[np.ndarray]] = [[], [], [], []]
        for h, first in token_runs(docs.column(where), 2):
            c = np.zeros(len(h))
            if len(known):
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                c = np.where(known[k] == h, often[k], 0).astype(float)
            kind = np.where(c > 0, classes(h), UNSEEN)
            inner = np.where(c > 0, np.log10((c + 0.5) / np.maximum(np.append(mass, 1.0)[kind], 0.5)), 0.0)
            base = np.log10((c + 0.5) / whole)
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  each document has its end mark
            for got, x in zip(out, (np.diff(first), add((c > 0).astype(np.int64)), add(base), model.likelihood(kind, first) + add(inner)), strict=True):
                got.append(x)
        n_tokens, n_known, base, total = (np.concatenate(x) for x in out)
        made = [pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(n_tokens), trained, np.int64)), pa.array(base), pa.array(total)]
        scan.release()
        return pa.Table.from_arrays([*(docs.column(docs.column_names.index(c)) for c in kept), *made], names=[*kept, *result.names])

    schema = T.StructType([*(docs.schema[c] for c in kept), *result.fields])
    both = dealt.groupBy(number).cogroup(counts.groupBy("chunk"))
    return both.applyInArrow(lambda left, right: judge(left, right) if left.num_rows else schema_table(schema), schema)


def schema_table(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    taught = docs.where(~held_out())
    corpus = Corpus(taught.select("text"))
    out = score(docs, corpus, train(taught, corpus), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
