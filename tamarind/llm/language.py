"""Language identification of whole texts, with spans for mixed ones.

Script ranges narrow the languages that a word can have; character trigrams
with word edges score the word in each of these; Viterbi with a switching
penalty labels all words of a text at once, and runs of a label are the spans.
The text's language is the label of most of its words that have letters.

The model is a table of hashed trigrams, whose counts cover all training
documents and are summed by Spark; its size is ``BUCKETS`` a language, and a
table that would pass ``MODEL_MB`` raises an error.

Defined cases: a null text, or one without a letter, is ``und`` with score 0.
Words without letters score alike in all languages.  A script that no language
was seen in leaves all languages open.  Without training rows every text is
``und``.  Repeated rows are judged alike.  Columns of the input pass through;
those named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan, shared

BUCKETS = 1 << 15
MODEL_MB = 256
TOGETHER = 1 << 22  # bytes of text whose words are labelled together
SWITCH = 12.0  # natural log units that a change of language costs
SMOOTH = 0.5
SCRIPT_SHARE = 0.002  # of a language's words, from which a script counts as its own
#: First code points of Unicode blocks and the script each begins; 0 is no letters.
SCRIPT_STARTS = np.array([0x00, 0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2C80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000])
SCRIPT_NUMBERS = np.array([0, 1, 0, 1, 0, 1, 0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 1, 2, 0, 15, 16, 17, 18, 19, 13, 0, 18, 20, 18, 0])
SCRIPTS = 21
RESULT = "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"


def training(doc_id: str = "doc_id") -> Column:
    """Rows to learn from: those whose crc32(id as text) mod 3 is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def features(w: scan.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of the words numbered ``at``, the word (in ``at``) of each, and the words' scripts."""
    size = (w.end - w.start)[at] + 2  # with an edge before and behind
    first = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(at)), size)
    k = np.arange(total) - first[owner]
    inner = (k > 0) & (k < size[owner] - 1)
    low = np.zeros(total, np.uint64)
    low[inner] = w.data[(w.start[at][owner] + k - 1)[inner]]
    tri = np.zeros(total, np.uint64)
    if total > 2:
        tri[:-2] = low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]
    keep = k < np.maximum(size[owner] - 2, 1)
    bucket = (scan.mix(tri[keep]) % np.uint64(BUCKETS)).astype(np.int64)
    # the first byte that can begin a letter: ASCII letter or lead byte
    b = low.astype(np.int64)
    lead = np.flatnonzero((b >= 97) & (b <= 122) | (b >= 0xC0))
    script = np.zeros(len(at), np.int64)
    if len(lead):
        word, where = np.unique(owner[lead], return_index=True)
        p = lead[where]
        c = [b[np.minimum(p + j, total - 1)] for j in range(4)]
        code = np.where(c[0] < 128, c[0], np.where(c[0] < 0xE0, (c[0] & 31) << 6 | c[1] & 63, np.where(c[0] < 0xF0, (c[0] & 15) << 12 | (c[1] & 63) << 6 | c[2] & 63, (c[0] & 7) << 18 | (c[1] & 63) << 12 | (c[2] & 63) << 6 | c[3] & 63)))
        script[word] = SCRIPT_NUMBERS[np.searchsorted(SCRIPT_STARTS, code, "right") - 1]
    return bucket, owner[keep], script


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed  # table: bucket x language, natural logs

    def word_scores(self, w: scan.Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word x language) and whether the word has letters."""
        kinds, sample, kind = np.unique(w.hash, return_index=True, return_inverse=True)
        bucket, owner, script = features(w, sample)
        score = np.stack([np.bincount(owner, self.table[:, l][bucket], len(kinds)) for l in range(len(self.langs))], 1)
        open_ = self.allowed[script]
        score = np.where(open_, score, score.min(1, keepdims=True) - 1000.0)
        score[script == 0] = 0.0
        return score[kind].astype(np.float32), (script > 0)[kind]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from all rows of ``docs`` with a language and a text."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}  # a language's buckets, then scripts
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for row, end, data, offsets in scan.slices(batch.column(1)):
                w = scan.words(data, offsets)
                if not len(w.hash):
                    continue
                kinds, sample, kind = np.unique(w.hash, return_index=True, return_inverse=True)
                bucket, owner, script = features(w, sample)
                langs, of = np.unique(names[row:end].astype(str), return_inverse=True)
                per = np.bincount(of[w.doc] * len(kinds) + kind, minlength=len(langs) * len(kinds)).reshape(len(langs), -1)
                for name, n in zip(langs.tolist(), per, strict=True):
                    lettered = script[owner] > 0
                    new = np.concatenate([np.bincount(bucket[lettered], n[owner[lettered]], BUCKETS), np.bincount(script, n, SCRIPTS)])
                    sums[name] = sums[name] + new if name in sums else new
        for name, all_ in sums.items():
            at = np.flatnonzero(all_)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(all_[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = shared.settle(counts, "lang-counts")
    langs = sorted(r[0] for r in found.select("lang").distinct().collect())
    if len(langs) * (BUCKETS + SCRIPTS) * 8 > MODEL_MB << 20:
        raise ValueError(f"{len(langs)} languages need a model of more than {MODEL_MB} MB")
    if not langs:
        return None
    got = found.toArrow()
    sums = np.zeros((BUCKETS + SCRIPTS, len(langs)))
    sums[got.column("bucket").to_numpy(), np.searchsorted(langs, got.column("lang").to_pylist())] = got.column("n").to_numpy()
    grams, scripts = sums[:BUCKETS], sums[BUCKETS:]
    table = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * BUCKETS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts[1:].sum(0), 1)
    allowed[~allowed.any(1)] = True
    shared.discard(found)
    return Model(langs, table, allowed)


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; all documents advance together, longest first."""
    n, langs = score.shape
    label = np.zeros(n, np.int16)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")  # documents with more than t words
    value = np.zeros((len(size), langs), np.float32)
    best = np.zeros(n, np.int16)  # label to come from, unless one stays
    stay = np.ones((n, langs), bool)
    for t in range(longest):
        m = active[t]
        at = begin[:m] + t
        v = value[:m]
        if t:
            top = v.argmax(1)
            bar = v[np.arange(m), top] - np.float32(switch)
            best[at] = top
            stay[at] = v >= bar[:, None]
            np.maximum(v, bar[:, None], out=v)
            v -= bar[:, None]
        v += score[at]
    now = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        label[at] = now[:m]
        now[:m] = np.where(stay[at, now[:m]], now[:m], best[at])
    return label


def _spans(label: np.ndarray, first: np.ndarray, langs: list[str]) -> list[list[dict]]:
    new = np.zeros(len(label) + 1, bool)
    new[first] = True
    new[1:-1] |= label[1:] != label[:-1]
    new[-1] = True
    at = np.flatnonzero(new)
    start, end = at[:-1], at[1:]
    doc = np.searchsorted(first, start, "right") - 1
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    for d, s, e, f, k in zip(doc.tolist(), start.tolist(), end.tolist(), first[doc].tolist(), label[start].tolist(), strict=True):
        out[d].append({"lang": langs[k], "start": s - f, "end": e - f})
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (share of the lettered words) and spans (of words) to ``docs``."""
    spark = docs.sparkSession
    result = T.StructType.fromDDL(RESULT)
    docs = docs.drop(*result.names)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "spans": F.lit(None).cast(result["spans"].dataType)})
    sent = spark.sparkContext.broadcast(model)
    kinds = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def labelled(column: pa.Array, model: Model) -> list[list]:
        """Label, share and spans of some texts."""
        scores, letters, sizes, lone = [], [], [], []
        for row, end, data, offsets in scan.slices(column):
            w = scan.words(data, offsets)
            score, lettered = model.word_scores(w) if len(w.hash) else (np.zeros((0, len(model.langs)), np.float32), np.zeros(0, bool))
            scores.append(score)
            letters.append(lettered)
            sizes.append(np.diff(w.first))
            ascii_ = np.concatenate([[0], np.cumsum((w.data >= 97) & (w.data <= 122))])
            for d in np.flatnonzero(ascii_[offsets[1:]] == ascii_[offsets[:-1]]).tolist():
                if not any(map(str.isalpha, column[row + d].as_py() or "")):
                    lone.append(row + d)
        score, lettered, size = np.concatenate(scores), np.concatenate(letters), np.concatenate(sizes)
        first = np.concatenate([[0], np.cumsum(size)])
        label = viterbi(score, first)
        doc = np.repeat(np.arange(len(size)), size)
        votes = np.bincount(doc * len(model.langs) + label, lettered, len(size) * len(model.langs)).reshape(len(size), -1)
        weak = votes.sum(1) == 0  # letters only inside words of other signs
        votes[weak] = np.bincount(doc * len(model.langs) + label, minlength=votes.size).reshape(votes.shape)[weak]
        top = votes.argmax(1)
        share = votes[np.arange(len(size)), top] / np.maximum(votes.sum(1), 1)
        made = [[model.langs[k] for k in top.tolist()], share.tolist(), _spans(label, first, model.langs)]
        for d in lone:
            made[0][d], made[1][d], made[2][d] = "und", 0.0, []
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            column, made = batch.column(batch.schema.get_field_index(text)), [[], [], []]
            for row, end, _, _ in scan.slices(column, TOGETHER):
                for got, more in zip(made, labelled(column.slice(row, end - row), model), strict=True):
                    got.extend(more)
            extra = [pa.array(x, f.type) for x, f in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *kinds.names])
            scan.release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *result.fields]))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    model = train(docs.where(training()).select("text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~training()).alias("held_out"), "lang_pred", "score", "spans")
