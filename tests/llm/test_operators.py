"""Operators against SQL or brute force, and their defined cases for odd rows."""

import collections
import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamarind.llm import chat, components, contamination, cover_tree, hmm, jaccard, language, line_dedup, packing, queries, sharding, shared, url_filter

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    made = c.execute(queries.SQL[name])
    names = [d[0] for d in made.description]
    at = [names.index(n) for n in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in made.fetchall())


ODD = [(1, "a b c d e f"), (2, None), (3, ""), (4, "   \n\t "), (5, "a b c d e f"), (5, "a b c d e f"), (6, "é ß 日本 \x00 x"), (7, "w " * 30000), (None, "a b c d e f"), (8, "one\ntwo\nthree"), (9, "one\ntwo\nthree"), (10, "same\nsame\nsame\nsame\nsame")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", "clash", 7) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score string, h1 string, n int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def sets(pairs, size):
    out = {}
    for d, t in pairs:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def grouped(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_jaccard(pairs, size, percent):
    s = sets([p for p in pairs if p[0] is not None], size)
    links = [(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    group = grouped(links, s)
    return {d: (len(s[d]), group[d]) for d in s}


def test_jaccard_odd(spark, odd, none):
    """Rows with null or repeated ids and ids that are strings all come back, with the least id of their component."""
    want = {d: (len(sets([(d, t)], 5)[d]), 1 if (t or "").split() == list("abcdef") else 8 if d in (8, 9) else d) for d, t in ODD}
    got = jaccard.jaccard_components(odd).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == sorted((repr(d), *want[d]) for d, _ in ODD)
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(named).collect()} == {d and f"d{d:03}": f"d{c:03}" for d, (_, c) in want.items()}
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(unique).collect()} == brute_jaccard(ODD, 5, 80)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert jaccard.keep_one(unique).count() == len({c for _, c in brute_jaccard(ODD, 5, 80).values()})


def test_hot_keys(spark, monkeypatch):
    """Splitting hot n-grams, classes and keys changes no result."""
    rng = np.random.default_rng(5)
    pairs = [(d, " ".join([f"c{i}" for i in range(12)] + [f"r{x}" for x in rng.integers(0, 9 + d % 3, d % 4)])) for d in range(150)]
    for name, value in (("GROUP_GRAMS", 40), ("TALLY_GRAMS", 100), ("CLASS_GRAMS", 50)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string"), size=4, percent=85).collect()}
    assert got == brute_jaccard(pairs, 4, 85)


def test_jaccard_large_near_group(spark):
    """One text with edits, more than ``SMALL`` of them, at similarities around the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    pairs = []
    for d in range(90):
        w = list(base)
        for p in rng.integers(0, 60, d % 5):
            w[p] = f"x{rng.integers(0, 4)}"
        pairs.append((d, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string"), size=4, percent=85).collect()}
    assert got == brute_jaccard(pairs, 4, 85)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    want = grouped(edges, {x for e in edges for x in e})
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want.keys() - got.keys())


def test_line_dedup_odd(odd, none):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(odd).collect()}
    assert got[8] == "one\ntwo\nthree" and got[9] == "" and got[10] == "same" and got[2] is None and got[1] == "a b c d e f"
    assert line_dedup.dedup_lines(none).count() == 0
    assert set(odd.columns) <= set(line_dedup.dedup_lines(odd).columns)


def test_contamination(spark, odd, none):
    bench = spark.createDataFrame([("i1", " ".join(f"k{i}" for i in range(20))), ("i2", "d e f"), (None, "zz"), ("i4", None), ("i5", "!!")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "pre " + " ".join(f"K{i}" for i in range(2, 18)) + " post"), (2, " ".join(f"k{i}" for i in range(12))), (3, "a D! e, f")], "doc_id long, text string")
    got = {r.doc_id: r for r in contamination.find_matches(docs, bench).collect()}
    assert got[1].n_hit == 16 and got[1].item_ids == ["i1"] and got[1].matches[0].length == 16 and got[1].matches[0].item_start == 2
    assert got[2].n_hit == 0 and got[3].n_hit == 3 and got[3].hits[0].start == 1
    assert contamination.find_matches(odd, bench).count() == len(ODD)
    assert contamination.find_matches(odd, bench.where("1 = 0")).agg({"n_hit": "sum"}).first()[0] == 0
    assert contamination.find_matches(none, bench).count() == 0


def brute_contamination(docs, items, window=13):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            q = words(x)
            n = min(window, len(q))
            grams = {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if q else set()
            for k in range(len(w) - n + 1) if q else ():
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids.add(i or "")
        out[d] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contamination_brute(spark, monkeypatch, block_bytes):
    """Repetitive texts and items, short items, and several blocks."""
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(11)
    say = lambda n, k: " ".join("ab"[x] if k == 2 else f"v{x}" for x in rng.integers(0, k, n))
    items = [("r", "same " * 40), ("ab", say(60, 2)), ("ba", say(30, 2)), ("long", say(80, 500)), ("short", "alpha beta"), ("one", "gamma"), ("none", "..."), ("r", say(20, 3)), ("twice", "same " * 14 + "end")]
    long_ = items[3][1].split()
    docs = [(0, "same " * 300), (1, say(400, 2)), (2, "x " * 5 + " ".join(long_[10:50]) + " y"), (3, " ".join(long_[:12])), (4, "Alpha, BETA gamma!"), (5, None), (6, ""), (7, say(300, 3) + " same" * 13 + " end"), (8, " ".join(long_ + long_))]
    rows = contamination.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in rows} == brute_contamination(docs, items)
    by = {r.doc_id: {m.item_id: m for m in r.matches} for r in rows}
    assert (by[2]["long"].item_start, by[2]["long"].doc_start, by[2]["long"].length) == (10, 5, 40) and by[8]["long"].length == 80
    assert by[0]["r"].length == 40 and sum(h.end - h.start for r in rows for h in r.hits) == sum(r.n_hit for r in rows)


def test_contamination_repetitive_is_fast():
    """Equal words against equal words are not paired one by one."""
    import time

    import pyarrow as pa

    block = contamination.Block(["i"], pa.array(["word " * 3000], pa.large_string()), 13)
    began = time.perf_counter()
    made = contamination._judge(pa.array(["word " * 8000]), block)
    assert made["n_hit"] == [8000] and made["matches"][0][0]["length"] == 3000 and time.perf_counter() - began < 20


def test_packing_ids(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = [(d, t) for d, t in enumerate(["", None, "The. end, É H̱. <|endoftext|>", "don't IT'S, x.,", "word " * 9000, *(f"text number {i} " * (i % 70) for i in range(300))])]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(docs[d], key=lambda r: r.start)
        assert [p.start for p in parts] == [0, *itertools.accumulate(p.length for p in parts)][:-1]
        assert np.concatenate([np.frombuffer(p.ids, np.uint32) for p in parts]).tolist() == ids and parts[0].doc_tokens == len(ids)
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [0, *itertools.accumulate(p.length for p in parts)][:-1] and sum(p.length for p in parts) <= 4096
    assert sum(r.length for r in rows) / (4096 * len(seqs)) > 0.9
    assert packing.pack(odd.select("doc_id", "text")).select("doc_id").distinct().count() == len({d for d, _ in ODD})
    assert packing.pack(none).count() == 0


def test_language(spark, odd, none):
    rows = queries.QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in shared.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) > 0.97 * len(held)
    mixed = language.Model(["x", "y"], np.zeros((language.BUCKETS, 2)), np.ones((language.SCRIPTS, 2), bool))
    score = np.array([[0, -9]] * 4 + [[-9, 0]] * 4 + [[0, -9]], np.float32)
    assert language.viterbi(score[:8], np.array([0, 8]), 12.0).tolist() == [0] * 4 + [1] * 4
    got = {r.doc_id: r for r in language.identify(odd, mixed).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[1].lang_pred in "xy" and 0 <= got[7].score <= 1
    assert {r.lang_pred for r in language.identify(odd, language.train(odd.where("lang is null"))).collect()} == {"und"}
    assert language.identify(none, mixed).count() == 0


def test_viterbi_brute():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        s = rng.normal(0, 3, (n, 3)).astype(np.float32)
        path = language.viterbi(s, np.array([0, n]), 2.0)
        value = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))), abs=1e-4)


def test_jaccard_hub_pairs_are_split(spark, monkeypatch):
    """Near copies around one hub: no task gets all of the hub's pairs, and all links are found."""
    rng = np.random.default_rng(9)
    hub = np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2))
    sets = [hub, *(np.sort(np.append(hub[1:], np.uint64(2 * i + 1))) for i in range(300)), *(np.sort(np.append(hub[60:], rng.integers(0, 1 << 63, 60, dtype=np.uint64))) for _ in range(20))]
    frame = spark.createDataFrame([(i, len(x), x.tobytes()) for i, x in enumerate(sets)], "doc long, n long, grams binary")
    pairs = spark.createDataFrame([(0, i) for i in range(1, len(sets))], "a long, b long")
    plain = jaccard._overlaps

    def bounded(key, left, right):
        assert right.num_rows < 100
        return plain(key, left, right)

    monkeypatch.setattr(jaccard, "PIECE", 2000)
    monkeypatch.setattr(jaccard, "_overlaps", bounded)
    assert sorted(tuple(r) for r in jaccard._verified(pairs, frame, 80).collect()) == [(0, i) for i in range(1, 301)]


def test_hmm_likelihood(monkeypatch):
    """The blocked recursion equals the plain one, and all next tokens sum to one."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(hmm, "BLOCK", 3)
    k, n = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(n), k).T)
    seqs = [rng.integers(0, n, m) for m in (1, 3, 4, 10, 7)]
    got = model.likelihood(np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]))
    for s, g in zip(seqs, got, strict=True):
        a = model.start * model.emit[s[0]]
        for x in s[1:]:
            a = (a @ model.move) * model.emit[x]
        assert math.log10(a.sum()) == pytest.approx(g)


@pytest.mark.parametrize(("segment", "run"), [(3, 15), (4, 1000), (50, 30)])
def test_hmm_expect(monkeypatch, segment, run):
    """Expected counts, whatever the segments, equal the sums over all state paths of whole documents."""
    rng = np.random.default_rng(6)
    k, n = 2, 4
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "RUN", run)
    monkeypatch.setattr(hmm, "RESCALE", 2)
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(n), k).T)
    seqs = [rng.integers(0, n, m) for m in (1, 3, 11, 10, 13, 4, 8)]
    got = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
    for made in hmm.segments(np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])):
        model.expect(*made, *got)
    want = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
    for s in seqs:
        paths = list(itertools.product(range(k), repeat=len(s)))
        p = np.array([model.start[q[0]] * math.prod(model.move[a, b] for a, b in itertools.pairwise(q)) * math.prod(model.emit[c, j] for c, j in zip(s, q, strict=True)) for q in paths])
        for q, weight in zip(paths, p / p.sum(), strict=True):
            np.add.at(want[0], (s, list(q)), weight)
            np.add.at(want[1], (list(q[:-1]), list(q[1:])), weight)
            want[2][q[0]] += weight
    for x, y in zip(got, want, strict=True):
        assert x == pytest.approx(y)


def test_hmm_trains_on_all_rows(spark):
    """Every round covers all rows of a table over 4 MB: which ids they have, or whether any, changes nothing."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'ab'[i % 2]}{w}" for w in rng.zipf(1.3, 1500) % 5000) for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert shared.text_bytes(docs, "text") > 4 << 20
    corpus = hmm.Corpus(docs.select("text"))
    one, other = (hmm.train(d, corpus) for d in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))))
    assert np.allclose(one.emit, other.emit, rtol=1e-3, atol=1e-9) and np.allclose(one.move, other.move, rtol=1e-3)


def test_hmm_query(spark):
    rows = queries.QUERIES["op8_hmm"](spark, SF).collect()
    docs = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in shared.table(spark, SF, "documents").collect()}
    count = collections.Counter(t for d, w in docs.items() if zlib.crc32(str(d).encode()) % 5 != 1 for t in w)
    n, v = sum(count.values()), len(count)
    for r in rows:
        w = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[t] > 0 for t in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_hmm_odd(spark, odd, none):
    corpus = hmm.Corpus(odd.select("text"))
    model = hmm.train(odd, corpus)
    assert hmm.score(odd, corpus, model).count() == len(ODD) and hmm.score(none, corpus, model).count() == 0
    corpus = hmm.Corpus(none.select("text"))
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in hmm.score(odd, corpus, hmm.train(none, corpus)).collect())


def test_hilbert_curve(spark):
    """A bijection whose neighbours on the curve differ by one step in one dimension."""
    cells = spark.range(512).selectExpr("cast(id % 8 as int) x", "cast(id div 8 % 8 as int) y", "cast(id div 64 as int) z")
    rows = sorted((r.h, r.x, r.y, r.z) for r in cells.select("x", "y", "z", sharding.hilbert([cells.x, cells.y, cells.z], 3).alias("h")).collect())
    assert [r[0] for r in rows] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)) == 1 for p, q in itertools.pairwise(rows))


def test_sharding(spark, odd, none):
    for sf in (SF,):
        rows = queries.QUERIES["op2_sharding"](spark, sf).collect()
        texts = {r.doc_id: r.text for r in shared.table(spark, sf, "documents").collect()}
        sizes = collections.Counter(r.shard for r in rows)
        assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        curve = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert curve == sorted(curve)
        assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 8 for r in rows)
    clash = odd.withColumns({c: F.lit("x") for c in ("_sub", "_rank", "_before", "_c0", "curve", "slot")})
    placed = sharding.hilbert_shards(clash, ["n_chars", "source"], 5, ["doc_id", "text"])
    assert placed.count() == len(ODD) and set(clash.columns) <= set(placed.columns)
    assert sharding.hilbert_shards(none, ["n_chars", "source"], 5, ["doc_id"]).count() == 0


def test_string_quantiles(spark):
    """Strings with a long common beginning fall into cells of about equal numbers of rows."""
    rows = [(f"https://example.org/{i:04}",) for i in range(400)] + [("https://example.org/0007",)] * 200 + [(None,)] * 3
    df = spark.createDataFrame(rows, "s string")
    cell = sharding.quantise(df, {"s": "s"}, 3)["s"]
    got = collections.Counter(r.c for r in df.where("s is not null").select(cell.alias("c")).collect())
    assert got[0] <= 75 and max(n for c, n in got.items()) <= 275 and len(got) >= 6
    pairs = sorted((r.s, r.c) for r in df.where("s is not null").select("s", cell.alias("c")).collect())
    assert [c for _, c in pairs] == sorted(c for _, c in pairs) and {r.c for r in df.where("s is null").select(cell.alias("c")).collect()} == {0}


def test_chat_tree(spark):
    nodes = [(1, 0, None, 1.0, "user", "q"), (1, 1, 0, 0.1, "assistant", "bad"), (1, 2, 0, 0.9, "assistant", "good\\l </turn>\n### x: #<\\"), (1, 3, 2, 0.9, "user", None), (2, 5, 6, 0.0, "user", "loop"), (2, 6, 5, 0.0, "user", "loop"), (3, 1, 77, None, None, ""), (None, 1, None, 0.0, "user", "x")]
    df = spark.createDataFrame(nodes, "conv long, node long, parent long, score double, role string, text string")
    rows = {(r.conv, r.path): r for r in chat.read_back(chat.format_paths(chat.chosen_paths(df, most=2))).collect()}
    assert [(t.role, t.text) for t in rows[1, 1].turns] == [("user", "q"), ("assistant", nodes[2][5]), ("user", "")]
    assert rows[1, 1].masked == [nodes[2][5]] and [t.text for t in rows[1, 2].turns] == ["q", "bad"]
    assert set(rows) == {(1, 1), (1, 2), (3, 1), (None, 1)} and rows[3, 1].turns[0].role == ""
    assert chat.format_paths(chat.chosen_paths(df.where("1 = 0"))).count() == 0


def test_chat_keeps_all_rows(spark):
    """Tied turns, repeated rows, null turns and null conversations are all turns of their conversation."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "y"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, None, "assistant", "last"), (None, 0, "user", "n"), (None, 1, "assistant", None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_paths(chat.chosen_paths(chat.linked(df)))).collect()}
    assert got == {1: [("user", "a"), ("assistant", "x"), ("assistant", "x"), ("assistant", "y"), ("assistant", "last")], None: [("user", "n"), ("assistant", "")], 2: [("", "")]}


def test_line_dedup_clashing_names(odd):
    clash = odd.withColumns({c: F.lit("x") for c in ("_t", "_t2", "_id", "_lines", "_gone", "_kept", "id", "t", "at", "w", "n", "removed")})
    out = line_dedup.dedup_lines(clash)
    assert set(clash.columns) <= set(out.columns) and {r.doc_id: r.text for r in out.collect()}[10] == "same"


def test_language_counts(spark, monkeypatch):
    """The trained table equals counts by a plain loop over words and trigrams."""
    texts = [("en", "The cat, the hat"), ("en", "a"), ("ru", "мир мир да"), ("ru", None), (None, "left out"), ("ja", "日本 123")]
    model = language.train(spark.createDataFrame(texts, "lang string, text string"))
    langs = sorted({k for k, t in texts if k and t})
    grams, scripts = {k: collections.Counter() for k in langs}, {k: collections.Counter() for k in langs}
    for k, t in texts:
        for w in (t or "").encode().lower().split() if k in grams else ():
            code = next((ord(c) for c in w.decode() if c.isalpha()), None)
            script = 0 if code is None else int(language.SCRIPT_NUMBERS[np.searchsorted(language.SCRIPT_STARTS, code, "right") - 1])
            scripts[k][script] += 1
            padded = [0, *w, 0]
            for x in zip(padded, padded[1:], padded[2:], strict=False):
                if script:
                    grams[k][int(language.scan.mix(np.array([x[0] << 16 | x[1] << 8 | x[2]], np.uint64))[0] % np.uint64(language.BUCKETS))] += 1
    assert model.langs == langs
    for j, k in enumerate(langs):
        want = np.array([grams[k][b] for b in range(language.BUCKETS)])
        assert np.allclose(model.table[:, j], np.log((want + language.SMOOTH) / (want.sum() + language.SMOOTH * language.BUCKETS)))
        assert all(model.allowed[x, j] for x in scripts[k] if x)


def test_url_odd(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.ORG/en/12?x"), (4, "HTTP://A.Example.ORG/en/12?x"), (5, "x://org/"), (6, "x://org"), (7, "x://borg/"), (8, "x://" + "a." * 300 + "com/de/" + "y" * 5000)]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in urls], "page_id long, url string, host string, key string")
    rows = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark)).where("rule is not null").collect())
    assert rows == [(4, "example.org/en/1", "block"), (4, "example.org/en/1", "block"), (5, "org/", "allow"), (8, "com/de/", "block")]
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark)).count() == len(urls)
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark).where("1 = 0")).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.filter_urls(pages.where("1 = 0"), url_filter.rules_frame(spark)).count() == 0


@pytest.mark.parametrize("rounds", [16, 1])
def test_cover_tree_odd(spark, monkeypatch, rounds):
    """Small cells force several levels and cuts; a tight group, equal and parallel vectors, huge and tiny ones, and broken ones."""
    for name, value in (("BLOCK", 20), ("FEW", 3), ("FAN", 4), ("DEALT", 30), ("LEAF", 3), ("ROUNDS", rounds)):
        monkeypatch.setattr(cover_tree, name, value)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=8)
    vectors = [centre + rng.normal(size=8) * 0.08 for _ in range(60)] + [rng.normal(size=8) for _ in range(60)] + [centre] * 5 + [centre * 3, centre * 1e200, centre * 1e-200]
    rows = [(i, [float(x) for x in v], "a" if i % 3 else "b") for i, v in enumerate(vectors)]
    rows += [(500, None, "a"), (501, [0.0] * 8, "a"), (502, [float("nan")] * 8, "a"), (503, [], "a"), (504, [None] * 8, "a"), (505, [float(x) for x in centre], None), (506, [1.0], "a"), (507, [2.0], "a")]
    good = {i: (np.array(v) / np.abs(v).max(), k) for i, v, k in rows if k and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    degree = collections.Counter(x for e in links for x in e)
    group = grouped(links, [r[0] for r in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(df).collect()}
    assert got == {i: (degree[i], group[i], group[i] == i) for i, _, _ in rows}
    assert cover_tree.near_duplicates(df.where("1 = 0")).count() == 0


def test_cover_tree_ids(spark):
    """Null, repeated and string ids."""
    rows = [("b", [1.0, 0.0], "x"), ("a", [2.0, 0.0], "x"), ("a", [0.0, 1.0], "x"), (None, [0.0, 1.0], "x"), (None, [1.0, 1.0], "x")]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == [("None", 0, "None"), ("None", 1, "a"), ("a", 1, "a"), ("a", 1, "a"), ("b", 1, "a")]


def test_cover_tree_bounds():
    """All pairs within reach come from the traversal, once each, and nodes cover their points."""
    rng = np.random.default_rng(2)
    points = cover_tree.unit(np.concatenate([rng.normal(size=(300, 5)), rng.normal(size=5) + 0.01 * rng.normal(size=(200, 5))]))
    trees = cover_tree.Tree(points), cover_tree.Tree(points[:200])
    for tree in trees:
        for k in range(len(tree.centre)):
            mine = tree.order[tree.begin[k] : tree.end[k]]
            assert np.linalg.norm(tree.points[mine] - tree.points[tree.centre[k]], axis=1).max() <= tree.radius[k]
    for a, b, same in ((trees[0], trees[0], True), (trees[0], trees[1], False)):
        found = collections.Counter(tuple(sorted(p)) if same else p for i, j in cover_tree.dual(a, b, 0.2, same) for p in zip(i.tolist(), j.tolist(), strict=True))
        apart = np.linalg.norm(a.points[:, None] - b.points[None], axis=2)
        want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(apart <= 0.2)), strict=True) if not same or i < j}
        assert want <= set(found) and max(found.values()) == 1


def test_pipeline_brute(spark, tmp_path):
    """Kept documents, held against a plain version of every stage."""
    docs = shared.table(spark, SF, "documents")
    out = docs
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.settle(stage(spark, out, SF), "test")
        stages[name] = out
    first = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in stages["language"].collect()}
    assert len(kept) >= 0.98 * len(first) and all(first[d] == t for d, t in kept.items())
    seen, cut = set(), {}
    for d in sorted(kept):
        lines = kept[d].split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            if key in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(key)
        if len(gone) < len(lines):
            cut[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {r.doc_id: (r.text, r.n_chars) for r in stages["line dedup"].collect()} == {d: (t, len(t)) for d, t in cut.items()}
    alone = {d for d, (_, c) in brute_jaccard(list(cut.items()), 5, 80).items() if c == d}
    assert {r.doc_id for r in stages["near duplicates"].collect()} == alone
    judged = {r.doc_id for r in queries.QUERIES["op1_decontamination"](spark, SF).where("contaminated").collect()}
    clean = {r.doc_id for r in stages["decontamination"].collect()}
    assert clean <= alone and alone - clean <= judged
    assert {r.doc_id for r in stages["packing"].collect()} == clean
    assert sum(r.length for r in stages["packing"].collect()) == sum(n for n, in stages["packing"].select("doc_id", "doc_tokens").distinct().select("doc_tokens").collect())


def test_pipeline_odd(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = shared.settle(stage(spark, docs, SF), "test")
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_hmm_scalings(monkeypatch):
    """The forward recursion is scaled every few steps, as training is, with the same likelihood as at each step."""
    rng = np.random.default_rng(3)
    k, n = 4, 50
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(n), k).T * 1e-9)
    first = np.array([0, 1, 9, 17, 4000])
    kind = rng.integers(0, n, first[-1])
    calls, log10 = [], np.log10
    monkeypatch.setattr(hmm.np, "log10", lambda x: calls.append(1) or log10(x))
    got = model.likelihood(kind, first)
    assert len(calls) <= hmm.BLOCK // hmm.RESCALE + 2
    monkeypatch.setattr(hmm, "RESCALE", 1)
    assert np.allclose(got, model.likelihood(kind, first), rtol=1e-12)
