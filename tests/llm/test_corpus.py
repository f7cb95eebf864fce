"""Operators over the whole corpus: near duplicates, repeats, store, mixing, packing, neighbours, pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vellum.llm import ann, components, jaccard, mixing, packing, store, suffix
from vellum.llm.shared import LEAST_TASKS, fewer, range_bounds, shared_dir
from vellum.llm.textbytes import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWEST = -(1 << 70)


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    """(doc_id, n_shingles, component_id) of every row, by brute force over an inverted index."""
    sets, where, up = [shingle_set(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(sets):
        for m, n in Counter(m for g in a for m in where[g]).items():
            if 100 * n >= 75 * (len(a) + len(sets[m]) - n):
                up[root(k)] = root(m)
        for g in a:
            where[g].append(k)
    group = defaultdict(list)
    for k in range(len(rows)):
        group[root(k)].append(k)
    return Counter((rows[k][0], len(sets[k]), min((rows[j][0] for j in ks if rows[j][0] is not None), default=None)) for ks in group.values() for k in ks)


def near_copies(rng, n, edits):
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out, words


def test_ngram_join(spark, awkward, monkeypatch):
    rng = random.Random(5)
    texts, words = near_copies(rng, 150, (1, 2, 3, 4, 5))
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice((3, 6, 40)))) for _ in range(60)] + [texts[0][:300] + " " + " ".join(rng.choice(words) for _ in range(80)) for _ in range(40)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(2003, "One two"), (2004, "one TWO"), (None, "one two"), (2005, "É x"), (2006, "é x"), (2003, "one two")]
    rows += [(r.doc_id, r.text) for r in awkward.select(F.col("doc_id") + 5000, "text").toDF("doc_id", "text").collect()]
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    monkeypatch.setattr(jaccard, "SAMPLE_SHARE", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_join(df).collect()) == linked(rows)


def test_ngram_join_dealt_tokens(spark):
    """Frequent tokens of small groups are dealt over many parts, where most of their postings are alone."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)]) for _ in range(n)) for n in (5, 7, 30, 90) for _ in range(5)]
    for n in (12, 30, 60):
        base = [f"g{n}x{i}" for i in range(120)]
        for _ in range(n):
            w = list(base)
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
            texts.append(" ".join(w))
        short = [f"s{n}x{i}" for i in range(14)]
        texts += [" ".join([*short, f"e{rng.randrange(10**9)}"]) for _ in range(n)]
    rows = list(enumerate(texts))
    got = jaccard.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), parts=48).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked(rows)


def test_late_askers_start_at_their_first_place(spark):
    """A point that asks for the first time in turn 3 proposes its best partners, too."""
    counts = bytes([1] * jaccard.GROUPS)
    rows = [(1, 0, i, jaccard.GROUPS, counts, 7 if i == 20 else 3, int(i == 20)) for i in range(21)]
    members = spark.createDataFrame(rows, "cell long, block int, pid long, n long, counts binary, label long, asks int")
    got = jaccard.candidates(members, 3, 1).collect()
    assert {(r.a, r.b) for r in got if r.a != r.b} == {(i, 20) for i in range(20)}
    assert sum(r.more for r in got) == 0
    assert sum(r.more for r in jaccard.candidates(members, 2, 1).collect()) == 12


@pytest.mark.parametrize("rows_a_block", [4_096, 8])
def test_ngram_join_counts_every_link(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(jaccard, "LINK_ROWS", rows_a_block)
    rng = random.Random(9)
    texts = near_copies(rng, 60, (1, 2, 3))[0]
    texts += [" ".join(t.split()[: rng.choice((70, 90, 110, 130))]) for t in texts[:40]] + ["a b c d e f", "A b c d e f", texts[0].upper()]
    sets = [frozenset(shingle_set(t)) for t in texts]
    want = {a: sum(100 * len(a & b) >= 75 * len(a | b) for b in set(sets) if b != a) for a in sets}
    assert max(want.values()) > 20
    got = jaccard.ngram_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), parts=4).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: want[a] for i, a in enumerate(sets)}


def test_ngram_join_edges(spark, awkward):
    want = linked([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_join(awkward).collect()) == want
    assert jaccard.ngram_join(awkward.limit(0)).count() == 0
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[5] == 1 and 6 not in ids and ids[0] == ids[1] == 1


def test_bound_never_prunes_a_pair():
    rng = np.random.default_rng(1)
    counts = rng.poisson(2, (300, jaccard.GROUPS)).astype("u1")
    n = counts.sum(1).astype(np.int64)
    who, point, bound = jaccard.RTree(counts, n).search(counts[:50], n[:50])
    found = set(zip(who.tolist(), point.tolist(), strict=True))
    for q in range(50):
        for p in range(300):
            most = int(np.minimum(counts[q], counts[p]).sum())
            if 175 * most >= 75 * (n[q] + n[p]) and 100 * min(n[q], n[p]) >= 75 * max(n[q], n[p]):
                assert (q, p) in found
    assert all(b == np.minimum(counts[q], counts[p]).sum() for q, p, b in zip(who, point, bound, strict=True))


def test_bound_with_counts_over_a_byte():
    rng = np.random.default_rng(2)
    real = rng.integers(0, 400, (40, jaccard.GROUPS))
    counts, n = np.minimum(real, 255).astype("u1"), real.sum(1)
    a, b = (x.ravel() for x in np.indices((40, 40)))
    over = n - counts.sum(1, dtype=np.int64)
    bound = jaccard.overlap_bound(counts[a], over[a], counts[b], over[b])
    assert (bound >= np.minimum(real[a], real[b]).sum(1)).all() and (bound <= np.minimum(n[a], n[b])).all()


def test_sets_with_one_fingerprint():
    """Sets whose first fingerprint is known to be shared go by their second one."""
    doc, token = np.repeat(np.arange(9), 5), np.arange(45, dtype=np.uint64)
    _, pid, check = jaccard.identity(doc, token, 9)
    _, other, _ = jaccard.identity(doc, token, 9, pid[:2])
    assert (other[:2] == check[:2]).all() and (other[2:] == pid[2:]).all()


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join_in_one_part(spark, monkeypatch, seed):
    """Chains of sets near the threshold that meet in few cells, all in one part."""
    rng = random.Random(seed)
    rows = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(40)]
        start = [rng.choice(words) for _ in range(60)]
        for _ in range(25):
            w = list(rng.choice([start, rows[-1][1].split() if rows and rows[-1][1].startswith(f"c{c}") else start]))
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(1, len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join([f"c{c}", *w[1:]])))
    got = jaccard.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), parts=1).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked(rows)


def test_untried_pairs(spark):
    """Pairs that many cells propose are one each before they meet those already tried."""
    found = spark.createDataFrame([(1, 2, 0)] * 50 + [(1, 3, 0)] * 9 + [(4, 4, 7), (2, 3, 0)], "a long, b long, more long")
    got = jaccard.untried(found, spark.createDataFrame([(2, 3), (8, 9)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3)]
    assert "Join" not in got._jdf.queryExecution().toString()


def test_pairs_of_like_cells_are_proposed_once(spark):
    """Cells of the same points that go to one task propose each pair once, however many they are."""
    counts = bytes([1] * jaccard.GROUPS)
    rows = [(c, 0, i, jaccard.GROUPS, counts, i, 1, 5) for c in range(3_000) for i in range(4)]
    members = spark.createDataFrame(rows, "cell long, block int, pid long, n long, counts binary, label long, asks int, near long")
    got = jaccard.candidates(members, 2, 4).collect()
    assert sorted((r.a, r.b) for r in got if r.a != r.b) == [(i, j) for i in range(4) for j in range(i + 1, 4)]


def test_small_frequent_cells_are_one_block(spark):
    """A frequent token's cell has the blocks that its points need, however many parts its postings came in."""
    rows = [(i, " ".join([*(f"w{j}" for j in range(40)), f"end{i}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    point = jaccard.points(docs, 5, "text", "doc_id")
    classes = point.groupBy("pid").agg(F.min("n").alias("n"))
    frequent = jaccard.frequent_tokens(docs, 5, "text", "doc_id", 4)
    blocks = jaccard.cells(docs, classes, 5, "text", 4, frequent).groupBy("cell").agg(F.countDistinct("block").alias("k"), F.count("*").alias("n")).collect()
    assert len(frequent) and blocks and {(r.k, r.n) for r in blocks} == {(1, 60)}


def test_sketches_bound_the_overlap():
    """Sketches never differ in more bits than the sets in tokens, whatever their lengths, and tell large unrelated sets apart."""
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 63, 120_000).astype(np.uint64))
    few = jaccard.SKETCH_FROM + 1
    sets = [np.sort(rng.choice(pool, m, replace=False)) for m in (few - 1, few, 2_000, 2_500, 9_000, 50_000)]
    sets += [np.sort(np.concatenate((x[: len(x) * 9 // 10], rng.choice(pool, len(x) // 12)))) for x in sets]
    sets = [np.unique(x) for x in sets]
    n = np.array([len(x) for x in sets])
    sketch = np.array(jaccard.sketches(np.repeat(np.arange(len(sets)), n), np.concatenate(sets), n), object)
    assert sketch[0] == b"" and max(map(len, sketch)) == jaccard.SKETCH_BITS // 8
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    least = jaccard.differences(sketch, a, b)
    assert (least <= real).all() and (least[a == b] == 0).all()
    like = 7 * real <= n[a] + n[b]
    apart = (n[a] > few) & (n[b] > few) & (n[a] < 10_000) & (n[b] < 10_000) & (3 * n[a] <= 4 * n[b]) & (3 * n[b] <= 4 * n[a]) & (2 * real > n[a] + n[b])
    assert like.sum() > len(sets) and apart.any() and (7 * least[apart] > (n[a] + n[b])[apart]).all()


def test_large_unrelated_sets_are_not_proposed(spark):
    """Sets of thousands of tokens have like counts, whatever they hold; only a set and its near copy are a pair to compare."""
    rng = random.Random(12)
    text = lambda: [f"u{rng.randrange(10**9)}" for _ in range(6_000)]
    texts = [text() for _ in range(12)]
    texts.append([*texts[0][:5_900], *text()[:80]])
    batch = pa.array([" ".join(t) for t in texts])
    doc, token = jaccard.shingles(Texts(batch, lower=True))
    n = np.bincount(doc)
    counts = [np.minimum(np.bincount((token[doc == i] % np.uint64(jaccard.GROUPS)).astype(int), minlength=jaccard.GROUPS), 255).astype("u1").tobytes() for i in range(len(n))]
    rows = [(c, 0, i, int(n[i]), counts[i], i, 1, x) for c in range(2) for i, x in enumerate(jaccard.sketches(doc, token, n)) if c or i != 5]
    members = spark.createDataFrame(rows, "cell long, block int, pid long, n long, counts binary, label long, asks int, sketch binary")
    pairs = lambda df: {(r.a, r.b) for r in jaccard.candidates(df, 2, 2).collect() if r.a != r.b}
    assert len(pairs(members.drop("sketch"))) > 30
    assert pairs(members) == {(0, 12)}


def test_blocks_are_chosen_from_together(spark, monkeypatch):
    """What a turn proposes is the same whether trees' finds are chosen from block by block or many blocks together."""
    rng = np.random.default_rng(3)
    counts = rng.poisson(1, (60, jaccard.GROUPS)).astype("u1")
    counts[1::2] = counts[::2] * (rng.random((30, jaccard.GROUPS)) > 0.1)
    rows = [(c, k, i, int(counts[i].sum()), counts[i].tobytes(), i, int(i % 3 > 0)) for c in range(4) for k in range(2) for i in rng.choice(60, 40, replace=False).tolist()]
    members = spark.createDataFrame(rows, "cell long, block int, pid long, n long, counts binary, label long, asks int")
    for turn in (0, 1, 2):
        got = []
        for pairs in (1, 1 << 18):
            monkeypatch.setattr(jaccard, "CHOOSE_PAIRS", pairs)
            got.append(sorted(map(tuple, jaccard.candidates(members, turn, 1).collect())))
        assert got[0] == got[1] and got[0]


def test_company_is_of_like_size(spark):
    """Two sets that share a few tokens don't meet because each one is also part of a far larger set."""
    word = lambda g, m: [f"{g}{i}" for i in range(m)]
    shared = word("s", 8)
    rows = [[*word("x", 60), *shared], [*word("z", 60), *shared], [*word("x", 60), *word("v", 300)], [*word("z", 60), *word("w", 500)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    classes = jaccard.points(docs, 5, "text", "doc_id").select("pid", "n")
    assert jaccard.cells(docs, classes, 5, "text", 4, np.zeros(0, np.uint64)).count() == 0
    near = spark.createDataFrame([(0, " ".join(rows[0])), (1, " ".join([*rows[0], "end"]))], "doc_id long, text string")
    classes = jaccard.points(near, 5, "text", "doc_id").select("pid", "n")
    assert jaccard.cells(near, classes, 5, "text", 4, np.zeros(0, np.uint64)).select("pid").distinct().count() == 2


def test_first_turns_ask_in_few_cells(spark, monkeypatch):
    """In the turn after the first links a point asks in FIRST_CELLS of its cells at most; the links stay the same."""
    asked = []
    candidates = jaccard.candidates

    def counted(members, turn, parts):
        if turn == 1:
            asked.append(members.filter("asks = 1").groupBy("pid").count().agg({"count": "max"}).first()[0] or 0)
        return candidates(members, turn, parts)

    monkeypatch.setattr(jaccard, "candidates", counted)
    monkeypatch.setattr(jaccard, "FIRST_CELLS", 1)
    rng = random.Random(6)
    words = [f"v{i}" for i in range(400)]
    rows, start = [], [rng.choice(words) for _ in range(80)]
    for i in range(60):
        w = list(start)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        start = w if i % 6 == 0 else start
        rows.append((i, " ".join(w)))
    got = jaccard.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == linked(rows)
    assert asked and max(asked) <= 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_few_rows_take_few_tasks(spark, monkeypatch):
    """Steps that are made again and again don't go to all partitions, where Spark doesn't bring these together; many rows still do."""
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = components.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long"))
        assert {r.root for r in found.collect()} == {0} and found.rdd.getNumPartitions() <= LEAST_TASKS
        rows = spark.createDataFrame([(1, 0, i, 20, bytes(jaccard.GROUPS), i, 1) for i in range(9)], "cell long, block int, pid long, n long, counts binary, label long, asks int")
        assert jaccard.candidates(rows, 1, 5).rdd.getNumPartitions() == 5
        assert fewer(rows.repartition(60, "pid"), 10**9, 10**6).rdd.getNumPartitions() == 60
        dealt, candidates = [], jaccard.candidates
        monkeypatch.setattr(jaccard, "candidates", lambda members, turn, parts: dealt.append(parts) or candidates(members, turn, parts))
        text = " ".join(f"w{i}" for i in range(40))
        assert {r.component_id for r in jaccard.ngram_join(spark.createDataFrame([(i, f"{text} end{i}") for i in range(4)], "doc_id long, text string")).collect()} == {0}
        assert len(dealt) > 1 and max(dealt) <= LEAST_TASKS
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut_out(rows):
    seen, out = set(), {}
    for i, b in sorted({(LOWEST if i is None else i, (t or "").encode()) for i, t in rows}):
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i, b] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return Counter((i, *out[LOWEST if i is None else i, (t or "").encode()]) for i, t in rows)


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:  # many cells, hot anchors and several indexes in a shard
        monkeypatch.setattr(suffix, "HOT", 3)
        monkeypatch.setattr(suffix, "CELL", 128)
        monkeypatch.setattr(suffix, "INDEX_BYTES", 3000)
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh éü") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    pool = [text(n) for n in (15, 20, 25, 30, 60, 200)]
    rows = [(None, None), (1, ""), (2, "x"), (None, pool[5]), (3, "a" * 500), (4, "ab" * 300), (5, "a" * 120 + "b" + "a" * 150), (6, pool[4]), (6, pool[4]), (7, pool[4] + pool[5])]
    for i in range(100):
        x = text(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            q = rng.choice(pool)
            x += q[(a := rng.randrange(len(q))) : a + rng.randrange(60, 260)] + text(rng.randrange(5))
        rows.append((100 + i * 37 % 121, x))
    got = suffix.digest(suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter(map(tuple, got.collect())) == cut_out(rows)


def test_repeats_in_many_parts(spark, monkeypatch):
    """Parts and shards grow in number with the texts, and a task judges several, one after another."""
    dealt = []
    pack = suffix._pack_anchors
    monkeypatch.setattr(suffix, "_pack_anchors", lambda parts: dealt.append(parts) or pack(parts))
    monkeypatch.setattr(suffix, "PART_BYTES", 500)
    monkeypatch.setattr(suffix, "CLASSES", 2)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(400)) for _ in range(3)]
    rows = [(-1, base[0] * 2)]
    for i in range(90):
        x = list(base[i % 3])
        for _ in range(2):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        rows.append((i, "".join(x)))
    got = suffix.digest(suffix.repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter(map(tuple, got.collect())) == cut_out(rows)
    assert dealt == [-(-sum(len(t) for _, t in rows) // 500)]


def test_cells_of_many_near_copies_are_small():
    """An index takes a cell whole: 100 anchors of one stretch, each with 900 different surroundings, aren't one cell."""
    n, near = 100, 900
    a = np.repeat(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), near)
    c = np.arange(n * near, dtype=np.uint64)
    packed = (a.tobytes(), c.tobytes(), np.tile(np.arange(near, dtype="<u2"), n).tobytes(), np.repeat(np.arange(n, dtype="<u4") * 39, near).tobytes(), np.arange(near, dtype="<i8").tobytes(), np.zeros(near, "<i8").tobytes(), np.zeros(near, "<u4").tobytes())
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], suffix._PACKED)
    routes = np.concatenate([np.frombuffer(x, "<u8") for b in suffix._judge_anchors()(iter([batch])) for x in b.column("routes").to_pylist()])
    assert len(routes) == n * near
    assert np.unique(routes, return_counts=True)[1].max() * (suffix.SPAN + suffix.LONG) < 2 * suffix.INDEX_BYTES


def test_repeats_edges(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect() if r.doc_id != 12]
    docs = awkward.filter("doc_id IS NULL OR doc_id <> 12")
    assert Counter(map(tuple, suffix.digest(suffix.repeats(docs)).collect())) == cut_out(rows)
    assert suffix.repeats(awkward.limit(0)).count() == 0
    left = suffix.without_repeats(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count()


@pytest.mark.parametrize("n,letters", [(1, 1), (7, 1), (8, 2), (60, 1), (300, 2), (300, 4)])
def test_run_length_index(n, letters):
    rng = random.Random(n)
    t = np.array([97 + rng.randrange(letters) for _ in range(n)], np.uint8)
    b = t.tobytes()
    order = sorted(range(n), key=lambda i: b[i:])
    assert suffix.suffix_array(t).tolist() == order
    index = suffix.RunIndex(t)
    assert len(index.run_start) == len(index.sample)
    source, length = index.stream()
    for before, at in zip([None, *order], order, strict=False):
        same = 0
        while before is not None and max(at, before) + same < n and b[at + same] == b[before + same]:
            same += 1
        assert length[at] == same and (not same or source[at] == before)


def test_store_round_trip(spark, awkward):
    path, file = shared_dir(spark, "store"), public_tokenizers.path("byte_bpe_50k.json")
    store.write_store(awkward, path, file, 2, shard_rows=5)
    store.check_roots(spark, path)
    tok = Tokenizer.from_file(file)
    rows = sorted(((r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    assert Counter((r.doc_id, tuple(r.ids)) for r in store.reconstruct(spark, path).collect()) == Counter((i, tuple(x)) for (i, _), x in zip(rows, ids, strict=True))
    index = sorted(store.document_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in index] == [i for i, _ in rows]
    at = 0
    for r in index:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True))
    chunks = spark.read.parquet(path).filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_finds_damage(spark, awkward):
    path, bad = shared_dir(spark, "store"), shared_dir(spark, "store")
    store.write_store(awkward, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    whole = spark.read.schema(store.SCHEMA).parquet(path)
    whole.filter("NOT (kind = 'recipe' AND doc_id = 3)").write.partitionBy("kind").parquet(bad)
    with pytest.raises(ValueError, match="manifest"):
        store.check_roots(spark, bad)
    bad = shared_dir(spark, "store")
    whole.withColumn("payload", F.when(F.col("kind") == "chunk", F.reverse(F.col("payload").cast("string")).cast("binary")).otherwise(F.col("payload"))).write.partitionBy("kind").parquet(bad)
    with pytest.raises(Exception, match="digest"):
        store.document_index(spark, bad).collect()


def test_shared_passage_is_stored_once():
    rng = np.random.default_rng(4)
    ids = lambda n: rng.integers(0, 50_000, n).astype("<u2")
    passage = ids(500)
    streams = [np.concatenate((ids(100), passage, ids(100))) for _ in range(40)]
    size = np.array([len(x) for x in streams])
    ids = np.concatenate(streams)
    ends = store.cuts(ids, np.append(0, np.cumsum(size)))
    assert set(np.cumsum(size)) <= set(ends) and np.diff(ends, prepend=0).max() <= store.LONGEST
    chunks = {ids[a:e].tobytes(): e - a for a, e in zip([0, *ends], ends, strict=False)}
    assert sum(chunks.values()) < 0.6 * sum(map(len, streams))


def test_store_of_nothing(spark, awkward):
    path = shared_dir(spark, "store")
    store.write_store(awkward.limit(0), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert store.document_index(spark, path).count() == 0


def test_schedule_stays_within_a_block():
    rng = random.Random(1)
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"x": 1}, {f"s{i}": rng.random() for i in range(40)}):
        share = mixing.shares(weights, 1000)
        n, had = sum(share.values()), dict.fromkeys(share, 0)
        assert n == 1000
        for s, j, release, due, slot in mixing.schedule(share):
            assert release <= slot < due and had[s] == j
            had[s] += 1
            assert all(abs(had[k] - share[k] * (slot + 1) / n) < 1 for k in share)


def test_mix(awkward):
    got = mixing.mix(awkward, {"s0": 0.6, "s1": 0.3, "s2": 0.1}, block_bytes=500).collect()
    assert Counter(r.doc_id for r in got if r.pass_no == 0) == Counter(r.doc_id for r in awkward.select("doc_id").collect())
    slot = {}
    for r in got:
        assert r.release <= r.slot < r.deadline and slot.setdefault(r.slot, r.source) == r.source
    assert mixing.mix(awkward.limit(0)).count() == 0
    whole = mixing.mix(awkward, whole=True)
    assert whole.columns == awkward.columns and {r.doc_id for r in whole.collect()} == {r.doc_id for r in awkward.collect()}


def test_mix_with_odd_weights_and_many_sources(spark, awkward):
    ids = Counter(r.doc_id for r in awkward.select("doc_id").collect())
    first = lambda df: Counter(r.doc_id for r in df.filter("pass_no = 0").collect())
    assert first(mixing.mix(awkward, weights={"s0": 0.0, "s1": -1})) == ids
    assert first(mixing.mix(awkward, weights={"s0": 3.0, None: 1.0})) == ids
    docs = spark.createDataFrame([(i, f"w{i} " * 40, f"s{i % 30}") for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix(docs, block_bytes=400, most_sources=10)
    assert first(got) == Counter(range(300)) and all(r.source == f"s{r.doc_id % 30}" for r in got.collect())
    # Rows without an id are many buckets.
    bare = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long")), block_bytes=400, bucket_rows=10)
    assert bare.filter("pass_no = 0").count() == 300 and bare.select(F.col("place") / (1 << 32)).distinct().count() > 20


def test_pools_have_the_weights_of_their_sources(spark):
    docs = spark.createDataFrame([(i, "x" * 100, f"s{i % 8}") for i in range(1600)], "doc_id long, text string, source string")
    weights = {f"s{k}": k + 1.0 for k in range(8)}
    for given, power in ((weights, 0.7), (None, 0.5)):
        got = mixing.mix(docs, given, block_bytes=100, power=power, most_sources=4).collect()
        pool = {s: "own" if given and s in ("s7", "s6") or not given and s in ("s0", "s1") else "pool" for s in weights}
        target = {"own": sum(weights[s] if given else 1 for s in weights if pool[s] == "own"), "pool": sum(weights[s] if given else 1 for s in weights if pool[s] == "pool")}
        part = Counter(pool[r.source] for r in got if r.slot < 200)
        assert abs(part["own"] - 200 * target["own"] / sum(target.values())) <= 4


def test_every_source_keeps_its_weight_however_many_there_are(spark):
    docs = spark.createDataFrame([(i, "x" * 100, f"s{i % 12}") for i in range(1200)], "doc_id long, text string, source string")
    weights = {f"s{k}": (k + 1.0) ** 2 for k in range(12)}
    for groups in (2, 3, 100_000):
        got = mixing.mix(docs, weights, block_bytes=100, most_sources=groups).collect()
        assert all(r.release <= r.slot < r.deadline for r in got)
        part = Counter(r.source for r in got if r.slot < 650)
        assert all(abs(part[s] - w) < 3 for s, w in weights.items())


def test_order_does_not_depend_on_buckets(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 40), f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    one, many = (sorted(tuple(r) for r in mixing.mix(docs, block_bytes=400, bucket_rows=n).collect()) for n in (7, 1000))
    assert one == many


def test_small_weights_have_a_period_that_they_fit_in():
    for target in ({"a": 1.0, "b": 1e-5}, {"a": 3.0, "b": 3e-4, "c": 1.0}, {"a": 1.0}, {f"s{i}": 1.0 + i for i in range(3000)}):
        share = mixing.shares(target, mixing.period_for(target))
        n = sum(share.values())
        assert all(abs(share[s] - n * w / sum(target.values())) <= 1 for s, w in target.items())
    assert mixing.period_for({"a": 1.0, "b": 1e-12}) == mixing.MOST_PERIOD


def test_shares():
    rng = random.Random(6)
    for _ in range(40):
        w = {f"s{i}": rng.random() ** 4 for i in range(rng.randrange(1, 60))}
        k = mixing.shares(w, 100)
        assert sum(k.values()) == 100 and min(k.values()) >= 1


def test_packing(spark, awkward):
    file = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    want = Counter()
    for r in awkward.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p : p + 4096], "<u4")
            want[r.doc_id, p // 4096, p, len(part), zlib.crc32(part.tobytes())] += 1
    got = packing.pack_documents(awkward, file).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == math.ceil(sum(r.length for r in got) / 4096)
    assert packing.pack_documents(awkward.limit(0), file).count() == 0


def test_local_search_empties_a_bin():
    sizes = np.array([5, 5, 6, 4, 3, 3, 4])
    bins = packing.local_search([[0, 4], [1, 5], [2], [3, 6]], sizes, 10)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7)) and all(sizes[b].sum() <= 10 for b in bins)


def test_local_search_leaves_no_exchange():
    """Against brute force: no move, one-for-one or two-for-one exchange of any two underfull bins raises the squared fill."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = rng.integers(1, 30, 60)
        first = packing.best_fit(sizes, 50) if rng.random() < 0.5 else [[i] for i in range(60)]
        bins = packing.local_search(first, sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(60)) and all(b and sizes[b].sum() <= 50 for b in bins)
        fill = [int(sizes[b].sum()) for b in bins]
        for g, giver in enumerate(bins):
            sums = {int(sizes[a]) for a in giver} | {int(sizes[a] + sizes[b]) for k, a in enumerate(giver) for b in giver[k + 1 :]}
            for t, taker in enumerate(bins):
                for gain in (s - back for s in sums for back in {0, *sizes[taker].tolist()}):
                    if g != t and max(fill[g], fill[t]) < 50 and 0 < gain <= 50 - fill[t]:
                        assert (fill[t] + gain) ** 2 + (fill[g] - gain) ** 2 <= fill[t] ** 2 + fill[g] ** 2


def test_merkle_root_level_by_level():
    for n in range(1, 40):
        leaves = [bytes([i]) for i in range(n)]
        tree = store.Merkle()
        for x in leaves:
            tree.add(x)
        while len(leaves) > 1:
            leaves = [hashlib.blake2b(b"".join(leaves[i : i + 2]), digest_size=store.DIGEST).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        assert tree.root() == leaves[0]


def test_range_bounds(spark):
    ids = spark.range(0, 100_000, 1, 8).select((F.col("id") * 7 - 1000).alias("doc_id"))
    bounds = range_bounds(ids, "doc_id", 20)
    assert len(bounds) == 4_999  # five thousand ranges
    n = np.bincount(np.searchsorted(bounds, np.arange(100_000) * 7 - 1000), minlength=5_000)
    assert n.min() >= 10 and n.max() <= 40


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:140] = x[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(9000, None, "x"), (9020, [0.0] * 16, "x"), (9040, [float("nan")] * 16, "x"), (9060, [1.0] * 5, "x"), (None, [1.0] * 16, "x"), (9080, [1.0, None] + [0.0] * 14, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(3000), -s))[:20]) & {i for i, _ in found})
        assert len(found) == 20 and [f[1] for f in found] == sorted((f[1] for f in found), reverse=True) and np.allclose([s[i] for i, _ in found], [f[1] for f in found])
    assert hit >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[120]][:20] == sorted(i for i, _ in got[120])[:20] or max(s for _, s in got[120]) > x[100] @ x[100]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    # Rows that repeat an id are queries and candidates each: of the three, each finds the other two.
    again = df.filter("vec_id < 60").unionByName(spark.createDataFrame([(40, x[40].tolist(), "x"), (40, (-x[40]).tolist(), "x")], df.schema))
    found = [r for r in ann.nearest(again, F.col("vec_id") % 20 == 0).collect() if r.query_id == 40]
    assert len(found) == 60 and sorted(r.rank for r in found) == sorted(list(range(1, 21)) * 3)
    assert sum(r.vec_id == 40 and np.isclose(r.score, x[40] @ x[40]) for r in found) == 2
    assert ann.nearest(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).count() == 2


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append({r.doc_id: r.text for r in docs.collect()})
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect() if r.doc_id in kept[0]]
    assert set(kept[1]) == {c for _, _, c in linked(rows)}
    rows = [(i, t) for i, t in rows if i in kept[1]]
    assert Counter((i, len(t.encode())) for i, t in kept[2].items()) == Counter((i, n - gone) for i, n, gone, _, _ in cut_out(rows)) or all(t.isascii() is False for i, t in kept[2].items() if len(t.encode()) != {x[0]: x[1] - x[2] for x in cut_out(rows)}[i])
    assert kept[3] == kept[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == set(kept[3]) and {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == set(kept[3])
