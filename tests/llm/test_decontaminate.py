"""Decontamination and its FM-index against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from vellum.llm import decontaminate as D
from vellum.llm import queries
from vellum.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=10):
    phrases = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[p]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def run(docs, items, **more):
    got = D.digest(D.contamination(docs, items, **more)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("letters", [1, 2, 9])
def test_index_finds_every_place(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(0, letters + 1, 700)
    text[-1] = 0
    index = FMIndex(text)
    phrases = np.array([[*rng.integers(1, letters + 1, n), *[0] * (6 - n)] for n in rng.integers(1, 7, 200)])
    length = (phrases > 0).sum(1)
    lo, hi = index.search(phrases, length)
    for p, n, a, b in zip(phrases, length, lo, hi, strict=True):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def texts(rng, items, n):
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            w = WORD.findall(rng.choice(items)[1] or "x")
            a = rng.randrange(len(w))
            parts.append(rng.choice(["; ", " ", "\n- "]).join(w[a : a + rng.randint(1, 14)]))
            parts.append(" ".join(rng.choice(["Foo", "bar", "w1", "w2", "ä"]) for _ in range(rng.randint(0, 3))))
        out.append((i, rng.choice([" ", " | "]).join(parts)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(["W1", "w2", "w3", "Ä", "é", "7"]) for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(12)]
    docs = texts(rng, items, 80)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert run(df, bench) == want
    assert run(df, bench, shard_bytes=200) == want  # many shards, texts in pieces
    assert run(df, bench, block_words=40) == want  # several blocks of items


def test_awkward_rows(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    long = next(t for _, t in docs if t and len(t) > 50_000)
    items = [(1, long[200:300]), (1, long[-300:]), (2, None), (3, ""), (None, "one"), (4, "é ü"), (5, docs[5][1]), (5, docs[5][1]), (6, "no such words anywhere here"), (7, "a" * 3000)]
    bench = spark.createDataFrame([(*i, "x", 3) for i in items], "item_id long, text string, k string, n long")
    assert run(awkward, bench) == brute(docs, items)
    assert run(awkward, bench, shard_bytes=3000) == brute(docs, items)
    assert run(awkward, bench.limit(0)) == brute(docs, [])
    assert run(awkward, bench.filter("item_id = 2")) == brute(docs, [])
    assert run(awkward.limit(0), bench) == []


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WORDS", 7)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([4, 40, 41])))) for i in range(6)]
    docs = texts(rng, items, 30)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert run(df, bench) == brute(docs, items)


def test_other_words_with_a_phrase_words_hash_do_not_count(monkeypatch):
    import pyarrow as pa

    phrases = D.Phrases([("i", ["aa", "bb", "cc"])], 3)
    monkeypatch.setattr(D.Texts, "span_hash", lambda self, a, b: np.full(len(a), phrases.hashes[0]))  # all words collide
    found = D._found(pa.array([b"aa bb cc", b"x y z"], pa.large_binary()), phrases, 3, 1000)
    assert found[0].tolist() == [3, 3] and found[1][1] == [] and found[2][1] == []


def test_cleaned_texts_lack_the_passages(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"Before, é {passage.upper()}! After"), (2, "clean"), (3, None), (4, passage), (5, f"{passage} x {passage}")]
    found = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string"), whole=True)
    got = {r.doc_id: r.text for r in D.cleaned(found).collect()}
    assert got == {1: "Before, é ! After", 2: "clean", 3: None, 4: "", 5: " x "}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    assert spans[5] == [(0, 12, 0, len(passage)), (13, 25, len(passage) + 3, 2 * len(passage) + 3)]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_benchmark_decontamination(spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)
