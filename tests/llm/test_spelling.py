"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from vellum.llm import queries, spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_length=6, least_count=5, times=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}
    out, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if abs(len(x) - len(w)) <= 1 and x != w and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * n else None
        out[w] = (len(close), words.get(form[w]))
    result = set()
    for w, n in words.items():
        last = w
        while form[last]:
            last = form[last]
        result.add((w, form[w], last, n, *out[w]))
    return result


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def texts(rng, n, letters):
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(60)]
    words += [w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in words for i in (rng.randrange(len(w)), rng.randrange(len(w)))]
    weight = [rng.random() ** 4 + 0.002 for _ in words]
    return [(i, rng.choice([" ", ", ", "\n", "1"]).join(rng.choices(words, weight, k=rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("hot", [4, 50, spelling.HOT])
def test_equals_brute_force(spark, hot):
    rng = random.Random(hot)
    rows = texts(rng, 120, "abé") + texts(rng, 60, "abcdefgÉß")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for count in (1, 3):
        assert rows_of(spelling.variants(docs, least_count=count, times=2, hot=hot)) == brute(rows, least_count=count, times=2)


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert rows_of(spelling.variants(awkward, least_count=1)) == brute(rows, least_count=1)
    assert spelling.variants(awkward.limit(0)).count() == 0
    assert spelling.variants(awkward.filter("text IS NULL")).count() == 0


def test_long_text_in_pieces_counts_once(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(7, " ".join("".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(4000)))]
    monkeypatch.setattr(spelling, "PIECE", 100)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_chain_leads_to_its_end(spark):
    words = {"aaaaaa": 1, "aaaaab": 6, "aaaabb": 40, "aaabbb": 300, "zzzzzz": 2}
    rows = [(i, w) for w, n in words.items() for i in range(n)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1).collect()}
    want = {r[0]: (r[1], r[2]) for r in brute(rows, least_count=1)}
    assert got == want and got["aaaaaa"] == ("aaaaab", "aaabbb")


def test_scan_finds_each_pair_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))).encode() for _ in range(500)})
    group = np.repeat([0, 1], [len(words), len(words)])
    i, j = spelling.Lists(words * 2, group).one_edit(np.arange(0, 2 * len(words), 2))
    got = list(zip(i.tolist(), j.tolist(), strict=True))
    n = len(words)
    want = {(x, y) for x in range(0, 2 * n, 2) for y in range(2 * n) if x // n == y // n and words[x % n] != words[y % n] and near(words[x % n].decode(), words[y % n].decode())}
    assert len(got) == len(set(got)) and set(got) == want


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op11_spelling_variants(spark, SF)) == brute(rows)
