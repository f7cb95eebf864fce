"""Operators on single texts: quality rules, weak labels, token counts, toxicity."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF
from vellum.llm import encode, quality, tokencount, toxicity, weak

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  ", "a<|endoftext|>b  <|endoftext|> c", "ΑΣΣΑΣ Σ ΟΔΟΣ", "İstanbul don't I'LL 123 ½ a\x1cb a\x85b 東京 🎉🎉!!", "a b\x1fc  \n\n x. y.) .. z.5 hé.Ωa .\n\n", "aaaa" * 700, "Å e\ń. ab́ x.,!?y can't.'s", "<|ENDOFTEXT|> <|startoftext|>x"]


def stats(x):
    x = x or ""
    w = WORD.findall(x)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, under, seen, dup = Counter(win), set(), set(), 0
    for i, v in enumerate(win):
        if n[v] > 1:
            under.update(range(i, i + 5))
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), dup, len(under)


def by_text(df, docs):
    return sorted(map(str, df.collect())), [r.text for r in docs.select("doc_id", "text").collect()]


def test_quality_rules(awkward, tagged):
    got = quality.quality_rules(awkward, tagged).collect()
    assert len(got) == awkward.count()
    want = Counter((r.doc_id, *stats(r.text)) for r in awkward.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.quality_rules(awkward.limit(0), tagged).count() == 0
    assert all(r.llr == 0 for r in quality.quality_rules(awkward, tagged.limit(0)).collect())
    kept = quality.keep_good(awkward, tagged)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in got)


def slots(text):
    b = (text or "").encode()
    return [(int.from_bytes(b[i : i + 4], "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48 for i in range(len(b) - 3)]


def log_ratio(top, bottom):
    """Log ratio of two multinomials over the slots, add-one counts."""
    a, b = sum(top.values()) + quality.SLOTS, sum(bottom.values()) + quality.SLOTS
    return lambda s: math.log((top.get(s, 0) + 1) / a) - math.log((bottom.get(s, 0) + 1) / b)


def test_llr_by_brute_force(awkward, tagged):
    rows = [(r.doc_id, slots(r.text)) for r in awkward.select("doc_id", "text").collect()]
    trusted = {r.doc_id for r in tagged.collect() if r.quality == 1 and r.doc_id is not None}
    raw, target = Counter(), Counter()
    for i, g in rows:
        raw.update(g)
        target.update(g if i in trusted else [])
    w = log_ratio(target, raw)
    place = lambda x: (-1 if x[0] is None else x[0], x[1])
    want = sorted(((i, sum(map(w, g)) / max(len(g), 1)) for i, g in rows), key=place)
    got = sorted(((r.doc_id, r.llr, r.base_failed, r.kept) for r in quality.quality_rules(awkward, tagged).collect()), key=place)
    assert [r[0] for r in got] == [i for i, _ in want]
    assert all(abs(r[1] - y) < 1e-7 and (r[3] == (not r[2] and r[1] >= -0.5)) for r, (_, y) in zip(got, want, strict=True))


def test_weak_scores_by_brute_force(spark):
    """From the posteriors: the scorer's weights, every score, the threshold and what is kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: slots(r.text) for r in docs.select("doc_id", "text").collect()}
    got = weak.classify(docs).collect()
    good, bad = defaultdict(float), defaultdict(float)
    for r in got:
        for g, n in Counter(text[r.doc_id]).items():
            good[g] += r.posterior * 1000 * n / len(text[r.doc_id])
            bad[g] += (1 - r.posterior) * 1000 * n / len(text[r.doc_id])
    w = log_ratio(good, bad)
    assert all(abs(r.score - sum(map(w, text[r.doc_id])) / max(len(text[r.doc_id]), 1)) < 3e-6 for r in got)
    at = {r.doc_id: math.floor(r.score / weak.BIN) for r in got}
    cost = lambda cut: round(sum(3 * r.posterior if at[r.doc_id] < cut else 1 - r.posterior for r in got), 3)
    cuts = sorted(set(at.values())) + [math.inf]
    best = min(cuts, key=lambda c: (cost(c), c))
    assert all(r.kept == (r.score >= best * weak.BIN) for r in got) and 0 < sum(r.kept for r in got) < len(got)


def test_quality_rules_tell_junk(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_rules(docs, labels).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in found}
    assert n.get((0, True), 0) == 0 and n.get((1, False), 0) == 0 and n[1, True] > 200


def test_weak_labels(spark, awkward):
    assert weak.classify(awkward).count() == awkward.count()
    assert weak.classify(awkward.limit(0)).count() == 0
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    n = {(r.quality, r.kept): r["count"] for r in weak.classify(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0))


def test_em_finds_the_bad_kind():
    import numpy as np

    v = np.array([[1] * weak.N, [1, 0, 0] + [1] * (weak.N - 3), [1, 1, 1, 0, 0] + [1] * (weak.N - 5)])
    share, _, post = weak.em(v, np.array([900.0, 50, 50]))
    assert post[0] > 0.99 and post[1] < 0.1 and post[2] < 0.1 and abs(share[0] - 0.9) < 0.02


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(spark, file):
    import pyarrow as pa

    path = public_tokenizers.path(file)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encode.Encoder(path).encode(pa.array(texts))] == want
    if file.startswith("word"):
        merges = tokencount.Merges(path)
        assert [tokencount.count_text(t or "", merges) for t in texts] == [len(w) for w in want]


def test_token_counts(awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in awkward.select("doc_id", "text").collect())
    assert Counter(map(tuple, tokencount.token_counts(awkward, path).collect())) == want
    assert tokencount.token_counts(awkward.limit(0), path).count() == 0


def test_token_counts_of_every_character():
    """Assigned or not, alone, after letters and between them; some hundred in each text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, merges = Tokenizer.from_file(path), tokencount.Merges.of(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"{c} bz{c} x{c}y" for c in points[i : i + 200]) for i in range(0, len(points), 200)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        assert [tokencount.count_text(t, merges) for t in part] == [len(e.ids) for e in tok.encode_batch_fast(part, add_special_tokens=False)]


def test_token_counts_of_random_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, merges, rng = Tokenizer.from_file(path), tokencount.Merges.of(path), random.Random(5)
    kinds = [[chr(c) for c in range(0x20, 0x250)], [chr(c) for c in range(0x300, 0x370)], [chr(rng.randrange(0xE000, 0x110000)) for _ in range(4000)], [chr(c) for c in range(0x250, 0x3000)], ["'s", "'LL", "İ", "\u212a", "\u2001", "\x85", "\x1c", "<|endoftext|>", " "]]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    assert [tokencount.count_text(t, merges) for t in texts] == [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_counts_of_another_vocabulary_are_refused():
    with pytest.raises(ValueError, match="another way"):
        tokencount.Merges(public_tokenizers.path("byte_bpe_50k.json"))


def test_toxicity(spark, awkward, tagged):
    got = toxicity.toxicity(awkward, tagged, sample_rows=10).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert toxicity.toxicity(awkward.limit(0), tagged).count() == 0
    assert {r.score for r in toxicity.toxicity(awkward, tagged.limit(0)).collect()} == {0.5}


def test_toxicity_scores_by_brute_force(spark):
    """All pairs of a text's features, one by one, give the score that the query returns."""
    import pyarrow as pa

    from vellum.llm.textbytes import Texts

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    some = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 1500][:12]
    for r in some:
        _, row, rest = machine.terms.of(Texts(pa.array([r.text or ""]), lower=True))
        x = {**{int(k): 1.0 for k in row}, toxicity.OWN: float(rest[0])}
        y = machine.bias + sum(machine.linear[k] * v for k, v in x.items())
        y += sum(float(machine.factors[a] @ machine.factors[b]) * x[a] * x[b] for a in x for b in x if a < b)
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-min(max(y, -30), 30)))) < 1e-6
    assert len(some) == 12


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in found}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_pairs_count_beyond_single_terms():
    """Neither term alone is toxic, both together are: a factorization machine learns it."""
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((2000, 6)) < 0.4
    y = (x[:, 0] & x[:, 1]).astype(np.int64)
    doc, row = np.nonzero(x)
    w0, w, v = toxicity.fit(doc, row, y, 6, steps=1500)
    s = x @ v
    score = w0 + x @ w + 0.5 * (s**2 - x @ v**2).sum(1)
    assert ((score > 0) == (y == 1)).mean() > 0.98


def _rare_pairs(seed=2):
    """Texts and labels: thousands of telling words, and two rare words that are toxic only together."""
    rng = random.Random(seed)
    word = lambda kind, n: kind + "".join(chr(97 + int(d)) for d in f"{n:04d}")
    rows = []
    for _ in range(3000):
        toxic = rng.random() < 0.4
        rows.append((" ".join([word("q" if toxic else "z", rng.randrange(3000)) for _ in range(60)]), int(toxic)))
    for i in range(450):
        rare = ["snarl", "tribe", "snarl tribe"][i % 3]
        rows.append((" ".join([*(word(rng.choice("qz"), rng.randrange(3000)) for _ in range(6)), rare]), int(i % 3 == 2)))
    rng.shuffle(rows)
    return rows


def test_toxicity_of_a_pair_of_rare_terms(spark):
    rows = _rare_pairs()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    assert (machine.linear != 0).sum() > 4096
    import pyarrow as pa

    from vellum.llm.textbytes import Texts

    base = [t.rsplit(" ", 1)[0] for t, _ in _rare_pairs(9) if len(t) < 100]
    none, one, other, both = (machine.score(Texts(pa.array([t + rare for t in base]), lower=True)) for rare in ("", " snarl", " tribe", " snarl tribe"))
    assert both.mean() > max(one.mean(), other.mean()) + 0.25 and (both > 0.5).mean() > 0.8
    assert max(one.mean(), other.mean()) < 0.5
    terms = [toxicity.term_slots(Texts(pa.array([w]), lower=True))[1] for w in ("snarl", "tribe")]
    pair = sum(float(machine.factors[a] @ machine.factors[b]) for a in terms[0] for b in terms[1])
    assert pair > 0.1


def test_toxicity_sample_is_bounded_by_terms_and_repeated_keys_count_once(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb"), (1, "aaaa bbbb cccc dddd"), (2, None), (3, "eeee"), (3, "eeee"), (None, "ffff")], "doc_id long, text string")
    import numpy as np

    rows = docs.selectExpr("doc_id AS k", "text AS t")
    place, doc, slot = toxicity.sample_terms(rows, np.array([3, 1, 2]), 1000)
    assert place.tolist() == [0, 1, 2] and np.bincount(doc, minlength=3).tolist() == [2, 8, 0] and len(slot) == 10
    place, doc, slot = toxicity.sample_terms(rows, np.array([3, 1, 2]), 9)
    assert place.tolist() == [0] and len(slot) == 2
    assert [len(a) for a in toxicity.sample_terms(rows, np.array([3, 1]), 1)] == [0, 0, 0]


def test_trusted_id_of_minus_one_is_no_null_key(spark):
    docs = spark.createDataFrame([(-1, "good words"), (None, "bad words"), (None, "worse words")], "doc_id long, text string")
    import numpy as np

    sums = quality.gram_counts(docs, np.array([-1])).selectExpr("sum(raw) AS raw", "sum(target) AS target").first()
    assert (sums.raw, sums.target) == (7 + 6 + 8, 7)
