"""Quality classifier from weak labels: EM over overlapping heuristics, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.quality import SLOTS, gram_slots, sum_by_gram, text_stats
from vellum.llm.shared import settle
from vellum.llm.textbytes import Texts, slices

#: The heuristic labellers, in order. Each votes 1 (good), 0 (bad) or 2 (abstains).
LABELLERS = ("length", "repetition", "adjacent", "symbols", "letters", "wordless", "capitals", "lines", "sentences")
N = len(LABELLERS)
#: Labellers that each begin one kind of bad document.
SEEDS = ("repetition", "symbols", "capitals")
#: Width of the bins of scores among which the threshold is chosen.
BIN = 0.01


def votes(t: Texts) -> np.ndarray:
    """Votes of the labellers on each document of a batch: one row per document."""
    s = text_stats(t)
    n = np.maximum(s["n_words"], 1)
    upper = t.sum_by_doc((t.buf >= 65) & (t.buf <= 90))
    lower = t.sum_by_doc((t.buf >= 97) & (t.buf <= 122))
    marks = t.sum_by_doc((t.buf == 33) | (t.buf == 63))
    lines = t.sum_by_doc(t.buf == 10) + 1
    repeat = s["n_repeat_words"] / n
    symbols = s["n_symbols"] / n
    capitals = upper / np.maximum(upper + lower, 1)
    stops = t.sum_by_doc(t.buf == 46)
    enough = s["n_words"] >= 20  # shares of fewer words say little
    letter = ((t.buf | 32) >= 97) & ((t.buf | 32) <= 122) | (t.buf >= 128)
    letters = t.sum_by_doc(letter) / np.maximum(t.sum_by_doc(t.buf > 32), 1)
    start, end = t.words()
    bounds = t.per_doc(start)
    seen = np.concatenate((np.zeros(1, np.int64), np.cumsum(letter)))
    bare = np.concatenate((np.zeros(1, np.int64), np.cumsum(seen[end] == seen[start])))
    wordless = np.diff(bare[bounds]) / n
    h = t.span_hash(start, end)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[bounds[:-1][bounds[:-1] < len(h)]] = False
    again = np.concatenate((np.zeros(1, np.int64), np.cumsum(same)))
    adjacent = np.diff(again[bounds]) / n

    def vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, 2))

    return np.stack(
        (
            vote(s["n_words"] >= 30, s["n_words"] < 5),
            vote(repeat <= 0.05, repeat > 0.50),
            vote(adjacent <= 0.02, adjacent > 0.15),
            vote(symbols <= 0.02, symbols > 0.20),
            vote(letters >= 0.93, enough & (letters < 0.88)),
            vote(wordless <= 0.03, enough & (wordless > 0.15)),
            vote(capitals <= 0.25, capitals > 0.60),
            vote(s["n_dup_lines"] == 0, s["n_dup_lines"] > 0.5 * lines),
            vote((stops > 0) & (marks <= 0.3 * n), (marks > 0.5 * n) | ((stops == 0) & (s["n_words"] > 30))),
        ),
        1,
    )


def patterns(v: np.ndarray) -> np.ndarray:
    """One number from 0 to 3**N - 1 for each row of votes."""
    return v @ 3 ** np.arange(N)


def unfold(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(N) % 3


def em(v: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the classes, vote accuracies (class, labeller), and the posterior of good for each vote pattern.

    Class 0 is good; bad documents are of several kinds, one begun from each labeller of SEEDS, because
    no labeller sees all kinds. Expectation: the posterior of each class for each pattern, from shares
    and accuracies; an abstention says nothing. Maximisation: each labeller's rate of right votes on
    each class (1 on good, 0 on the others) among the documents on which it votes.
    """
    kinds = 1 + len(SEEDS)
    share = np.array([0.85] + [0.15 / len(SEEDS)] * len(SEEDS))
    acc = np.full((kinds, N), 0.2)
    acc[0] = 0.98
    for k, s in enumerate(SEEDS):
        acc[k + 1, LABELLERS.index(s)] = 0.95
    total = max(count.sum(), 1)
    voted, right = v < 2, [v == (k == 0) for k in range(kinds)]
    post = np.zeros((len(v), kinds))
    for _ in range(rounds):
        log = np.stack([np.log(share[k]) + np.where(voted, np.where(right[k], np.log(acc[k]), np.log(1 - acc[k])), 0).sum(1) for k in range(kinds)], 1)
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        share = np.clip((count[:, None] * post).sum(0) / total, 1e-4, 1)
        share /= share.sum()
        for k in range(kinds):
            w = (count * post[:, k])[:, None] * voted
            acc[k] = np.clip(((w * right[k]).sum(0) + 1) / (w.sum(0) + 2), 0.01, 0.99)
    return share, acc, post[:, 0]


def classify(docs: DataFrame, good_cost: float = 3.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, pattern, posterior, score, kept) of every row of docs.

    Three scans of all documents. The first counts vote patterns (3**9 at most), on which EM estimates
    the labellers' accuracies. The second trains the scorer: each document adds its hashed byte 4-grams to the good class
    with its posterior and to the bad one with the rest; a slot's weight is its log ratio of the two. The third scores:
    score is the mean weight of the document's grams, and nothing else. kept: score is at least the threshold, which is
    the one, of steps of BIN, with the fewest expected errors over all documents by their posteriors, a good document
    that goes counting as much as good_cost bad ones that stay.

    Texts without grams (null, empty, under four bytes) have score 0. Repeated rows are scored alike; null keys
    give rows of their own; an empty table gives none; other columns are not read.
    """
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(3**N, np.int64)
        for b in slices(batches, "t"):
            n += np.bincount(patterns(votes(Texts(b.column(1)))), minlength=3**N)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["pattern", "n"])

    found = rows.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    pattern = np.array(sorted(r.pattern for r in found), np.int64)
    n = np.array([r.n for r in sorted(found, key=lambda r: r.pattern)], np.float64)
    _, _, post = em(unfold(pattern), n)
    posterior = np.full(3**N, 0.5)
    posterior[pattern] = post

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, all_ = np.zeros(SLOTS), np.zeros(SLOTS)
        for b in slices(batches, "t"):
            t = Texts(b.column(1))
            p = posterior[patterns(votes(t))]
            slot, bounds = gram_slots(t)
            size = np.diff(bounds)
            weight = np.repeat(1000 / np.maximum(size, 1), size)  # each document counts as much as any other
            good += np.bincount(slot, np.repeat(p, size) * weight, minlength=SLOTS)
            all_ += np.bincount(slot, weight, minlength=SLOTS)
        some = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(good[some]), pa.array(all_[some])], ["slot", "good", "n"])

    good, bad = np.zeros(SLOTS), np.zeros(SLOTS)
    for slot, g, a in rows.mapInArrow(train, "slot long, good double, n double").groupBy("slot").agg(F.sum("good"), F.sum("n")).collect():  # SLOTS rows at most
        good[slot], bad[slot] = g, max(a - g, 0)
    w = np.log((good + 1) / (good.sum() + SLOTS)) - np.log((bad + 1) / (bad.sum() + SLOTS))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            t = Texts(b.column(1))
            slot, bounds = gram_slots(t)
            y = np.round(sum_by_gram(w, slot, bounds) / np.maximum(np.diff(bounds), 1), 6)
            pat = patterns(votes(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pat), pa.array(np.round(posterior[pat], 9)), pa.array(y)], ["k", "pattern", "posterior", "score"])

    scored = settle(rows.mapInArrow(score, f"k {rows.schema['k'].dataType.simpleString()}, pattern long, posterior double, score double"), "scored")
    bins = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.sum("posterior").alias("good"), F.sum(1 - F.col("posterior")).alias("bad")).orderBy("bin").collect()
    lost, left = np.cumsum([0.0, *(r.good for r in bins)]), np.cumsum([0.0, *(r.bad for r in reversed(bins))])[::-1]
    cut = int(np.round(good_cost * lost + left, 3).argmin())
    threshold = bins[cut].bin * BIN if cut < len(bins) else float("inf")
    return scored.withColumn("kept", F.col("score") >= threshold).withColumnRenamed("k", key)
