"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import settle
from vellum.llm.textbytes import Texts, slices

BITS = 18
SLOTS = 1 << BITS
#: Lengths in bytes of the word beginnings that are terms besides the whole words.
HEADS = (4, 5, 6)
#: The feature after those of the slots: the mean log ratio of a text's slots.
OWN = SLOTS
#: Documents of each label that a slot is taken to have beyond those counted.
SMOOTH = 5.0
#: Significance of a slot's difference between the labels from which its feature has the full value of 1, alone and in pairs.
FULL, FULL_IN_PAIRS = 0.5, 0.25

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def term_slots(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of the distinct hashed terms of each document: words of letters and their beginnings."""
    letter = _LETTER[t.buf]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(letter) + 1, bool)
    edge[t.off] = True
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | edge[1:-1]
    end[:-1] &= ~letter[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = t.doc_of(start)
    docs, slots = [doc], [t.span_hash(start, end) >> np.uint64(64 - BITS)]
    for n in HEADS:
        long = end - start >= n
        docs.append(doc[long])
        slots.append((t.span_hash(start[long], start[long] + n) ^ np.uint64(n << 60)) >> np.uint64(64 - BITS))
    pair = np.unique(np.concatenate(docs) * SLOTS + np.concatenate(slots).astype(np.int64))
    return pair // SLOTS, pair % SLOTS


def log_ratio(n0: np.ndarray, n1: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """Log ratio of the two labels' smoothed shares of documents, for slots in n0 of t0 and n1 of t1 documents."""
    share = SMOOTH * 2 / np.maximum(t0 + t1, 1)  # labels of a slot that isn't known
    return np.log((n1 + share * t1) / np.maximum(t1, 1) + 1e-12) - np.log((n0 + share * t0) / np.maximum(t0, 1) + 1e-12)


@dataclass
class Terms:
    """The features of a text: each slot by itself, and the mean of its slots' log ratios of the two labels."""

    ratio: np.ndarray

    def of(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, slot) of the slots, and feature OWN of each document."""
        doc, slot = term_slots(t)
        return doc, slot, np.bincount(doc, self.ratio[slot], minlength=t.n) / np.maximum(np.bincount(doc, minlength=t.n), 1)


@dataclass
class Machine:
    """Bias, linear weights and factors of the features: one row for each slot and one for feature OWN, which has no pairs."""

    terms: Terms
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, t: Texts) -> np.ndarray:
        doc, row, rest = self.terms.of(t)
        y = self.bias + np.bincount(doc, self.linear[row], minlength=t.n) + self.linear[OWN] * rest
        for f in range(self.factors.shape[1]):
            v = self.factors[row, f]
            y += 0.5 * (np.bincount(doc, v, minlength=t.n) ** 2 - np.bincount(doc, v * v, minlength=t.n))
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def fit(doc: np.ndarray, row: np.ndarray, label: np.ndarray, n_terms: int, rest: np.ndarray | None = None, value: np.ndarray | None = None, in_pairs: np.ndarray | None = None, factors: int = 8, steps: int = 600, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit a second-order factorization machine for log loss on mini-batches: (bias, linear weights, factors) for 0/1 features.

    doc, row: coordinates of the sample's features, in order of doc. A feature is `value` of its row alone and `in_pairs` with others
    (1 without); the weights and factors returned are multiplied by these. rest: one more number of each document, whose weight is the last one. A step
    changes only the rows that its documents have, each with a step size by its own gradients so far (AdaGrad).
    """
    rng = np.random.default_rng(seed)
    n = len(label)
    value, in_pairs = (np.ones(n_terms) if v is None else v for v in (value, in_pairs))
    cost = np.where(label == 1, np.sqrt(max((label == 0).sum(), 1) / max((label == 1).sum(), 1)), 1.0)  # rare toxic rows count more
    p = np.zeros((n_terms, 1 + factors), np.float32)
    p[:, 1:] = rng.normal(0, 0.01, (n_terms, factors))
    seen, place = np.zeros_like(p), np.zeros(n_terms, np.int64)
    common, common_seen = np.zeros(2), np.zeros(2)  # the bias and the weight of rest
    extra = np.stack((np.ones(n), np.zeros(n) if rest is None else rest), 1)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    step = 0
    while n and step < steps:
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            size = bounds[pick + 1] - bounds[pick]
            r = row[np.repeat(bounds[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            of = np.repeat(np.arange(len(pick)), size)
            own = np.flatnonzero(np.bincount(r, minlength=n_terms))
            place[own] = np.arange(len(own))
            i, q = place[r], p[own].astype(np.float64)
            alone, x = value[own][i], in_pairs[own][i]
            s = np.stack([np.bincount(of, q[i, j] * (x if j else alone), minlength=len(pick)) for j in range(1 + factors)], 1)
            same = np.bincount(of, (q[:, 1:] ** 2).sum(1)[i] * x * x, minlength=len(pick))
            y = extra[pick] @ common + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - same)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[pick]) * cost[pick] / len(pick)
            gx = g[of] * x
            gxx = np.bincount(i, gx * x, minlength=len(own))
            grad = np.stack([np.bincount(i, g[of] * alone, minlength=len(own)), *(np.bincount(i, gx * s[of, j], minlength=len(own)) - q[:, j] * gxx for j in range(1, 1 + factors))], 1) + decay * q
            seen[own] += grad**2
            p[own] = q - rate * grad / (np.sqrt(seen[own]) + 1e-6)
            grad = extra[pick].T @ g
            common_seen += grad**2
            common -= rate * grad / (np.sqrt(common_seen) + 1e-6)
            step += 1
            if step == steps:
                break
    p[:, 0] *= value
    p[:, 1:] *= in_pairs[:, None]
    if rest is not None:
        p = np.concatenate((p, np.array([[common[1], *np.zeros(factors)]], np.float32)))
    return float(common[0]), p[:, 0], p[:, 1:]


def training_sample(labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and labels of the training rows, in order of their hashes: not held out, all or those with the smallest hashes."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("k"), "toxic")
    usable = usable.filter(F.crc32(F.col("k").cast("string").cast("binary")) % 5 != 0).groupBy("k").agg(F.max("toxic").alias("y"))
    found = usable.orderBy(F.xxhash64("k"), "k").limit(rows).collect()
    return np.array([r.k for r in found], np.int64), np.array([int(r.y) for r in found], np.int64)


def _labelled(b: pa.RecordBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch are in the sample, and their places in it."""
    ids = b.column(0).to_numpy(zero_copy_only=False)
    known = ~np.asarray(b.column(0).is_null())
    ids = np.where(known, ids, -1).astype(np.int64)
    at = np.minimum(np.searchsorted(keys, ids), max(len(keys) - 1, 0))
    return known & (keys[at] == ids if len(keys) else np.zeros(len(ids), bool)), at


def sample_terms(docs: DataFrame, keys: np.ndarray, most_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in keys of their documents, and (document, slot) of the terms: of all, or of the first up to most_terms in total.

    One scan of docs; of rows with the same key the one with the most terms counts (ties: the greatest bytes).
    """
    order = np.argsort(keys)
    ascending = keys[order]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            mine, at = _labelled(b, ascending)
            if mine.any():
                doc, slot = term_slots(Texts(b.column(1).filter(pa.array(mine)), lower=True))
                bounds = np.searchsorted(doc, np.arange(mine.sum() + 1))
                slot = slot.astype("<i4")
                terms = [slot[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(order[at[mine]]), pa.array(np.diff(bounds)), pa.array(terms, pa.binary())], ["place", "n", "terms"])

    found = docs.mapInArrow(gather, "place long, n long, terms binary").groupBy("place").agg(F.max(F.struct("n", "terms")).alias("most"))
    found = settle(found.select("place", "most.n", "most.terms"), "sample")
    sizes = found.select("place", "n").orderBy("place").toArrow()  # a row for each key at most
    place, n = sizes.column("place").to_numpy(), sizes.column("n").to_numpy()
    first = int(np.searchsorted(np.cumsum(n), most_terms, side="right"))
    if not first:
        return place[:0], np.zeros(0, np.int32), np.zeros(0, np.int32)
    rows = found.filter(F.col("place") <= int(place[first - 1])).orderBy("place").select("terms").toArrow()
    slots = np.frombuffer(b"".join(rows.column("terms").to_pylist()), "<i4")
    return place[:first], np.repeat(np.arange(first, dtype=np.int32), n[:first]), slots


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000, text: str = "text", key: str = "doc_id", most_terms: int = 20_000_000) -> Machine:
    """Fit on labelled rows that are not held out: at most sample_rows, with at most most_terms distinct terms in total.

    The driver holds four bytes for each of those terms, and a weight and factors for each slot. A slot's feature has a value by how
    significantly its share of documents differs between the labels, squared, so that terms without evidence
    move the score little; none is left out. In the feature OWN of the sample, a document isn't counted in its own log ratios.
    """
    keys, label = training_sample(labels, sample_rows)
    place, doc, slot = sample_terms(docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t")), keys, most_terms)
    label = label[place]
    total = np.bincount(label, minlength=2).astype(np.float64)
    parts = [slice(*np.searchsorted(doc, (i, i + 1000))) for i in range(0, len(label), 1000)]
    counts = np.zeros((2, SLOTS))
    for part in parts:
        for c in (0, 1):
            counts[c] += np.bincount(slot[part][label[doc[part]] == c], minlength=SLOTS)
    rest = np.zeros(len(label))
    for part in parts:
        y = label[doc[part]]
        ratio = log_ratio(counts[0][slot[part]] - (y == 0), counts[1][slot[part]] - (y == 1), total[0] - (y == 0), total[1] - (y == 1))
        rest += np.bincount(doc[part], ratio, minlength=len(label))
    rest /= np.maximum(np.bincount(doc, minlength=len(label)), 1)
    share = counts / np.maximum(total, 1)[:, None]
    z = np.abs(share[1] - share[0]) / np.sqrt((counts.sum(0) + SMOOTH) / max(total.sum(), 1))
    bias, linear, factors = fit(doc, slot, label, SLOTS, rest, np.minimum(z / FULL, 1) ** 2, np.minimum(z / FULL_IN_PAIRS, 1) ** 2)
    return Machine(Terms(log_ratio(*counts, *total).astype(np.float32)), bias, linear, factors)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000, text: str = "text", key: str = "doc_id", most_terms: int = 20_000_000) -> DataFrame:
    """(key, held_out, score, predicted) of every row of docs.

    held_out: crc32 of the key as text is divisible by 5; labels of such rows are never read. score is
    the machine's probability of label 1 from the whole text alone; predicted is 1 from 0.5 on. Null
    and empty texts have no terms and get the bias alone. Repeated rows are scored alike; a null key
    gives a null held_out; other columns are not read. Without usable labels every score is 0.5.
    """
    machine = train(docs, labels, sample_rows, text, key, most_terms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            y = machine.score(Texts(b.column(1), lower=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], ["k", "score", "predicted"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    out = rows.mapInArrow(score, f"k {rows.schema['k'].dataType.simpleString()}, score double, predicted int")
    held = F.crc32(F.col("k").cast("string").cast("binary")) % 5 == 0
    return out.select(F.col("k").alias(key), held.alias("held_out"), "score", "predicted")
