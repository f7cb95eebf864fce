"""Quality rules: text statistics with fixed limits, then a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.textbytes import Texts, mix, slices, windows

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SLOTS = 1 << 16
GRAM = 4

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def duplicates(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: is its value found twice or more in its document; is it other than the first there."""
    if not len(values):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    later = np.zeros(len(k), bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


def text_stats(t: Texts) -> dict[str, np.ndarray]:
    """The five statistics of each document of a batch."""
    start, end = t.words()
    bounds = t.per_doc(start)
    points = np.zeros(len(t.buf) + 1, np.int64)
    np.cumsum((t.buf & 0xC0) != 0x80, out=points[1:])
    chars = np.concatenate((np.zeros(1, np.int64), np.cumsum(points[end] - points[start])))
    # Five-word windows found twice or more: mark the words under them.
    win, wdoc = windows(t.span_hash(start, end), bounds, 5)
    twice, _ = duplicates(win, wdoc)
    n_win = np.maximum(np.diff(bounds) - 4, 0)
    first = np.repeat(bounds[:-1], n_win) + np.arange(len(win)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    edge = np.zeros(len(start) + 6, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + 5, -1)
    under = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.cumsum(edge[: len(start)]) > 0)))
    # Lines: cut at \n and at the ends of documents.
    cut = np.flatnonzero(t.buf == 10)
    line_start = np.unique(np.concatenate((t.off[:-1][np.diff(t.off) > 0], cut + 1)))
    line_start = line_start[line_start < len(t.buf)]
    line_doc = t.doc_of(line_start)
    line_end = np.minimum(np.concatenate((cut, [len(t.buf)]))[np.searchsorted(cut, line_start)], t.off[line_doc + 1])
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    _, later = duplicates(t.span_hash(line_start, line_end), line_doc)
    return {
        "n_words": np.diff(bounds),
        "word_chars": np.diff(chars[bounds]),
        "n_symbols": t.sum_by_doc(_SYMBOL[t.buf]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=t.n).astype(np.int64),
        "n_repeat_words": np.diff(under[bounds]),
    }


def gram_slots(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all byte n-grams inside documents, and the bounds of each document's part."""
    n = len(t.buf) - GRAM + 1
    counts = np.maximum(np.diff(t.off) - GRAM + 1, 0)
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    if n <= 0:
        return np.zeros(0, np.int64), bounds
    x = np.zeros(n, np.uint64)
    for j in range(GRAM):
        x = (x << np.uint64(8)) | t.buf[j : j + n]
    slot = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    keep = np.ones(n, bool)
    for j in range(1, GRAM):  # grams that run over the end of a document
        at = t.off[1:-1] - j
        keep[at[(at >= 0) & (at < n)]] = False
    slot = slot[keep].astype(np.int64)
    return slot, bounds


def gram_counts(docs: DataFrame, trusted: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(slot, raw, target): counts over all documents, and over those whose key is in the sorted array trusted.

    Each task adds its documents up and emits one row per slot at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for b in slices(batches, "t"):
            t = Texts(b.column(1))
            slot, bounds = gram_slots(t)
            raw += np.bincount(slot, minlength=SLOTS)
            ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            good = np.isin(ids, trusted) & ~np.asarray(b.column(0).is_null())
            target += np.bincount(slot[np.repeat(good, np.diff(bounds))], minlength=SLOTS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["slot", "raw", "target"])

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    found = rows.mapInArrow(count, "slot long, raw long, target long")
    return found.groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(counts: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the two multinomials in each slot, with add-one counts; zeros if either corpus is empty."""
    raw, target = np.zeros(SLOTS), np.zeros(SLOTS)
    for slot, r, t in counts.collect():  # SLOTS rows at most
        raw[slot], target[slot] = r, t
    if not target.sum() or not raw.sum():
        return np.zeros(SLOTS)
    p = (target + smooth) / (target.sum() + smooth * SLOTS)
    q = (raw + smooth) / (raw.sum() + smooth * SLOTS)
    return np.log(p) - np.log(q)


def trusted_ids(labels: DataFrame, target_rows: int = 50_000) -> np.ndarray:
    """Keys of the trusted documents (quality = 1): all, or the target_rows with the smallest hashes."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    return np.sort(np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()], dtype=np.int64))


def sum_by_gram(w: np.ndarray, slot: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the weights of each document's grams, added up in their order, whatever documents are beside it."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return np.bincount(doc, w[slot], minlength=len(bounds) - 1)


def _judge(t: Texts, w: np.ndarray, threshold: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, base_failed, llr and kept of each document of a batch."""
    s = text_stats(t)
    slot, bounds = gram_slots(t)
    llr = np.round(sum_by_gram(w, slot, bounds) / np.maximum(np.diff(bounds), 1), 9)
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    return s, failed, llr, ~failed & (llr >= threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = -0.5, target_rows: int = 50_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, five statistics, base_failed, llr, kept) of every row of docs.

    kept: the base rules hold and llr, the mean log ratio of the document's hashed byte 4-grams under
    the trusted and the raw multinomial, is threshold or more. The raw multinomial counts all of docs;
    the trusted one is fitted on at most target_rows labelled documents. Null and empty texts have no
    words, so base_failed; a text without grams has llr 0. Repeated rows and null keys give rows of
    their own; without trusted rows every llr is 0, and the base rules alone decide. Other columns of
    docs are not read.
    """
    w = weights(gram_counts(docs, trusted_ids(labels, target_rows), text, key))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            s, failed, llr, kept = _judge(Texts(b.column(1)), w, threshold)
            columns = [b.column(0), *map(pa.array, s.values()), pa.array(failed), pa.array(llr), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, ["k", *s, "base_failed", "llr", "kept"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(score, f"k {kind}, {STATS}, base_failed boolean, llr double, kept boolean").withColumnRenamed("k", key)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = -0.5, target_rows: int = 50_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that quality_rules keeps; nothing is shuffled."""
    w = weights(gram_counts(docs, trusted_ids(labels, target_rows), text, key))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield b.filter(pa.array(_judge(Texts(b.column(text)), w, threshold)[3]))

    return docs.mapInArrow(keep, docs.schema)
