"""Benchmark decontamination: phrases of benchmark items found in an FM-index of each shard of the training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.fmindex import FMIndex
from vellum.llm.shared import settle
from vellum.llm.textbytes import Texts, slices

#: Fixed value: words are runs of characters other than these (after A-Z became a-z).
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
_GAP = re.compile(f"[{GAP}]".encode())
_WORD = np.array([_GAP.match(bytes([b])) is None for b in range(256)])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text of a shard, about; words of a piece of an item; words of a block of items, which goes to all tasks.
SHARD_BYTES = 4 << 20
PIECE_WORDS = 20_000
BLOCK_WORDS = 1_000_000

SPANS = "array<struct<word: long, word_end: long, start: long, end: long>>"


def words_of(text: Column) -> Column:
    """Lower-case words of a text as an array; null and texts without one give none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(f"([^{GAP}]+)"), 1)


class Phrases:
    """Windows of a block of items: rows of word numbers (from 1, in order of the words' hashes), their lengths and items."""

    def __init__(self, pieces: list[tuple[str, list[str]]], window: int):
        words = sorted({w for _, ws in pieces for w in ws})
        coded = [w.encode() for w in words]
        texts = Texts(pa.array(coded, pa.large_binary()))
        hashes = texts.span_hash(texts.off[:-1], texts.off[1:]) if coded else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [coded[i] for i in order]
        number = {words[i]: k + 1 for k, i in enumerate(order)}
        rows, length, items = [], [], []
        for item, ws in pieces:
            ids = np.array([number[w] for w in ws], np.int32)
            n = min(window, len(ids))
            found = np.lib.stride_tricks.sliding_window_view(ids, n)
            rows.append(np.pad(found, ((0, 0), (0, window - n))))
            length.append(np.full(len(found), n))
            items += [item] * len(found)
        self.rows = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.length = np.concatenate(length) if rows else np.zeros(0, np.int64)
        self.names = sorted(set(items))
        place = {s: i for i, s in enumerate(self.names)}
        self.item = np.array([place[s] for s in items], np.int64)


def _pieces(texts: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(row, first byte, bytes) of texts in portions; texts longer than `most` bytes come in pieces that end between words."""
    size = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    if size.max(initial=0) <= most:
        yield np.arange(len(texts)), np.zeros(len(texts), np.int64), texts
        return
    for row, value in enumerate(texts):
        body, at = value.as_py() or b"", 0
        while at < len(body) or not at:
            cut = _GAP.search(body, at + most)
            end = cut.start() if cut else len(body)
            yield np.array([row]), np.array([at]), pa.array([body[at:end]], pa.large_binary())
            if end >= len(body):
                break
            at = end


class Shard:
    """The words of one shard that can belong to a phrase, and where each is."""

    def __init__(self, texts: pa.Array, phrases: Phrases, shortest: int, most: int):
        self.n_words = np.zeros(len(texts), np.int64)
        parts = []
        for row, base, array in _pieces(texts, most):
            t = Texts(array, lower=True)
            start, end = t.runs(_WORD[t.buf])
            local = t.doc_of(start)
            bounds = t.per_doc(start)
            index = np.arange(len(start)) - bounds[local] + self.n_words[row[local]]
            self.n_words[row] += np.diff(bounds)
            if not len(phrases.words) or not len(start):
                continue
            h = t.span_hash(start, end)
            at = np.minimum(np.searchsorted(phrases.hashes, h), len(phrases.hashes) - 1)
            near = np.flatnonzero(phrases.hashes[at] == h)
            offset = base[local[near]] - t.off[local[near]]
            parts.append((row[local[near]], index[near], at[near] + 1, start[near] + offset, end[near] + offset))
        none = np.zeros(0, np.int64)
        self.row, self.index, self.word, self.start, self.end = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (none,) * 5
        # Only runs of phrase words that are as long as the shortest phrase can hold one.
        self._keep(self._run_size() >= shortest)
        if len(self.row):
            body = [t.as_py() for t in texts.take(pa.array(np.unique(self.row)))]
            at = np.searchsorted(np.unique(self.row), self.row)
            same = np.fromiter((body[i][a:b].lower() == phrases.words[w - 1] for i, a, b, w in zip(at, self.start, self.end, self.word, strict=True)), bool, len(self.row))
            if not same.all():  # other words with the hash of a phrase word
                self._keep(same)
                self._keep(self._run_size() >= shortest)

    def _run_size(self) -> np.ndarray:
        """Length of each word's run of neighbouring words."""
        new = np.ones(len(self.row), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (self.index[1:] != self.index[:-1] + 1)
        self.run = np.cumsum(new) - 1
        return np.bincount(self.run)[self.run] if len(new) else self.run

    def _keep(self, which: np.ndarray) -> None:
        self.row, self.index, self.word, self.start, self.end, self.run = (c[which] for c in (self.row, self.index, self.word, self.start, self.end, self.run))

    def hits(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, last word, item) of every phrase found; words are places in this shard's arrays."""
        none = np.zeros(0, np.int64)
        if not len(self.row) or not len(phrases.rows):
            return none, none, none
        # Runs one after another, a zero after each.
        new = np.concatenate(([0], (self.run[1:] != self.run[:-1]).astype(np.int64)))
        place = np.arange(len(self.row)) + np.cumsum(new)
        text = np.zeros(place[-1] + 2, np.int64)
        text[place] = self.word
        index = FMIndex(text)
        lo, hi = index.search(phrases.rows, phrases.length)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        row = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        first = np.searchsorted(place, index.locate(row))
        return first, first + phrases.length[which] - 1, phrases.item[which]


def _merged(shard: Shard, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the unions of overlapping or touching hits."""
    cover = np.zeros(len(shard.row) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, last + 1, -1)
    on = np.cumsum(cover)[:-1] > 0
    same = np.zeros(len(on), bool)
    same[1:] = (shard.row[1:] == shard.row[:-1]) & (shard.index[1:] == shard.index[:-1] + 1)
    begin = on & ~(same & np.concatenate(([False], on[:-1])))
    stop = on & ~np.concatenate(((same & on)[1:], [False]))
    return np.flatnonzero(begin), np.flatnonzero(stop)


def _found(texts: pa.Array, phrases: Phrases, shortest: int, most: int) -> tuple[np.ndarray, list[list[str]], list[list[dict]]]:
    """Words, items and spans of each text of a shard."""
    shard = Shard(texts, phrases, shortest, most)
    first, last, item = shard.hits(phrases)
    items: list[list[str]] = [[] for _ in range(len(texts))]
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    if len(first):
        for r, i in np.unique(np.stack((shard.row[first], item), 1), axis=0).tolist():
            items[r].append(phrases.names[i])
        for a, b in zip(*_merged(shard, first, last), strict=True):
            spans[shard.row[a]].append({"word": int(shard.index[a]), "word_end": int(shard.index[b]) + 1, "start": int(shard.start[a]), "end": int(shard.end[b])})
    return shard.n_words, items, spans


def _blocks(benchmark: DataFrame, window: int, item: str, text: str, most: int) -> tuple[list[DataFrame], int]:
    """Pieces (item, words) of the items' word lists in blocks of about `most` words, and the length of the shortest phrase."""
    rows = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("item"), words_of(benchmark[text]).alias("w")).filter("size(w) > 0")
    step = PIECE_WORDS
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1), F.lit(step))
    pieces = settle(rows.select("item", F.explode(starts).alias("at"), "w").select("item", F.slice("w", F.col("at"), step + window - 1).alias("w")), "items")
    sums = pieces.agg(F.sum(F.size("w")).alias("n"), F.min(F.size("w")).alias("least")).first()
    if not sums.n:
        return [], window
    n = -(-sums.n // most)
    return [pieces.filter(F.pmod(F.xxhash64("item", "w"), F.lit(n)) == k) for k in range(n)], min(window, sums.least)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", whole: bool = False, shard_bytes: int = SHARD_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, n_words, n_hit, items, spans) of every row of docs, and its text if `whole` is set.

    A phrase is a run of `window` words of an item, or all words of an item that has fewer. items: the sorted ids, as
    strings, of the items of which a phrase occurs; spans: the words in any occurrence, as merged stretches
    (word, word_end, start, end), counted in words and in bytes of UTF-8; n_hit: the words in them.

    Each task takes texts in shards of about shard_bytes. A shard's FM-index covers all runs of benchmark words that are
    as long as the shortest phrase (other words cannot be part of an occurrence); phrases are searched backwards through
    the wavelet matrix, their places come from sampled suffixes. The index is over words that are compared with the phrase
    words byte by byte. Texts longer than a shard are read in pieces, but searched as one. Items come to the driver and the
    tasks in blocks of about block_words words; with several blocks the texts are read once for each, and the spans merged.

    Null and empty texts have no words; an empty benchmark finds nothing. Items with a null id are one item with the id
    ''; repeated ids are one item, with all its texts. Repeated rows give repeated results; other columns are not read.
    """
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    blocks, shortest = _blocks(benchmark, window, item, item_text, block_words)
    if len(blocks) > 1:
        rows = settle(rows.withColumn("tag", F.monotonically_increasing_id()), "texts")
    tagged = len(blocks) > 1
    # Beside the results: the row's number if blocks are to be joined, the text if it is asked for.
    beside = (2, "tag", "long") if tagged else (1, "t", "string") if whole else None
    kind = rows.schema["k"].dataType.simpleString()

    def of(block: DataFrame | None) -> DataFrame:
        phrases = Phrases([(r.item, r.w) for r in block.collect()] if block is not None else [], window)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "t", shard_bytes):
                n_words, items, spans = _found(b.column(1).cast(pa.large_binary()).fill_null(b""), phrases, shortest, shard_bytes)
                n_hit = [sum(s["word_end"] - s["word"] for s in ss) for ss in spans]
                span = pa.list_(pa.struct([(c, pa.int64()) for c in ("word", "word_end", "start", "end")]))
                cols = {"k": b.column(0), "n_words": pa.array(n_words), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, span)}
                if beside:
                    cols[beside[1]] = b.column(beside[0])
                yield pa.RecordBatch.from_pydict(cols)

        return rows.mapInArrow(find, f"k {kind}, n_words long, n_hit long, items array<string>, spans {SPANS}" + (f", {beside[1]} {beside[2]}" if beside else ""))

    if not tagged:
        return of(blocks[0] if blocks else None).withColumnsRenamed({"k": key, "t": text})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found in b.column(1).to_pylist():
                spans: list[dict] = []
                for s in sorted(found, key=lambda s: s["word"]):
                    if spans and s["word"] <= spans[-1]["word_end"]:
                        if s["word_end"] > spans[-1]["word_end"]:
                            spans[-1] |= {"word_end": s["word_end"], "end": s["end"]}
                    else:
                        spans.append(s)
                out.append(spans)
            n_hit = pa.array([sum(s["word_end"] - s["word"] for s in ss) for ss in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.schema.field(1).type), n_hit], ["tag", "spans", "n_hit"])

    every = of(blocks[0])
    for block in blocks[1:]:
        every = every.unionByName(of(block))
    # A document's spans and items are no more than its own words and the items found in it.
    met = every.groupBy("tag").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    merged = met.select("tag", "spans").mapInArrow(merge, f"tag long, spans {SPANS}, n_hit long")
    out = rows.join(met.drop("spans"), "tag").join(merged, "tag")
    return out.select(F.col("k").alias(key), "n_words", "n_hit", "items", "spans", *([F.col("t").alias(text)] if whole else []))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of contamination()."""
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def cleaned(found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of contamination() with whole texts, without its spans; what stood on both sides of one stays as it was."""
    kind = found.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                body = t.as_py()
                if spans:
                    raw = body.encode()
                    edge = [0, *(x for s in spans for x in (s["start"], s["end"])), len(raw)]
                    body = b"".join(raw[i:j] for i, j in zip(edge[::2], edge[1::2], strict=True)).decode()
                out.append(body)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["k", "t"])

    return found.select(key, text, "spans").mapInArrow(cut, f"k {kind}, t string").withColumnsRenamed({"k": key, "t": text})
