"""Token counts without identifiers, by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

#: The characters of Unicode's White_Space property.
SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Distinct words that a task remembers before it starts anew.
MEMO_WORDS = 400_000
#: How a vocabulary's file must prepare texts for these counts to be its own.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merges:
    """Merge ranks of a BPE vocabulary file (tokenizers' .json), read once in each Python worker."""

    _kept: dict[str, Merges] = {}

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [(p["type"], p.get("pattern", {}).get("Regex")) for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if kinds != NORMALIZERS or splits != [("Split", SPLIT), ("ByteLevel", None)] or model["type"] != "BPE":
            raise ValueError(f"{path} prepares texts in another way than these counts do")
        #: The file's own preparation of texts, for characters of which Unicode's versions differ. Nothing is encoded with it.
        tok = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        self.rank = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: The printable character that stands for each byte in byte-level vocabularies.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.symbol = [chr(b) if b in keep else chr(next(other)) for b in range(256)]
        self.count = Words(self)

    @classmethod
    def of(cls, path: str) -> Merges:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]


def merged_count(word: str, merges: Merges) -> int:
    """Tokens of one pre-token, given as the symbols of its bytes: their number less the merges that byte-pair merging makes.

    A doubly linked list holds the symbols; a heap holds (rank, place) of every adjacent pair that
    can merge. The lowest rank goes first, ties leftmost; entries that a merge has outdated are skipped.
    """
    sym = list(word)
    n = len(sym)
    if not n:
        return 0
    sym[-1] += merges.end
    if n == 1:
        return 1
    rank = merges.rank
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    made = 0
    while heap:
        r, i = heapq.heappop(heap)
        j = right[i] if sym[i] is not None else -1
        if j < 0 or rank.get((sym[i], sym[j])) != r:
            continue
        sym[i] += sym[j]
        sym[j] = None
        made += 1
        k = right[j]
        right[i] = k
        if k >= 0:
            left[k] = i
            if (s := rank.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (s, i))
        h = left[i]
        if h >= 0 and (s := rank.get((sym[h], sym[i]))) is not None:
            heapq.heappush(heap, (s, h))
    return n - made


class Words(dict):
    """Token count of each chunk between white space, worked out when first met."""

    #: SPLIT, for chunks without white space whose characters are all COMMON.
    PATTERN = regex.compile(SPLIT)
    #: Characters that all versions of Unicode treat alike, and that composition leaves as they are.
    COMMON = regex.compile(r"[\x21-\x7e\u00a1-\u024f]*")

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.pieces: dict[str, int] = {}

    def piece(self, symbols: str) -> int:
        n = self.pieces.get(symbols)
        if n is None:
            n = merged_count(symbols, self.merges)
            if len(symbols) < 200:
                self.pieces[symbols] = n
        return n

    def symbols(self, chunk: str) -> list[str]:
        """The chunk's pre-tokens."""
        if self.COMMON.fullmatch(chunk) is None:
            m = self.merges
            return [p for p, _ in m.pre_tokenizer.pre_tokenize_str(m.normalizer.normalize_str(chunk))]
        small = chunk.lower() if chunk.isascii() else "".join(map(str.lower, chunk))
        table = self.merges.symbol
        return [p if p.isascii() else "".join([table[b] for b in p.encode()]) for p in self.PATTERN.findall(small)]

    def __missing__(self, chunk: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        if len(self.pieces) > MEMO_WORDS:
            self.pieces.clear()
        n = sum(map(self.piece, self.symbols(chunk)))
        if len(chunk) < 200:
            self[chunk] = n
        return n


_WHITE = regex.compile("[" + SPACE + "]+")
_ODD = regex.compile(r"[^\x00-\x1b\x20-\x7f\xa1-˿]")


def count_text(text: str, merges: Merges) -> int:
    """Tokens of a whole text: white space parts chunks, and special strings count as one token each."""
    found = 0
    if any(s in text for s in merges.special):
        parts = regex.split("|".join(map(regex.escape, merges.special)), text)
        found = len(parts) - 1
        return found + sum(count_text(p, merges) for p in parts)
    plain = _ODD.search(text) is None  # then str.split parts exactly at the white space meant here
    chunks = text.split() if plain else [c for c in _WHITE.split(text) if c]
    return sum(map(merges.count.__getitem__, chunks))


def token_counts(docs: DataFrame, vocabulary: str, most: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row; over_limit: more than `most` tokens.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows give repeated results; a null key stays
    null; other columns are not read. Texts are handled one by one, whole, and a task keeps nothing
    but a bounded memo of words. vocabulary: path of the file on every machine; one that prepares texts in another way than
    this module does is an error.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(vocabulary)
        for b in batches:
            texts = b.column(1)
            tokens = np.fromiter((count_text(t.as_py() or "", merges) for t in texts), np.int64, len(texts))
            size = pa.compute.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(tokens), pa.array(tokens > most)], ["k", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    out = rows.mapInArrow(count, f"k {rows.schema['k'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("k", key)
