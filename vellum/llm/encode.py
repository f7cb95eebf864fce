"""Token ids of whole texts, as the tokenizers library gives them, with a bounded memo of chunks.

Texts are cut into chunks at places where the vocabulary's splitting rules always part tokens. The work on
each occurrence of a chunk is done on byte arrays; only chunks that are not in the memo go to the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from vellum.llm.textbytes import SEPARATORS, Texts, mix

MEMO_CHUNKS = 1_000_000
#: Longest chunk, in bytes, that is recognised by its bytes in two numbers; longer ones are looked up one by one.
SHORT = 15
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Chunks that are one token group each, also when many are put into one text. (İ in lower case is two characters.)
_BYTE_PLAIN = re.compile(f" [{_L}]+").fullmatch
_WORD_PLAIN = re.compile(f"(?!.*İ)[{_L}]+").fullmatch
TOGETHER = 1_000

_SEP, _LETTER, _POINT, _LEAD = (np.zeros(256, bool) for _ in range(4))
_SEP[list(SEPARATORS)] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT[list(b'.,!?;:)"')] = True
_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1 ... (n[i] numbers) for each i, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _wide_blanks(t: Texts) -> np.ndarray:
    """Places of white space beyond ASCII, and of control characters that some take for white space."""
    at = np.flatnonzero(_LEAD[t.buf])
    pad = np.concatenate((t.buf, np.zeros(2, np.uint8)))
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    wide = (a < 0x20) | ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return at[wide]


class Encoder:
    """One vocabulary file; kept once in each Python worker by of()."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.byte_level = self.tok.normalizer is None
        self.plain, self.glue = (_BYTE_PLAIN, "") if self.byte_level else (_WORD_PLAIN, " ")
        self.width = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # The memo: hashes in order, the chunks' bytes as two numbers, and where their ids are in the pool.
        self.known = tuple(np.zeros(0, d) for d in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
        self.pool = np.zeros(0, self.width)
        self.long: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def _ids_of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Plain ones are encoded many at a time, which costs the library less, and parted by their group."""
        plain = [c for c in chunks if self.plain(c)]
        out = {}
        for i in range(0, len(plain), TOGETHER):
            part = plain[i : i + TOGETHER]
            e = self.tok.encode(self.glue.join(part), add_special_tokens=False)
            group = np.array(e.word_ids, np.int64)
            cut = np.searchsorted(group, np.arange(len(part) + 1)) * self.width.itemsize
            if len(group) and group[-1] == len(part) - 1 and (np.diff(group) >= 0).all() and (np.diff(cut) > 0).all():
                raw = np.array(e.ids, self.width).tobytes()
                out.update((c, raw[a:b]) for c, a, b in zip(part, cut.tolist(), cut[1:].tolist(), strict=False))
        rest = [c for c in chunks if c not in out]
        out.update(zip(rest, (np.array(e.ids, self.width).tobytes() for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [out[c] for c in chunks]

    def _whole(self, t: Texts) -> np.ndarray:
        """Documents that go to the library whole: those with special strings, or with blanks that the cuts don't know."""
        at = np.flatnonzero((t.buf[:-1] == ord("<")) & (t.buf[1:] == ord("|"))) if len(t.buf) > 1 else np.zeros(0, np.int64)
        out = np.zeros(t.n, bool)
        for i in np.unique(t.doc_of(at)):
            body = t.buf[t.off[i] : t.off[i + 1]].tobytes()
            out[i] = any(s in body for s in self.special)
        if self.byte_level:
            out[t.doc_of(_wide_blanks(t))] = True
        return out

    def chunks(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks. Where white space is dropped, they are the words; else they cover all bytes.

        Words also part after a letter before common punctuation. With byte-level splitting a word takes one blank
        before it along; of other white space before a word, all but the last character is one chunk, and that one another.
        """
        n = len(t.buf)
        sep = _SEP[t.buf]
        edge = np.zeros(n + 1, bool)
        edge[t.off] = True
        letter = _LETTER[t.buf]
        letter[1:] |= (t.buf[:-1] == 0xC3) & (t.buf[1:] != 0x97) & (t.buf[1:] != 0xB7)
        start = np.zeros(n, bool)
        start[1:] = letter[:-1] & _POINT[t.buf[1:]]
        before = np.ones(n, bool)  # a separator, or nothing, is before the place
        before[1:] = sep[:-1] | edge[1:-1]
        after = np.ones(n, bool)
        after[:-1] = sep[1:] | edge[1:-1]
        ends_text = np.zeros(n, bool)
        ends_text[t.off[1:][np.diff(t.off) > 0] - 1] = True
        whole = self._whole(t)
        if self.byte_level:
            ink = ~sep
            glued = np.zeros(n, bool)  # words that follow a blank of their text
            glued[1:] = ink[1:] & (t.buf[:-1] == 0x20) & ~edge[1:-1]
            start |= ink & before & ~glued
            first = sep.copy()  # white space after a word or at the start of its text
            first[1:] &= ~sep[:-1] | edge[1:-1]
            start |= first
            last = sep & ~ends_text  # the last of the white space before a word
            last[:-1] &= ~sep[1:]
            start |= last
            start |= edge[:-1]
            if whole.any():
                start[_ranges(t.off[:-1][whole], np.diff(t.off)[whole])] = False
                start |= edge[:-1]
            at = np.flatnonzero(start)
            return at, np.append(at[1:], n)[: len(at)]
        end = np.zeros(n, bool)
        end[:-1] = start[1:]
        start |= ~sep & before
        end |= ~sep & after
        if whole.any():
            at = _ranges(t.off[:-1][whole], np.diff(t.off)[whole])
            start[at] = end[at] = False
            start[t.off[:-1][whole]] = True
            end[t.off[1:][whole] - 1] = True
        return np.flatnonzero(start), np.flatnonzero(end) + 1

    def _lookup(self, h: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the memo, found) of distinct chunks."""
        known = self.known
        if not len(known[0]):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
        return at, (known[0][at] == h) & (known[1][at] == k1) & (known[2][at] == k2)

    def _short_ids(self, t: Texts, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, number) of the ids in the pool of each chunk of SHORT bytes at most."""
        pad = np.concatenate((t.buf, np.zeros(16, np.uint8)))
        word = np.ndarray((len(pad) - 7,), "<u8", pad, 0, (1,))
        k1 = word[start] & _MASK[np.minimum(size, 8)]
        k2 = (word[start + 8] & _MASK[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
        h = mix(k1 + mix(k2))
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        one = order[new]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if not ((k1 == k1[one][inverse]) & (k2 == k2[one][inverse])).all():  # two chunks with one hash: by all their bytes then
            _, one, inverse = np.unique(np.stack((k1, k2), 1), axis=0, return_index=True, return_inverse=True)
            inverse = inverse.ravel()
        at, found = self._lookup(h[one], k1[one], k2[one])
        first, number = (np.zeros(len(one), np.int64) for _ in range(2))
        first[found], number[found] = self.known[3][at[found]], self.known[4][at[found]]
        hole = np.flatnonzero(~found)
        if len(hole):
            body = t.buf.tobytes()
            a = start[one[hole]].tolist()
            ids = self._ids_of_chunks([body[i : i + n].decode() for i, n in zip(a, size[one[hole]].tolist(), strict=True)])
            number[hole] = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
            first[hole] = len(self.pool) + np.cumsum(number[hole]) - number[hole]
            self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(ids), self.width)))
        out = first[inverse], number[inverse]
        keep = hole
        if len(self.known[0]) + len(hole) > MEMO_CHUNKS:  # start anew with the chunks of this batch
            self.known, keep = tuple(k[:0] for k in self.known), np.arange(len(one))
        if len(keep):
            fresh = (h[one[keep]], k1[one[keep]], k2[one[keep]], first[keep], number[keep])
            merged = [np.concatenate(p) for p in zip(self.known, fresh, strict=True)]
            order = np.argsort(merged[0], kind="stable")
            self.known = tuple(m[order] for m in merged)
        return out

    def _long_ids(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.long) > MEMO_CHUNKS // 10:
            self.long = {}
        new = [c for c in dict.fromkeys(chunks) if c not in self.long]
        got = dict(zip(new, self._ids_of_chunks([c.decode() for c in new]), strict=True))
        out = [self.long[c] if c in self.long else got[c] for c in chunks]
        self.long.update((c, ids) for c, ids in got.items() if len(c) < 100)
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text, null as empty, then end_id."""
        ids, cut = self.flat(texts, end_id)
        return [ids[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another; text i has those from cut[i] to cut[i + 1]."""
        t = Texts(texts)
        if len(self.pool) > 8 * MEMO_CHUNKS:  # ids of chunks that the memo no longer has
            live = _ranges(self.known[3], self.known[4])
            n = self.known[4]
            self.pool, self.known = self.pool[live], (*self.known[:3], np.cumsum(n) - n, n)
        start, end = self.chunks(t) if len(t.buf) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        size = end - start
        short = size <= SHORT
        first, number = (np.zeros(len(start), np.int64) for _ in range(2))
        if short.any():
            first[short], number[short] = self._short_ids(t, start[short], size[short])
        pool = self.pool
        if not short.all():
            body = t.buf.tobytes()
            ids = self._long_ids([body[a:b] for a, b in zip(start[~short].tolist(), end[~short].tolist(), strict=True)])
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
            number[~short] = n
            first[~short] = len(pool) + np.cumsum(n) - n
            pool = np.concatenate((pool, np.frombuffer(b"".join(ids), self.width)))
        ids = pool[_ranges(first, number)]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(number)))
        cut = total[np.searchsorted(start, t.off)]
        if end_id is not None:
            cut += np.arange(t.n + 1)
            out = np.full(len(ids) + t.n, end_id, self.width)
            stay = np.ones(len(out), bool)
            stay[cut[1:] - 1] = False
            out[stay] = ids
            ids = out
        return ids, cut
