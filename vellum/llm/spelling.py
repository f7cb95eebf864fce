"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists, and the frequent form behind each."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import settle

#: Contract: words are these runs; so every character of a word is one byte of Latin-1.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_END = re.compile("[^A-Za-zÀ-ÿ]")
DROP_ONE_IN = 199
#: Characters of a text that are taken at once; distinct words that a task counts before it passes them on.
PIECE, COUNTED = 1 << 20, 400_000
#: Words of a list above which it is parted; bytes of word matrices and queries that are looked at together.
HOT, CELLS, QUERIES = 20_000, 4 << 20, 8_192


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case over all texts, where one run in DROP_ONE_IN, by a hash of id and run, lacks one letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for k, t in zip(b.column(0), b.column(1).cast(pa.large_binary()), strict=True):
                body, at, start = (t.as_py() or b"").lower().decode(), 0, zlib.crc32(f"{k.as_py() or ''}:".encode())
                while at < len(body):
                    cut = _END.search(body, at + PIECE)
                    end = cut.start() if cut else len(body)
                    for run, n in Counter(RUN.findall(body, at, end)).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % DROP_ONE_IN == 0:
                            i = h % len(run)
                            run = run[:i] + run[i + 1 :]
                        total[run] += n
                    at = end
                    if len(total) > COUNTED:
                        yield flush()
        yield flush()

    rows = docs.select(docs[key].cast("string").alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lists:
    """Sorted lists of distinct words, one after another, as a matrix of bytes; and the length of the prefix each shares with the one before."""

    def __init__(self, words: list[bytes], group: np.ndarray):
        self.size = np.array([len(w) for w in words])
        width = int(self.size.max(initial=0)) + 3
        flat = np.zeros((len(words), width), np.uint8)
        inside = np.arange(width) < self.size[:, None]
        flat[inside] = np.frombuffer(b"".join(words), np.uint8)
        self.chars, self.group = flat, group
        same = np.cumprod((flat[1:] == flat[:-1]) & inside[1:] & inside[:-1], axis=1).sum(1)
        self.lcp = np.concatenate(([-1], np.where(group[1:] == group[:-1], same, -1)))

    def one_edit(self, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, other word) of its list, exactly one inserted, deleted or replaced character apart, for words that ask.

        A depth at a time: a range of words that share a prefix of that depth has one band of the edit matrix (the cells
        beside the diagonal) with each word that asks, made once from the band of the shorter prefix. Ranges whose
        band passes one edit are skipped whole; where adjacent prefixes part, a range falls into shorter ones.
        """
        out = []
        starts = np.flatnonzero(self.lcp == -1)
        ends = np.append(starts[1:], len(self.lcp))
        for at in range(0, len(asking), QUERIES):
            q = asking[at : at + QUERIES]
            own = np.searchsorted(starts, q, side="right") - 1
            lo, hi = starts[own], ends[own]
            low, mid, high = np.full(len(q), 9, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
            depth = 0
            while len(q):
                # A word that ends here: it is the first of its range.
                gap = self.size[q] - depth
                last = np.where(gap == 0, mid, np.where(gap == 1, high, np.where(gap == -1, low, 9)))
                ended = self.size[lo] == depth
                hit = ended & (last == 1)
                out.append((q[hit], lo[hit]))
                lo = lo + ended
                on = lo < hi
                q, lo, hi, low, mid, high = (c[on] for c in (q, lo, hi, low, mid, high))
                # Ranges of the next depth.
                cut = np.flatnonzero(self.lcp <= depth)
                first, last_ = np.searchsorted(cut, lo), np.searchsorted(cut, hi)
                n = last_ - first
                row = np.repeat(np.arange(len(q)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
                new_lo = cut[place]
                new_hi = np.minimum(np.append(cut, len(self.lcp))[place + 1], hi[row])
                c, who = self.chars[new_lo, depth], q[row]
                size, old = self.size[who], (low[row], mid[row], high[row])
                differs = [np.where(depth - 1 + k < size, self.chars[who, np.minimum(max(depth - 1 + k, 0), self.chars.shape[1] - 1)] != c, True) for k in range(3)]
                a = np.minimum(old[0] + differs[0], old[1] + 1) if depth else old[1] + 1
                b = np.minimum(np.minimum(old[1] + differs[1], old[2] + 1), a + 1)
                e = np.minimum(old[2] + differs[2], b + 1)
                b, e = np.where(depth + 1 > size, 9, b), np.where(depth + 2 > size, 9, e)
                on = np.minimum(np.minimum(a, b), e) <= 1
                q, lo, hi, low, mid, high = (x[on] for x in (who, new_lo, new_hi, a.astype(np.int8), b.astype(np.int8), e.astype(np.int8)))
                depth += 1
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


_LIST = ("m", "a", "b", "head", "tail")


def _split(rows: DataFrame) -> DataFrame:
    """Each list in two: words that share the first half of their middles, and words that share the second half.

    A pair one edit apart is in one of the two at least; it counts in the second only if the prefix it shares is
    shorter than `most`, the first half.
    """
    g = F.col("m") - F.col("a") - F.col("b")
    half = F.floor(g / 2).cast("int")
    size = F.length("middle")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.concat("head", F.substring("middle", F.lit(1), half)).alias("head"), F.col("tail").alias("tail"), F.substring("middle", half + 1, size).alias("middle"), F.col("most").alias("most"))
    rest = g - half
    second = F.struct(F.col("a").alias("a"), (F.col("b") + rest).alias("b"), F.col("head").alias("head"), F.concat(F.substring("middle", size - rest + 1, rest), F.col("tail")).alias("tail"), F.substring("middle", F.lit(1), size - rest).alias("middle"), F.least("most", F.col("a") + half).alias("most"))
    return rows.select("m", "word", "n", F.explode(F.array(first, second)).alias("x")).select("m", "x.a", "x.b", "x.head", "x.tail", "x.middle", "x.most", "word", "n")


def lists(words: DataFrame, least: int = 6, hot: int = HOT) -> DataFrame:
    """Lists in which all pairs of words (word, n) one edit apart meet: (m, a, b, head, tail) names a list of words of m or m + 1 letters
    that share the first a and the last b; `middle` is what remains.

    A list of more than `hot` words is parted again by halves of the middle, until that has two letters at most
    (then its size has a bound that does not grow with the table: the alphabet's pairs and triples).
    """
    size = F.length("word")
    classes = F.when(size > least, F.array(size, size - 1)).otherwise(F.array(size))
    whole = words.select("word", "n", F.explode(classes).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("middle"), F.lit(1 << 30).alias("most"))
    rows = _split(whole)
    done = None
    while True:
        crowded = settle(rows.groupBy(*_LIST).count().filter((F.col("count") > hot) & (F.col("m") - F.col("a") - F.col("b") > 2)).select(*_LIST), "crowded")
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        part = rows.join(crowded, list(_LIST), "left_anti")
        done = part if done is None else done.unionByName(part)
        rows = settle(_split(rows.join(crowded, list(_LIST), "left_semi").select(*rows.columns)), "halves")


def near_words(words: DataFrame, least: int = 6, hot: int = HOT) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of (word, n) that are exactly one inserted, deleted or replaced character apart, each once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cells, at, group = 0, None, -1

        def search() -> pa.RecordBatch:
            body = [w.encode("latin-1") for w in (h[2] for h in held)]
            found = Lists(body, np.array([h[0] for h in held]))
            short = np.array([h[1] for h in held])
            i, j = found.one_edit(np.flatnonzero(short))
            most, start = np.array([h[3] for h in held]), np.array([h[4] for h in held])
            # The prefix that a pair shares, for pairs that another list has, too.
            width = found.chars.shape[1]
            shared = np.array([next((k for k in range(width) if found.chars[p, k] != found.chars[r, k] or k >= found.size[p]), width) for p, r in zip(i, j, strict=True)], np.int64) if len(i) else i
            own = shared + start[i] < most[i]
            i, j = i[own], j[own]
            back = ~short[j]
            i, j = np.concatenate((i, j[back])), np.concatenate((j, i[back]))
            names, n = pa.array([h[5] for h in held], pa.string()), pa.array([h[6] for h in held], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), n.take(pa.array(j))], ["word", "near", "near_n"])

        for b in batches:
            d = b.to_pydict()
            for m, a, bb, head, tail, middle, most, word, n in zip(*(d[c] for c in (*_LIST, "middle", "most", "word", "n")), strict=True):
                if (here := (m, a, bb, head, tail)) != at:
                    if cells > CELLS:
                        yield search()
                        cells = 0
                    at, group = here, group + 1
                held.append((group, len(word) == m, middle, most, a, word, n))
                cells += len(middle) + 3
        if held:
            yield search()

    rows = lists(words, least, hot)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, *_LIST).sortWithinPartitions(*_LIST, "middle")
    return dealt.mapInArrow(scan, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow each other. Each turn doubles the steps; forms only lead to more frequent words, so there is no circle."""
    state = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = settle(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, times: int = 5, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of least_length letters and least_count occurrences or more.

    n_near: words exactly one edit away; form: the most frequent of them (of equally frequent ones the first in code-point
    order), if it is `times` as frequent as the word at least; root: the last of the forms that follow each other.

    All texts are counted whole, words before the shuffle. Pairs meet in sorted lists of words that share half of
    their letters; each list is scanned with its edit-matrix rows kept by shared prefix, and nothing but pairs leaves a
    task. Lists of more than `hot` words are parted further.

    Null and empty texts have no words; a null id counts as ''. Repeated rows count as often as they stand; an empty
    table gives no rows; other columns are not read.
    """
    counted = word_counts(docs, key, text).filter((F.length("word") >= least_length) & (F.col("n") >= least_count))
    words = settle(counted, "words")
    best = near_words(words, least_length, hot).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("x"))
    best = best.select("word", "n_near", F.col("x.near").alias("near"), (-F.col("x.less")).alias("near_n"))
    enough = F.col("near_n") >= times * F.col("n")
    met = words.join(best, "word", "left")
    met = settle(met.select("word", F.when(enough, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("near_n")).alias("form_n")), "forms")
    last = roots(met.filter("form IS NOT NULL"))
    return met.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
