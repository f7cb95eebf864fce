"""Best-fit packing of token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.encode import Encoder
from vellum.llm.shared import settle
from vellum.llm.textbytes import slices

CAPACITY = 4096


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the fullest bin that it still fits."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = used >> s
        if fits:
            room = s + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(i))
        if room > s:
            by_room[room - s].append(b)
            used |= 1 << (room - s)
    return bins


def _sums(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sums of one or two of a bin's items, rising, and the items (places in the bin; -1: none) of each."""
    order = np.argsort(sizes, kind="stable")
    size, at, many = np.unique(sizes[order], return_index=True, return_counts=True)
    again = np.flatnonzero(many > 1)
    one, second = order[at], order[at[again] + 1]
    i, j = np.triu_indices(len(size), 1)
    total = np.concatenate((size, size[i] + size[j], 2 * size[again]))
    items = np.concatenate((np.stack((one, np.full(len(one), -1)), 1), np.stack((one[i], one[j]), 1), np.stack((one[again], second), 1)))
    total, first = np.unique(total, return_index=True)
    return total, items[first]


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Exchange items between underfull bins until no exchange raises the sum of squared fills; emptied bins go.

    A move puts one or two items of the giving bin into another; a one-for-one or two-for-one exchange takes
    a smaller item back. Each underfull bin gives in turn, the emptiest first; of all exchanges with all other bins
    it makes the one that raises the squares most. A bin that changed rests until the next turn; a turn
    without a change is the last. All items of all underfull bins are looked at: a bin has less than
    sqrt(2 * capacity) different sizes, and for each of the taker's the best sum of the giver's is found by bisection.
    """
    full = [b for b in bins if sizes[b].sum() == capacity]
    open_ = [np.array(b) for b in bins if sizes[b].sum() < capacity]
    while len(open_) > 1:
        fill = np.array([sizes[b].sum() for b in open_])
        # What a taker can give back: nothing, or an item of one of its sizes.
        back = [np.unique(sizes[b], return_index=True) for b in open_]
        whose = np.repeat(np.arange(len(open_)), [len(x) + 1 for x, _ in back])
        size = np.concatenate([np.append(0, x) for x, _ in back])
        place = np.concatenate([np.append(-1, at) for _, at in back])
        room = (capacity - fill)[whose] + size
        rests = np.zeros(len(open_), bool)
        for giver in np.argsort(fill, kind="stable"):
            if rests[giver]:
                continue
            total, items = _sums(sizes[open_[giver]])
            best = np.searchsorted(total, room, side="right") - 1
            gain = np.where(best >= 0, total[np.maximum(best, 0)], 0) - size
            rise = np.where((gain > 0) & (whose != giver) & ~rests[whose], gain * (fill[whose] - fill[giver] + gain), 0)
            k = int(rise.argmax())
            if rise[k] <= 0:
                continue
            taker, out, theirs = whose[k], items[best[k]], place[k]
            out = out[out >= 0]
            g, t = open_[giver], open_[taker]
            open_[giver] = np.append(np.delete(g, out), t[[theirs]] if theirs >= 0 else t[:0])
            open_[taker] = np.append(np.delete(t, theirs) if theirs >= 0 else t, g[out])
            rests[[giver, taker]] = True
        if not rests.any():
            break
        left = [b for b in open_ if len(b)]
        full += [b.tolist() for b in left if sizes[b].sum() == capacity]
        open_ = [b for b in left if sizes[b].sum() < capacity]
    return full + [b.tolist() for b in open_]


def pack(pieces: DataFrame, rows_per_group: int = 20_000, capacity: int = CAPACITY) -> DataFrame:
    """pieces plus sequence_id and offset. pieces has a column length from 1 to capacity.

    Rows are dealt at random into groups of about rows_per_group, each packed in one task (a group is
    bounded at any size of the input); then the items of bins that are not nearly full are packed
    once more in as many groups as they need, so that few bins stay underfull.
    """
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("nearly_full")).schema

    def run(rows: DataFrame, rows_in: int, base: int) -> DataFrame:
        groups = max(1, -(-rows_in // rows_per_group))

        def bins(t: pa.Table) -> pa.Table:
            t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32") if c in t.column_names])
            sizes = t.column("length").to_numpy().astype(np.int64)
            g = t.column("group")[0].as_py()
            found = local_search(best_fit(sizes, capacity), sizes, capacity)
            seq, offset, full = (np.zeros(len(sizes), np.int64) for _ in range(3))
            for n, items in enumerate(found):
                ends = np.cumsum(sizes[items])
                seq[items] = base + g * (rows_per_group * 8) + n
                offset[items] = ends - sizes[items]
                full[items] = ends[-1] >= 0.995 * capacity
            t = t.drop_columns(["group"])
            return pa.table([*t.columns, pa.array(seq), pa.array(offset), pa.array(full.astype(bool))], schema=t.schema.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64())).append(pa.field("nearly_full", pa.bool_())))

        dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        return dealt.groupBy("group").applyInArrow(bins, schema)

    first = settle(run(pieces, pieces.count(), 0), "packed")
    rest = first.filter("NOT nearly_full").drop("sequence_id", "offset", "nearly_full")
    again = run(rest, rest.count(), 1 << 56)
    return first.filter("nearly_full").unionByName(again).drop("nearly_full")


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with end_id, cut every capacity ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        for b in slices(batches, "t", 1 << 20):
            rows, piece, start, length, crc = [], [], [], [], []
            for r, ids in enumerate(enc.encode(b.column(1), end_id)):
                ids = ids.astype("<u4")
                for p in range(0, len(ids), capacity):
                    part = ids[p : p + capacity]
                    rows.append(r)
                    piece.append(p // capacity)
                    start.append(p)
                    length.append(len(part))
                    crc.append(crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    A null or empty text is the end id alone. Only documents of more than capacity ids are cut. Repeated
    rows and null keys are packed like others; other columns are not read; an empty table gives none.
    """
    return pack(settle(token_pieces(docs, vocabulary, end_id, capacity, text, key), "pieces"), capacity=capacity)
