"""N-gram Jaccard join: count-vector R-trees over the cells that shared shingles define, exact verification.

A document is the set of its word shingles. Its tokens (shingle hashes) are hashed into GROUPS groups;
the counts per group are a point. For two documents the sum over groups of the smaller counts bounds
the overlap from above, and for an R-tree node the counts' upper corner does so for all points below.

One tree over all documents would not prune: far fewer dimensions than tokens make unrelated points
alike. So the points are first routed to cells: with J >= 0.75, two documents share k tokens or more
within the first n - ceil(0.75 n) + k(n) of each one's tokens in a common order, so both are in those tokens'
cells; k(n) is about a tenth of n, and the smaller document's k counts. A document with fewer tokens in
company than its smallest possible partner's k has no partner and leaves its cells, which is what becomes of most that only share a passage; company is of a
size that allows the similarity. The order puts tokens that are frequent in
a sample last (any order is exact; this one keeps cells small). Each cell has R-trees over blocks of its points; pairs that pass the bound are verified on the texts.

Large sets are alike in GROUPS counts whatever they hold, so they also have a sketch: whether the tokens that hash to a bit are odd in number. Bits that
two sketches differ in are tokens that only one of the sets has, so these bound the overlap, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.shared import LEAST_TASKS, fewer, settle
from vellum.llm.textbytes import Texts, fold, mix, slices, windows

GROUPS = 256
WORDS = 5
#: Sets of more tokens have a sketch, too: a bit or two for each token, SKETCH_BITS at most (beyond about twice that many tokens it tells little).
SKETCH_FROM = 1_024
SKETCH_BITS = 1 << 15
#: Similarity NUM / DEN, compared in whole numbers.
NUM, DEN = 75, 100
#: Points of a cell in one R-tree at most; larger cells are several blocks.
BLOCK = 2_048
LEAF = 16
#: Rows of cells with one smallest member that a task gets together, about.
LOT_ROWS = 32_768
#: Rows of one task, about, where cells' points are only joined and counted, where they are searched, and where pairs' texts are compared.
JOIN_ROWS = 50_000
SEARCH_ROWS = 2_048
PAIR_ROWS = 1_024
#: Pairs that a task's trees find before it chooses from them, about.
CHOOSE_PAIRS = 1 << 18
#: Pairs that a task remembers, so as not to propose them again.
SEEN_PAIRS = 1 << 20
#: Cells of each point that turns 0 and 1 look at.
FIRST_CELLS = 8
#: Sampled documents, and how many of them must share a token for it to go last in the order.
SAMPLE_ROWS = 20_000
SAMPLE_SHARE = 12
SALTS = 64
#: Sets, and shingles, of one block when the links of a component are found, about.
LINK_ROWS = 4_096
LINK_TOKENS = 1 << 20


def company(n):
    """Routing tokens that a set of size n shares at least with each similar set that is not smaller."""
    return n // 10 + 1


def shingles(t: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) of the distinct shingles of each document of a batch, sorted."""
    start, end = t.words()
    bounds = t.per_doc(start)
    h = t.span_hash(start, end)
    token, doc = windows(h, bounds, words)
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        token = np.concatenate((token, mix(fold(h, bounds)[short] + n[short].astype(np.uint64))))
        doc = np.concatenate((doc, short))
    if len(short):
        order = np.argsort(doc, kind="stable")
        token, doc = token[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(t.n + 1)).tolist()
    for i, j in zip(bounds, bounds[1:], strict=False):  # many short sorts cost far less than one long one
        if j - i > 1:
            token[i:j].sort()
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    return doc[first], token[first]


def identity(doc: np.ndarray, token: np.ndarray, n_docs: int, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes and two fingerprints of each document's set (order does not matter).

    shared: first fingerprints that different sets have in common; such sets go by their second one instead.
    """
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    out = []
    for salt in (1, 2):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(token + np.uint64(salt)))))
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    pid, check = out
    if shared is not None and len(shared):
        pid = np.where(np.isin(pid, shared), check, pid)
    return np.diff(bounds), pid, check


def points(docs: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """(doc_id, body, n, pid, check): hash of the text, set size and fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            n, pid, check = identity(*shingles(Texts(b.column(2), lower=True), words), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(pid), pa.array(check)], ["doc_id", "body", "n", "pid", "check"])

    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text].cast("string")).alias("body"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, body long, n long, pid long, check long")


def postings(docs: DataFrame, words: int, text: str, parts: int, frequent: np.ndarray | None, shared: np.ndarray | None = None) -> DataFrame:
    """(part, tokens, owners, pids, sizes): a task's routing tokens, packed by part of the token space.

    frequent: sorted tokens that go last; None: all tokens of each document instead of the first ones.
    Tokens are sent as their low 48 bits (two that agree there share a cell, which does no harm). A frequent token is dealt out over SALTS parts by pid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            base = np.cumsum([0] + [len(h[2]) for h in held])
            token = np.concatenate([h[0] for h in held])
            owner = np.concatenate([h[1] + o for h, o in zip(held, base, strict=False)])
            pid, size = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            part = (mix(token) % np.uint64(parts)).astype(np.int64)
            if frequent is not None:
                hot = _among(token, frequent)
                part[hot] = (mix(token[hot] + (pid[owner[hot]].view(np.uint64) % np.uint64(SALTS))) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[cut[p] : cut[p + 1]]
                if len(at):
                    own, place = np.unique(owner[at], return_inverse=True)
                    packed = (token[at].view("u1").reshape(-1, 8)[:, :6].tobytes(), place.astype("<u2").tobytes(), pid[own].tobytes(), size[own].astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["part", "tokens", "owners", "pids", "sizes"])
            held.clear()

        rows = docs_held = 0
        for b in slices(batches, "t"):
            doc, token = shingles(Texts(b.column(0), lower=True), words)
            n, pid, _ = identity(doc, token, b.num_rows, shared)
            docs_held += b.num_rows
            if frequent is not None:
                # The common order: tokens that aren't frequent, by value, then those that are.
                late = _among(token, frequent)
                before = np.concatenate((np.zeros(1, np.int64), np.cumsum(late)))
                bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
                first, last = bounds[:-1][doc], bounds[1:][doc]
                lates = before[:-1] - before[first]  # frequent ones of the document up to here
                place = np.where(late, (last - first) - (before[last] - before[first]) + lates, np.arange(len(doc)) - first - lates)
                keep = place < (n - -(-n * NUM // DEN) + company(n))[doc]
                doc, token = doc[keep], token[keep]
            # Copies within a task have equal tokens: one of them is enough.
            _, one = np.unique(pid, return_index=True)
            once = np.zeros(b.num_rows, bool)
            once[one] = True
            doc, token = doc[once[doc]], token[once[doc]]
            held.append((token, doc, pid, n))
            rows += len(token)
            if rows > 2_000_000 or docs_held > 40_000:
                yield from flush()
                rows = docs_held = 0
        if rows:
            yield from flush()

    return docs.select(docs[text].cast("string").alias("t")).mapInArrow(run, "part int, tokens binary, owners binary, pids binary, sizes binary")


def _gather(batches: Iterator[pa.RecordBatch], frequent: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, token, pid, size) of the postings of each part, sorted by token, each pid once per token.

    Rows come sorted by part; a part is a bounded slice of the token space. Postings that are alone in their
    part go, but those of frequent tokens stay: these are dealt out, and their company is in other parts.
    """

    def done(part, rows):
        token, pid, size = [], [], []
        for r in rows:
            own = np.frombuffer(r[1], "<u2")
            wide = np.zeros((len(own), 8), "u1")
            wide[:, :6] = np.frombuffer(r[0], "u1").reshape(-1, 6)
            token.append(wide.view(np.uint64).ravel())
            pid.append(np.frombuffer(r[2], np.int64)[own])
            size.append(np.frombuffer(r[3], "<u4")[own])
        rows.clear()
        token, pid, size = (np.concatenate(x) for x in (token, pid, size))
        order = np.argsort(token)
        token, pid, size = token[order], pid[order], size[order]
        # Tokens of one posting meet nothing: most go here, before the dearer sort.
        same = token[1:] == token[:-1]
        some = np.zeros(len(token), bool)
        some[1:] = same
        some[:-1] |= same
        if frequent is not None:
            some |= _among(token, frequent)
        token, pid, size = token[some], pid[some], size[some]
        order = np.lexsort((pid, token))
        token, pid, size = token[order], pid[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (pid[1:] != pid[:-1])
        return part, token[new], pid[new], size[new]

    at, rows = None, []
    for b in batches:
        for part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != at and rows:
                yield done(at, rows)
            at = part
            rows.append(row)
    if rows:
        yield done(at, rows)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part")


def frequent_tokens(docs: DataFrame, words: int, text: str, key: str, parts: int) -> np.ndarray:
    """Tokens that SAMPLE_SHARE or more of at most about SAMPLE_ROWS sampled documents share, sorted.

    The sample is bounded, so at most SAMPLE_ROWS x (tokens a document) / SAMPLE_SHARE tokens come to the driver.
    """
    total = docs.count()
    some = docs.filter(F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 20)) < int(min(1, SAMPLE_ROWS / max(total, 1)) * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, token, _, _ in _gather(batches):
            found, n = np.unique(token, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([found[n >= SAMPLE_SHARE].tobytes()], pa.binary())], ["tokens"])

    found = _dealt(postings(some, words, text, parts, None), parts).mapInArrow(count, "tokens binary").collect()
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.tokens, np.uint64) for r in found)]))


LOW48 = np.uint64((1 << 48) - 1)


def _among(token: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which tokens have their low 48 bits in the sorted array frequent."""
    if not len(frequent):
        return np.zeros(len(token), bool)
    low = token & LOW48
    return frequent[np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)] == low


def _largest_only(cell: np.ndarray, pid: np.ndarray) -> np.ndarray:
    """Which cells to keep, of postings sorted by cell (numbered from 0): a cell goes if another contains it.

    Of the cells that contain it, only the one that is largest for all its members is tried.
    """
    n = np.bincount(cell)
    _, who = np.unique(pid, return_inverse=True)
    rank = np.lexsort((np.arange(len(n)), -n)).argsort()
    best = np.full(who.max() + 1 if len(who) else 0, len(n))
    np.minimum.at(best, who, rank[cell])
    lo, hi = np.full(len(n), len(n)), np.zeros(len(n), int)
    np.minimum.at(lo, cell, best[who])
    np.maximum.at(hi, cell, best[who])
    return (lo != hi) | (lo == rank)


def cells(docs: DataFrame, classes: DataFrame, words: int, text: str, parts: int, frequent: np.ndarray, shared: np.ndarray | None = None) -> DataFrame:
    """(cell, block, pid): who meets whom, for cells of two points or more, without cells that others contain.

    A cell of a token that is not frequent is small against the table (it would be in the sample's list);
    frequent ones are dealt out in SALTS parts, then in blocks of about BLOCK points, and never gathered.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(cell, salt, pid, met=None):
            n = len(pid)
            full = lambda x, d: x if isinstance(x, np.ndarray) else np.full(n, x, d)
            return pa.RecordBatch.from_arrays([pa.array(full(cell, np.int64)), pa.array(full(salt, np.int32)), pa.array(pid), pa.array(full(0 if met is None else met, np.int64))], ["cell", "salt", "pid", "met"])

        for _, token, pid, size in _gather(batches, frequent):
            hot = _among(token, frequent)
            t, p, z = token[~hot], pid[~hot], size[~hot].astype(np.int64)
            # A point stays in a cell only with a neighbour in size that allows the similarity.
            order = np.lexsort((z, t))
            t, p, z = t[order], p[order], z[order]
            near = (t[1:] == t[:-1]) & (DEN * z[:-1] >= NUM * z[1:])
            some = np.zeros(len(t), bool)
            some[1:] = near
            some[:-1] |= near
            t, p = t[some], p[some]
            # Tokens in company of each point: those of its routing tokens that some such neighbour has, too (of frequent ones, all).
            who, met = np.unique(np.concatenate((p, pid[hot])), return_counts=True)
            if len(who):
                yield rows(-1, -2, who, met)
            if len(t):
                _, cell = np.unique(t, return_inverse=True)
                keep = _largest_only(cell, p)[cell]
                yield rows(t[keep].view(np.int64), -1, p[keep])
            if hot.any():
                yield rows(token[hot].view(np.int64), (pid[hot].view(np.uint64) % np.uint64(SALTS)).astype(np.int32), pid[hot])

    found = settle(_dealt(postings(docs, words, text, parts, frequent, shared), parts).mapInArrow(first, "cell long, salt int, pid long, met long"), "routes")
    flat = found.filter
    met = flat("salt = -2").groupBy("pid").agg(F.sum("met").alias("met"))
    able = met.join(classes.select("pid", "n"), "pid").filter(F.col("met") >= F.floor(F.ceil(F.col("n") * NUM / DEN) / 10) + 1).select("pid")
    left = settle(flat("salt >= -1").select("cell", "salt", "pid").join(able, "pid"), "routes")
    # Frequent tokens: blocks of bounded size by a hash of the point. As many as the whole cell needs, not its parts: points ask in every block.
    hot = left.filter("salt >= 0")
    split = hot.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    hot = hot.join(split, "cell").select("cell", F.pmod(F.xxhash64("pid"), F.col("k")).cast("int").alias("block"), "pid")
    plain = left.filter("salt < 0").groupBy("cell").agg(F.collect_list("pid").alias("members"), F.min("pid").alias("low")).filter(F.size("members") > 1)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column(1).offsets.to_numpy())
            who = b.column(1).flatten().to_numpy()
            cell = np.repeat(np.arange(len(n)), n)
            keep = _largest_only(cell, who)[cell] if len(who) else np.zeros(0, bool)
            place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[cell[keep]]), pa.array((place[keep] // BLOCK).astype(np.int32)), pa.array(who[keep])], ["cell", "block", "pid"])

    # Cells of one group of near copies mostly have the same smallest member: there they meet again.
    plain = plain.repartition(parts, "low").sortWithinPartitions("low").select("cell", "members").mapInArrow(second, "cell long, block int, pid long")
    return plain.unionByName(hot)


_LANES = np.uint64(0x00FF00FF00FF00FF)


def overlap_bound(a: np.ndarray, over_a: np.ndarray, b: np.ndarray, over_b: np.ndarray) -> np.ndarray:
    """Sums over the groups of the smaller of two counts, row by row, and of what is over 255 in them.

    Counts are held in one byte each; over: the part of the set size beyond their sum.
    """
    v = np.minimum(a, b).view(np.uint64)
    x = ((v & _LANES) + ((v >> np.uint64(8)) & _LANES)).sum(1)  # four sums of 16 bits
    x = (x & np.uint64(0xFFFF)) + ((x >> np.uint64(16)) & np.uint64(0xFFFF)) + ((x >> np.uint64(32)) & np.uint64(0xFFFF)) + (x >> np.uint64(48))
    return x.astype(np.int64) + np.minimum(over_a, over_b)


def _bounds(counts: np.ndarray, over: np.ndarray, a: np.ndarray, upper: np.ndarray, upper_over: np.ndarray, b: np.ndarray) -> np.ndarray:
    """overlap_bound() of rows a of counts and rows b of upper, a bounded number at a time."""
    step = 32_768
    return np.concatenate([np.zeros(0, np.int64), *(overlap_bound(counts[a[i : i + step]], over[a[i : i + step]], upper[b[i : i + step]], upper_over[b[i : i + step]]) for i in range(0, len(a), step))])


def sketches(doc: np.ndarray, token: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The sketch of each of the sets of n tokens, empty for those of SKETCH_FROM or fewer: whether the tokens that hash to a bit are odd in number."""
    out = [b""] * len(n)
    for i in np.flatnonzero(n > SKETCH_FROM).tolist():
        bits = min(1 << int(n[i] - 1).bit_length(), SKETCH_BITS)
        own = token[slice(*np.searchsorted(doc, (i, i + 1)))]
        out[i] = np.packbits(np.bincount((own >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits).astype("u1") & 1).tobytes()
    return out


def differences(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of bits that sketches a and b (their rows) differ in, which tokens of just one of the two sets do at least; 0 without a sketch.

    A sketch is folded to half its bits by exclusive or, so those of unequal length are compared at the shorter one's.
    """
    out = np.zeros(len(a), np.int64)
    words = np.fromiter(map(len, sketch), np.int64, len(sketch)) // 8
    pairs = np.flatnonzero((words[a] > 0) & (words[b] > 0))
    used = np.unique(np.concatenate((a[pairs], b[pairs])))
    start, flat = np.zeros(len(sketch), np.int64), np.frombuffer(b"".join(sketch[used]), np.uint64)
    start[used] = np.cumsum(words[used]) - words[used]
    long = words[a[pairs]] * SKETCH_BITS + words[b[pairs]]
    for both in np.unique(long).tolist():
        (x, y), like = divmod(both, SKETCH_BITS), pairs[long == both]
        least = min(x, y)
        folded = lambda who, k, least=least: np.bitwise_xor.reduce(flat[start[who][:, None] + np.arange(k)].reshape(len(who), -1, least), axis=1)
        step = max(1, (1 << 18) // max(x, y))
        for i in (like[lo : lo + step] for lo in range(0, len(like), step)):
            out[i] = np.bitwise_count(folded(a[i], x) ^ folded(b[i], y)).sum(1, dtype=np.int64)
    return out


class RTree:
    """R-tree of count vectors, bulk-loaded in order of size: every node has its points' upper corner and size range."""

    def __init__(self, counts: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((counts.argmax(1), n))
        level = (np.ascontiguousarray(counts[self.order]), n[self.order], n[self.order], (n - counts.sum(1, dtype=np.int64))[self.order])
        self.levels = [level]
        while len(level[0]) > LEAF:
            at = np.arange(0, len(level[0]), LEAF)
            level = (np.maximum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)

    def search(self, q: np.ndarray, nq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) of all pairs whose sizes and bound allow the similarity."""
        over = nq - q.sum(1, dtype=np.int64)
        top = len(self.levels[-1][0])
        who, node = np.repeat(np.arange(len(q)), top), np.tile(np.arange(top), len(q))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high, upper_over = self.levels[depth]
            keep = (DEN * high[node] >= NUM * nq[who]) & (DEN * nq[who] >= NUM * low[node])
            who, node = who[keep], node[keep]
            bound = _bounds(q, over, who, upper, upper_over, node)
            keep = (NUM + DEN) * bound >= NUM * (nq[who] + low[node])
            who, node, bound = who[keep], node[keep], bound[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                child = node[:, None] * LEAF + np.arange(LEAF)
                real = child < below
                who, node = np.repeat(who, real.sum(1)), child[real]
        return who, self.order[node], bound


def _reach(turn: int) -> int:
    """How many places of a point's list of candidates a turn tries: 1, 8, 64 ...

    Always from the first place: labels change, so a point may ask late that did not ask before.
    """
    return 8 ** (turn - 1)


def candidates(members: DataFrame, turn: int, parts: int) -> DataFrame:
    """(a, b, more) of one turn, from rows (cell, block, pid, n, counts, label, asks); where a = b, that is a cell, and more its pairs left for later turns.

    A column sketch, if there is one, has sketches(), which bound the overlap of large sets.
    A further column near, the same in all rows of a cell, brings cells to one task: two points are mostly together in many cells,
    and a task proposes them once. parts: tasks at most, whatever least number of partitions a session holds to.

    Turn 0 proposes each point's best partner in its block. Later turns propose, for each asking point,
    the first partners in the block, more in each turn, best bound first, without those of its own label.
    In the last turn, which leaves none, every pair of different labels with an asking point is proposed.
    """

    def choose(a, b, bound, pid, n, label, asks, sketch, at):
        """The pairs of a's with b's that this turn proposes, and the a's whose other pairs are left for later ones."""
        keep = (pid[a] != pid[b]) & (label[a] != label[b])
        if not turn:  # earlier ones only: a tree of proposals, no cycles; those who only ask find later ones too
            keep &= (n[a] > n[b]) | ((n[a] == n[b]) & (pid[a] > pid[b])) | (asks[a] == 2)
        a, b, bound = a[keep], b[keep], bound[keep]
        bound = np.minimum(bound, (n[a] + n[b] - differences(sketch, a, b)) // 2)
        keep = (NUM + DEN) * bound >= NUM * (n[a] + n[b])
        a, b, bound = a[keep], b[keep], bound[keep]
        order = np.lexsort((pid[b], -bound, a))
        a, b = a[order], b[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        pick = place < (_reach(turn) if turn else np.where(asks[a] == 2, 4, 1))
        return np.minimum(pid[a], pid[b])[pick], np.maximum(pid[a], pid[b])[pick], at[a[~pick]]

    def large(first, size, pid, n, counts, label, asks, sketch, at):
        """Blocks of several leaves, a tree for each; what their trees find is chosen from together, CHOOSE_PAIRS or more at a time."""
        held, sofar = [], 0

        def chosen():
            a, b, bound = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return choose(a, b, bound, pid, n, label, asks, sketch, at)

        for f, m in zip(first.tolist(), size.tolist(), strict=True):
            x = f + np.flatnonzero(asks[f : f + m] < 2)  # 2: a point of another block that only asks here
            ask = f + np.flatnonzero(asks[f : f + m] > 0) if turn else np.arange(f, f + m)
            tree = RTree(counts[x], n[x]) if len(ask) else None
            for lo in range(0, len(ask), 512):
                q = ask[lo : lo + 512]
                who, node, bound = tree.search(counts[q], n[q])
                held.append((q[who], x[node], bound))
                sofar += len(who)
                if sofar >= CHOOSE_PAIRS:
                    yield chosen()
                    sofar = 0
        if held:
            yield chosen()

    def small(first, size, pid, n, counts, label, asks, sketch, at):
        """Blocks that are a single leaf, all at once: first and size of each."""
        over = n - counts.sum(1, dtype=np.int64)
        for lo in range(0, len(first), 4_096):
            f, m = first[lo : lo + 4_096], size[lo : lo + 4_096]
            ask = np.repeat(f - (np.cumsum(m) - m), m) + np.arange(m.sum())
            f, m = np.repeat(f, m), np.repeat(m, m)
            if turn:
                f, m, ask = f[asks[ask] > 0], m[asks[ask] > 0], ask[asks[ask] > 0]
            a = np.repeat(ask, m)
            b = np.repeat(f - (np.cumsum(m) - m), m) + np.arange(m.sum())
            keep = (asks[b] < 2) & (label[a] != label[b]) & (DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b]))
            a, b = a[keep], b[keep]
            bound = _bounds(counts, over, a, counts, over, b)
            keep = (NUM + DEN) * bound >= NUM * (n[a] + n[b])
            yield choose(a[keep], b[keep], bound[keep], pid, n, label, asks, sketch, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sofar = [], 0
        seen = np.zeros((0, 2), np.int64)

        def unseen(pairs):
            """Those of different pairs that aren't among seen."""
            both = np.concatenate((seen, pairs))
            order = np.lexsort((both[:, 1], both[:, 0]))  # stable: what is seen goes first
            new = np.ones(len(both), bool)
            new[order[1:]] = (both[order[1:]] != both[order[:-1]]).any(1)
            return pairs[new[len(seen) :]]

        def done(cols):
            nonlocal seen
            key, *cols = cols
            cols.append(np.arange(len(key)))
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
            size = np.diff(np.append(first, len(key)))
            found = [*small(first[size <= LEAF], size[size <= LEAF], *cols), *large(first[size > LEAF], size[size > LEAF], *cols)]
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
            pairs = np.unique(np.stack((a, b), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            pairs = unseen(pairs)
            seen = np.concatenate((seen, pairs)) if len(seen) + len(pairs) <= SEEN_PAIRS else pairs[:SEEN_PAIRS]  # pairs met again become one later
            left, more = np.unique(np.concatenate([np.zeros(0, np.int64), *(key[f[2], 0] for f in found)]), return_counts=True)
            a, b = (np.concatenate((pairs[:, i], left)) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate((np.zeros(len(pairs), np.int64), more)))], ["a", "b", "more"])

        for b in batches:
            key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)], 1)
            counts = np.frombuffer(b"".join(b.column(4).to_pylist()), "u1").reshape(-1, GROUPS)
            held.append((key, b.column(2).to_numpy(), b.column(3).to_numpy(), counts, b.column(5).to_numpy(), b.column(6).to_numpy(), _objects(b.column(8))))
            sofar += b.num_rows
            if sofar >= 8_192 and (key[0] != key[-1]).any():
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                last = int(np.flatnonzero((cols[0] != cols[0][-1]).any(1))[-1]) + 1  # the last block may go on
                yield done([c[:last] for c in cols])
                held, sofar = [tuple(c[last:] for c in cols)], len(cols[0]) - last
        if held:
            yield done([np.concatenate(c) for c in zip(*held, strict=True)])

    near = F.col("near" if "near" in members.columns else "cell").alias("near")
    sketch = (F.col("sketch") if "sketch" in members.columns else F.lit(b"")).alias("sketch")
    rows = members.select("cell", "block", "pid", "n", "counts", "label", F.col("asks").cast("int").alias("asks"), near, sketch)
    return rows.repartition(parts, "near", "block").coalesce(parts).sortWithinPartitions("near", "cell", "block").mapInArrow(run, "a long, b long, more long")


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def untried(found: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs (a, b) of candidates(), each once, that aren't among tried: pairs found in many cells meet before they are compared."""
    rows = found.filter("a <> b").select("a", "b", F.lit(False).alias("old")).unionByName(tried.select("a", "b", F.lit(True).alias("old")))
    return rows.groupBy("a", "b").agg(F.max("old").alias("old")).filter("NOT old").select("a", "b")


def links(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose texts (pid, t) have the similarity. Both tables are written ones, so that to count them costs little."""
    size = max(pairs.count(), texts.count() // 8)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, "ta", 1 << 19), "tb", 1 << 19):
            n, keys = [], []
            for c in (2, 3):
                doc, token = shingles(Texts(b.column(c), lower=True), words)
                n.append(np.bincount(doc, minlength=b.num_rows))
                keys.append((doc, mix(token + mix(doc.astype(np.uint64)))))
            both = np.bincount(keys[0][0][np.isin(keys[0][1], keys[1][1])], minlength=b.num_rows)
            good = DEN * both >= NUM * (n[0] + n[1] - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], ["a", "b"])

    left = texts.select(F.col("pid").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("pid").alias("b"), F.col("t").alias("tb"))
    met = fewer(fewer(pairs.join(left, "a"), size, PAIR_ROWS).join(right, "b"), size, PAIR_ROWS)
    return met.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _block_links(pid: np.ndarray, side: np.ndarray, n: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pid, number of links) between the sets of side 0 and those of side 1, or among all if there is no side 1; token: those of each set in turn."""
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(token)
    same = token[order][1:] == token[order][:-1]
    shared = np.zeros(len(token), bool)  # only tokens of two sets or more count
    shared[1:] = same
    shared[:-1] |= same
    order = order[shared]
    at = np.cumsum(np.concatenate(([False], token[order][1:] != token[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    doc = doc[order]
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(y)
    y = x if alone else y
    both, part = (np.zeros((len(x), len(y)), np.float32) for _ in range(2))  # whole numbers below 2**24: exact
    step = 2_048
    cut = np.searchsorted(at, np.arange(0, (at[-1] + 1 if len(at) else 0) + step, step))
    for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
        has = np.zeros((len(n), step), np.float32)
        has[doc[i:j], at[i:j] - k * step] = 1
        np.matmul(has[x], has[y].T, out=part)
        both += part
    degree = np.zeros(len(n), np.int64)
    for lo in range(0, len(x), 256):
        strip = both[lo : lo + 256].astype(np.int64)
        link = DEN * strip >= NUM * (n[x[lo : lo + 256]][:, None] + n[y][None, :] - strip)
        degree[x[lo : lo + 256]] += link.sum(1)
        if not alone:
            degree[y] += link.sum(0)
    return pid, degree - (1 if alone else 0)  # every set is like itself


def all_links(home: DataFrame, texts: DataFrame, words: int, parts: int) -> DataFrame:
    """(pid, n_links) of the sets of home (pid, n, root) with a link: how many others each is linked with; root: the component, texts: (pid, t).

    Linked sets are in one component, so each component is compared with itself, all pairs exactly, and only
    counts leave a task. Components of over LINK_ROWS sets or LINK_TOKENS shingles are compared block by block: blocks
    are by size, then by hash, and only blocks of sizes within a factor of 4/3 meet.
    """
    total = home.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"), F.min("pid").alias("a"), F.max("pid").alias("b")).filter("m > 1")
    two = total.filter("m = 2").select(F.explode(F.array("a", "b")).alias("pid"), F.lit(1).cast("long").alias("n_links"))
    # Steps of 1.34, a little more than 4/3: linked sets are at most one step apart.
    step = F.when((F.col("m") <= LINK_ROWS) & (F.col("s") <= LINK_TOKENS), 0).otherwise(F.floor(F.log("n") / F.log(F.lit(1.34)))).cast("int")
    sized = home.join(total.filter("m > 2").select("root", "m", "s"), "root").withColumn("g", step)
    blocks = sized.groupBy("root", "g").agg(F.ceil(F.greatest(F.count("*") / LINK_ROWS, F.sum("n") / LINK_TOKENS)).cast("int").alias("k"))
    blocks = settle(blocks, "blocks")
    at = lambda d, name: blocks.select("root", (F.col("g") + d).alias("g"), F.col("k").alias(name))
    dealt = sized.join(blocks, ["root", "g"]).join(at(-1, "up"), ["root", "g"], "left").join(at(1, "down"), ["root", "g"], "left")
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("pid"), F.col("k")).cast("int"))
    none = F.array().cast("array<int>")
    upto = lambda lo, n: F.when(n > lo, F.sequence(lo, n - 1)).otherwise(none)
    meet = lambda g, i, h, j, side: F.struct(g.alias("g"), i.alias("i"), h.alias("h"), j.alias("j"), F.lit(side).alias("side"))
    g, i, zero = F.col("g"), F.col("i"), F.lit(0)
    where = F.concat(
        F.transform(upto(i, F.col("k")), lambda j: meet(g, i, g, j, 0)),
        F.transform(upto(zero, i), lambda j: meet(g, j, g, i, 1)),
        F.transform(upto(zero, F.coalesce("up", zero)), lambda j: meet(g, i, g + 1, j, 0)),
        F.transform(upto(zero, F.coalesce("down", zero)), lambda j: meet(g - 1, j, g, i, 1)),
    )
    groups = dealt.select("root", "pid", F.explode(where).alias("w")).select("root", "w.g", "w.i", "w.h", "w.j", "w.side", "pid").join(texts, "pid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            pid, degree = _block_links(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pid), pa.array(degree)], ["pid", "n_links"])

        for b in slices(batches, "t"):
            doc, token = shingles(Texts(b.column(7), lower=True), words)
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1))
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(5)], 1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if held and at != tuple(key[lo]):
                    yield done()
                at = tuple(key[lo])
                held.append((b.column(6).to_numpy()[lo:hi], b.column(5).to_numpy()[lo:hi], np.diff(bounds[lo : hi + 1]), token[bounds[lo] : bounds[hi]]))
        if held:
            yield done()

    order = ["root", "g", "i", "h", "j"]
    met = groups.select(*order, "side", "pid", "t").repartition(parts, *order).sortWithinPartitions(*order)
    return met.mapInArrow(run, "pid long, n_links long").unionByName(two).groupBy("pid").agg(F.sum("n_links").alias("n_links"))


def _labelled(docs: DataFrame, words: int, parts: int | None, text: str, key: str, count: bool = False) -> DataFrame:
    """points() with root and component_id of each row, and n_links if they are to be counted; nulls for rows without shingles."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    point = settle(points(docs, words, text, key), "points")
    group = lambda: point.filter("n > 0").groupBy("pid").agg(F.min("doc_id").alias("low"), F.min("body").alias("body"), F.min("n").alias("n"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    classes = settle(group(), "classes")
    # Different sets with one 64-bit fingerprint: a few in 10**10 sets.
    shared = np.array([r.pid for r in classes.filter("c0 <> c1").select("pid").collect()], np.int64)
    if len(shared):
        point = point.withColumn("pid", F.when(F.col("pid").isin(shared.tolist()), F.col("check")).otherwise(F.col("pid")))
        classes = settle(group(), "classes")
    frequent = frequent_tokens(docs, words, text, key, parts)
    cell = settle(cells(docs, classes, words, text, parts, frequent, shared), "cells")
    active = cell.select("pid").distinct()
    # One text of each point that meets another; recognised by its fingerprint, as ids may repeat.
    wanted = classes.join(active, "pid", "left_semi").select(F.coalesce("low", "body").alias("w"), F.col("low").isNull().alias("void"), F.col("pid").alias("want"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            doc, token = shingles(Texts(b.column(0), lower=True), words)
            n, pid, _ = identity(doc, token, b.num_rows, shared)
            same = pa.array(pid == b.column(1).to_numpy())
            group = (token % np.uint64(GROUPS)).astype(np.int64)
            counts = np.minimum(np.bincount(doc * GROUPS + group, minlength=b.num_rows * GROUPS), 255).astype("u1")
            columns = [b.column(1), b.column(0), pa.array(n), pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS), b.num_rows, [None, pa.py_buffer(counts)]).cast(pa.binary()), pa.array(sketches(doc, token, n), pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(same) for c in columns], ["pid", "t", "n", "counts", "sketch"])

    # Rows without an id are found by the hash of their text, so that they aren't one key.
    text_of, id_of = docs[text].cast("string"), docs[key].cast("long")
    rows = docs.select(F.coalesce(id_of, F.xxhash64(text_of)).alias("w"), id_of.isNull().alias("void"), text_of.alias("t")).join(wanted, ["w", "void"])
    texts = settle(rows.select("t", "want").mapInArrow(own, "pid long, t string, n long, counts binary, sketch binary").dropDuplicates(["pid"]), "texts")
    point_of = texts.select("pid", "n", "counts", "sketch")
    texts = texts.select("pid", "t")
    blocks = cell.groupBy("cell", "block").agg(F.min("pid").alias("pilot"))
    many = settle(blocks.join(blocks.groupBy("cell").count().filter("count > 1"), "cell", "left_semi"), "blocks")

    # Turn 0: best partners, of each point in its FIRST_CELLS largest cells only; in cells of several blocks, a few pilots ask in all of them.
    searchers = lambda n: min(parts, max(LEAST_TASKS, -(-n // SEARCH_ROWS)))
    size = cell.count()
    sizes = cell.groupBy("cell").agg(F.count("*").alias("m"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("m"), "cell"))
    largest = settle(fewer(fewer(cell.join(sizes, "cell"), size, JOIN_ROWS).withColumn("k", rank).filter(F.col("k") <= FIRST_CELLS).select("cell", "block", "pid"), size, JOIN_ROWS), "cells")
    pilots = many.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("pilot"))).filter("k <= 4").select("cell", F.col("pilot").alias("pid"), F.col("block").alias("home"))
    guests = pilots.join(many.select("cell", "block"), "cell").filter("block <> home").select("cell", "block", "pid").join(point_of, "pid")
    shape = ["cell", "block", "pid", "n", "counts", "label", "asks", "sketch"]
    first = largest.join(point_of, "pid").withColumn("asks", F.lit(1)).unionByName(guests.withColumn("asks", F.lit(2))).withColumn("label", F.col("pid"))
    tried = settle(fewer(candidates(first.select(shape), 0, searchers(size)).filter("a <> b").select("a", "b").distinct(), size, JOIN_ROWS), "tried")
    edges = settle(links(tried, texts, words), "links")
    # Turn 1: the same cells with the labels so far, until hardly any new links are found: else each point of a growing group asks
    # in all of its cells, though its first link would do. Later turns: all cells in which pairs may be left that no turn has tried.
    turn, open_ = 1, largest
    label = settle(components(edges), "labels")
    while True:
        size = open_.count()
        few = lambda df, size=size: fewer(df, size, JOIN_ROWS)
        now = few(open_.join(label.select(F.col("node").alias("pid"), "root"), "pid", "left")).select("cell", "block", "pid", F.coalesce("root", "pid").alias("label"))
        votes = few(now.groupBy("cell", "label").agg(F.count("*").alias("count"), F.min("pid").alias("low")))
        main = few(votes.groupBy("cell").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("labels"), F.min("low").alias("low"), F.sum("count").alias("size")).filter("labels > 1")).select("cell", F.col("m.label").alias("main"), "low", "size")
        # Cells that hold the same points mostly have the same smallest one; a bounded number of their rows go to one task.
        lots = main.groupBy("low").agg(F.ceil(F.sum("size") / LOT_ROWS).alias("lots"))
        main = few(main.join(lots, "low")).select("cell", "main", F.xxhash64("low", F.pmod(F.xxhash64("cell"), "lots")).alias("near"))
        # Points outside their cell's main component ask in all blocks of the cell. Of two points with different labels one
        # asks, so a cell in which no asking point has pairs left is done for good.
        now = few(now.join(main, "cell")).withColumn("asks", F.when(F.col("label") != F.col("main"), 1).otherwise(0))
        guests = few(now.filter("asks = 1").withColumnRenamed("block", "home").join(many.select("cell", "block"), "cell")).filter("block <> home").withColumn("asks", F.lit(2))
        asked = ["cell", "block", "pid", "label", "asks", "near"]
        rows = fewer(now.select(asked).unionByName(guests.select(asked)).join(point_of, "pid"), size, SEARCH_ROWS)
        found = settle(candidates(rows.select(*shape, "near"), turn, searchers(size)), "found")
        fresh = settle(fewer(untried(found, tried), found.count() + tried.count(), JOIN_ROWS), "tried")
        new = settle(links(fresh, texts, words), "links")
        some = new.count()
        if some:
            edges = settle(fewer(edges.unionByName(new).distinct(), edges.count() + some, JOIN_ROWS), "links")
        left = found.filter("a = b").select(F.col("a").alias("cell")).distinct()
        none = not left.limit(1).count()
        if none and turn > 1:
            break
        tried = tried.unionByName(fresh)
        # A turn that links well is made again with the new labels before more places are tried.
        on = none or 10 * some <= fresh.count()
        open_ = cell if on and turn == 1 else settle(few(open_.join(left, "cell", "left_semi")), "cells")
        turn += on
        if some:
            label = settle(components(edges), "labels")
    if some:
        label = settle(components(edges), "labels")
    home = classes.select("pid", "low").join(label.select(F.col("node").alias("pid"), "root"), "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    least = home.groupBy("root").agg(F.min("low").alias("component_id"))
    home = home.join(least, "root").select(F.col("pid").alias("p"), "root", "component_id")
    if count:  # the search leaves out links inside a component
        inside = label.select(F.col("node").alias("pid"), "root").join(classes.select("pid", "n"), "pid")
        degree = all_links(settle(inside, "inside"), texts, words, parts).withColumnRenamed("pid", "p")
        home = home.join(degree, "p", "left")
    return point.join(home, (F.col("pid") == F.col("p")) & (F.col("n") > 0), "left")


def ngram_join(docs: DataFrame, words: int = WORDS, parts: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of docs.

    Words are runs of bytes other than \\x20 and \\x09-\\x0D, A-Z lower-cased; sets are of `words`-word
    shingles, or of the whole sequence if it is shorter. Rows with 100 * |intersection| >= 75 * |union| are
    linked; component_id is the smallest doc_id in the connected component. n_links: the number of other
    sets that the row's set is linked with (copies share one set); every pair within a component is compared.

    Null, empty and blank texts have 0 shingles and are linked with nothing: component_id is their own
    doc_id. Rows that repeat a doc_id are rows of their own; rows with a null doc_id are linked as others
    and show the smallest id of their component, null if it has none. Other columns are not read.
    """
    out = _labelled(docs, words, parts, text, key, count=True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, words: int = WORDS, parts: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each component of ngram_join().

    The row with the smallest doc_id stays (nulls last; of rows that repeat it, one with the smallest text
    hash). Rows without shingles are linked with nothing, and all stay.
    """
    found = _labelled(docs, words, parts, text, key).select("n", "root", F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), "body").alias("who"))
    lead = found.filter("n > 0").groupBy("root").agg(F.min("who").alias("who")).select("who.id", "who.body", F.lit(True).alias("one"))
    bare = found.filter("n = 0").select("who.id", "who.body", F.lit(False).alias("one")).distinct()
    stay = lead.unionByName(bare).select(F.coalesce("id", F.lit(-(1 << 63))).alias("_id"), F.col("body").alias("_body"), F.col("one").alias("_one"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[key].cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(docs[text].cast("string")).alias("_body"))
    met = rows.join(stay, ["_id", "_body"])
    # Rows that repeat both id and text are alike: the first of them is as good as any.
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_body").orderBy("_one")))
    return met.filter("NOT _one OR _n = 1").select("row.*")
