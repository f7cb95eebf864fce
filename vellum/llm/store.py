"""Content-addressed store of token ids: unique chunks, document recipes and Merkle manifests, as Parquet."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.encode import Encoder
from vellum.llm.shared import range_bounds
from vellum.llm.textbytes import slices

#: A chunk ends after an id at which the rolling hash of the last WINDOW ids has its CUT_BITS high bits at 0:
#: every 128 ids on average, so that a shared passage of a few hundred ids has whole chunks of its own.
WINDOW = 8
CUT_BITS = 7
LONGEST = 8192
DIGEST = 16
NULL_KEY = -(1 << 63)

_GEAR = np.random.Generator(np.random.PCG64(41)).integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COLUMNS = "kind string, shard int, digest binary, payload binary, doc_id long, n_tokens long"
ROW = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def cuts(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ends of the content-defined chunks of id streams; stream i has ids[off[i]:off[i + 1]]. The same run of ids is cut alike in any.

    The hash at a place covers the WINDOW ids up to it; the first WINDOW ids of a stream aren't cut.
    """
    g = _GEAR[ids & 0xFFFF]
    h = np.zeros(len(ids), np.uint64)
    for j in range(min(WINDOW, len(ids))):
        h[j:] += g[: len(ids) - j] << np.uint64(j)
    at = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1
    at = at[at - off[np.searchsorted(off, at - 1, side="right") - 1] > WINDOW]
    ends = np.union1d(at, off[1:][np.diff(off) > 0])
    more = (np.diff(ends, prepend=off[0]) - 1) // LONGEST  # cuts inside chunks that would be longer
    start = np.concatenate((off[:1], ends[:-1]))
    steps = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.union1d(ends, np.repeat(start, more) + steps * LONGEST)


def _binary(body: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrow array of consecutive pieces of some bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)])


def leaf(kind: str, key: bytes) -> bytes:
    return blake2b(kind.encode() + key, digest_size=DIGEST).digest()


class Merkle:
    """Root of a binary hash tree over leaves added one by one; an odd one goes up unchanged. Holds one node a level."""

    def __init__(self):
        self.n = 0
        self.nodes: list[bytes] = []

    @staticmethod
    def _join(a: bytes, b: bytes) -> bytes:
        return blake2b(a + b, digest_size=DIGEST).digest()

    def add(self, node: bytes) -> None:
        n = self.n
        while n & 1:  # a whole subtree of this size waits on the left
            node = self._join(self.nodes.pop(), node)
            n >>= 1
        self.nodes.append(node)
        self.n += 1

    def root(self) -> bytes:
        out = self.nodes[-1] if self.nodes else b""
        for node in self.nodes[-2::-1]:
            out = self._join(node, out)
        return out


def _leaf_of(kind: str, digest: bytes | None, payload: bytes, doc_id: int | None, n_tokens: int) -> bytes:
    return leaf(kind, digest if kind == "chunk" else f"{doc_id}/{n_tokens}/".encode() + payload)


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_rows: int = 20_000, text: str = "text", key: str = "doc_id") -> None:
    """Encode docs and write the store under path.

    One pass encodes, cuts and hashes; one shuffle brings equal chunks together in shards by digest,
    and recipes together in shards by ascending doc_id; each shard is written once, chunks once each,
    with a row that holds the Merkle root of its rows. kind=chunk: digest, payload (ids in little-endian
    16 or 32 bits). kind=recipe: doc_id, n_tokens, payload (digests in order), sorted by doc_id. kind=root:
    digest, payload (the kind that it covers).

    Null texts are empty: the end id alone. Repeated rows have recipes of their own; null keys sort
    first. Other columns are not read.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    bounds = range_bounds(rows.select("doc_id"), "doc_id", shard_rows)
    n_recipes = len(bounds) + 1
    n_chunks = n_recipes * 2

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(vocabulary)
        seen: set[bytes] = set()
        for b in slices(batches, "t", 1 << 20):
            ids, off = enc.flat(b.column(1), end_id)
            ends = cuts(ids, off)
            step = enc.width.itemsize
            raw = memoryview(ids.view(np.uint8))
            digests = [blake2b(raw[i:e], digest_size=DIGEST).digest() for i, e in zip([0, *(ends[:-1] * step).tolist()], (ends * step).tolist(), strict=False)]
            new = []
            for i, d in enumerate(digests):
                if d not in seen:
                    seen.add(d)
                    new.append(i)
            first = pa.array(new, pa.int64())
            body = np.frombuffer(b"".join(digests), np.uint8)
            place = np.arange(1, len(ends) + 1) * DIGEST
            lead = body.reshape(-1, DIGEST)[:, :4].copy().view("<u4").ravel()[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["chunk"] * len(new)), pa.array((lead % n_chunks).astype(np.int32)), _binary(body, place).take(first), _binary(ids.view(np.uint8), ends * step).take(first), pa.nulls(len(new), pa.int64()), pa.array(np.diff(ends, prepend=0)[new])],
                schema=ROW,
            )
            shard = n_chunks + np.searchsorted(bounds, b.column(0).fill_null(NULL_KEY).to_numpy()).astype(np.int32)
            recipes = _binary(body, np.searchsorted(ends, off[1:], side="right") * DIGEST)
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * b.num_rows), pa.array(shard.astype(np.int32)), pa.nulls(b.num_rows, pa.binary()), recipes, b.column(0), pa.array(np.diff(off))], schema=ROW)
            if len(seen) > 200_000:
                seen.clear()  # equal chunks meet again in their shard

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaves, last = None, Merkle(), None

        def root(shard):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((["root"], [shard], [leaves.root()], [kind_of(shard).encode()], [None], [leaves.n]), ROW, strict=True)], schema=ROW)

        kind_of = lambda shard: "chunk" if shard < n_chunks else "recipe"
        for b in batches:
            start, keep = 0, []
            for i, (kind, shard, digest, payload, doc, n) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if shard != at:
                    if at is not None:
                        yield b.slice(start, i - start).filter(pa.array(keep, pa.bool_()))
                        yield root(at)
                    at, leaves, last, start, keep = shard, Merkle(), None, i, []
                keep.append(kind == "recipe" or digest != last)
                if keep[-1]:
                    leaves.add(_leaf_of(kind, digest, payload, doc, n))
                last = digest
            yield b.slice(start).filter(pa.array(keep, pa.bool_()))
        if at is not None:
            yield root(at)

    coded = rows.mapInArrow(encode, _COLUMNS)
    dealt = coded.repartitionById(n_chunks + n_recipes, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "digest", "payload")
    dealt.mapInArrow(finish, _COLUMNS).write.option("compression", "zstd").partitionBy("kind").parquet(path)


SCHEMA = "shard int, digest binary, payload binary, doc_id long, n_tokens long, kind string"


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc) of every stored chunk, from its bytes; bytes that don't give their digest are an error."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = []
            for d, p, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if blake2b(p, digest_size=DIGEST).digest() != d:
                    raise ValueError("a chunk's bytes don't match its digest")
                crc.append(zlib.crc32(np.frombuffer(p, f"<u{len(p) // n}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    chunks = spark.read.schema(SCHEMA).parquet(path).filter("kind = 'chunk'").select("digest", "payload", "n_tokens")
    return chunks.mapInArrow(sums, "digest binary, n long, crc long")


def check_roots(spark: SparkSession, path: str) -> None:
    """Recompute every shard's Merkle root from its rows in the files, in order, one by one; raise if one differs."""
    table = spark.read.schema(SCHEMA).parquet(path)
    slim = table.select("shard", (F.col("kind") == "root").alias("last"), "kind", "digest", F.when(F.col("kind") != "chunk", F.col("payload")).alias("payload"), "doc_id", "n_tokens")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, want, bad = None, Merkle(), [], []
        for b in batches:
            for shard, _, kind, digest, payload, doc, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != at:
                    bad += [at] * (at is not None and want != [tree.root()])
                    at, tree, want = shard, Merkle(), []
                if kind == "root":
                    want.append(digest)
                else:
                    tree.add(_leaf_of(kind, digest, payload or b"", doc, n))
        bad += [at] * (at is not None and want != [tree.root()])
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int32())], ["shard"])

    # The order of the rows in a shard is that in which they were written, its root last.
    order = ["shard", "last", F.col("doc_id").asc_nulls_first(), "digest", "payload"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    bad = slim.repartition(parts, "shard").sortWithinPartitions(*order).mapInArrow(roots, "shard int").limit(5).collect()
    if bad:
        raise ValueError(f"shards {[r.shard for r in bad]} don't match their manifests")


def _zero_tables() -> np.ndarray:
    """What 1, 2, 4 ... zero bytes do to a crc-32 register: [k, byte of the register, its value] for 2**k of them."""
    bits = np.array([0xEDB88320] + [1 << n for n in range(31)], np.uint32)  # one zero bit, by bit of the register

    def times(op, v):
        out = np.zeros_like(v)
        for bit in range(32):
            out ^= np.where((v >> np.uint32(bit)) & np.uint32(1), op[bit], np.uint32(0))
        return out

    for _ in range(3):
        bits = times(bits, bits)
    tables = []
    for _ in range(42):
        tables.append([times(bits, np.arange(256, dtype=np.uint32) << np.uint32(8 * j)) for j in range(4)])
        bits = times(bits, bits)
    return np.array(tables)


def combine(doc: np.ndarray, crc: np.ndarray, size: np.ndarray, n_docs: int, tables: np.ndarray) -> np.ndarray:
    """crc32 of each document from those of its parts, in order, and their sizes in bytes: a part's crc is carried over all bytes after it."""
    total = np.bincount(doc, size, n_docs).astype(np.int64)
    done = np.cumsum(size)
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(total)))[doc]
    after = total[doc] - (done - first)
    x = crc.astype(np.uint32)
    for k in range(len(tables)):
        at = np.flatnonzero((after >> k) & 1)
        if len(at):
            y = x[at]
            x[at] = tables[k, 0][y & 255] ^ tables[k, 1][(y >> 8) & 255] ^ tables[k, 2][(y >> 16) & 255] ^ tables[k, 3][y >> 24]
        if not (after >> k).any():
            break
    out = np.zeros(n_docs, np.uint32)
    np.bitwise_xor.at(out, doc, x)
    return out.astype(np.int64)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every recipe, from the files.

    Each chunk's bytes are read, checked against its digest and summed once; documents get their sums
    by combining those of their chunks, so only digests, lengths and sums are shuffled.
    """
    recipes = spark.read.schema(SCHEMA).parquet(path).filter("kind = 'recipe'").select("doc_id", "n_tokens", "payload", "shard")
    recipes = recipes.withColumn("row", F.monotonically_increasing_id())
    chunks = chunk_sums(spark, path)
    parts = F.expr(f"transform(sequence(0, cast(length(payload) / {DIGEST} as int) - 1), i -> substring(payload, i * {DIGEST} + 1, {DIGEST}))")
    parts = recipes.select("shard", "row", "doc_id", "n_tokens", F.posexplode(parts).alias("seq", "part"))
    met = parts.join(chunks, parts["part"] == chunks["digest"], "left")
    tables = _zero_tables()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, chunks = b.column(3).to_numpy(), b.column(4)
            doc = np.repeat(np.arange(b.num_rows), chunks.value_lengths().to_numpy())
            seq, n, crc = (chunks.flatten().field(c) for c in ("seq", "n", "crc"))
            if n.null_count:
                raise ValueError("a recipe doesn't match its chunks")
            order = np.lexsort((seq.to_numpy(), doc))
            n = n.to_numpy()[order]
            if (np.bincount(doc, n, b.num_rows) != want).any():
                raise ValueError("a recipe doesn't match its chunks")
            out = combine(doc, crc.to_numpy()[order], 4 * n, b.num_rows, tables)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], ["shard", "row", "doc_id", "n_tokens", "ids_crc32"])

    whole = met.groupBy("shard", "row", "doc_id", "n_tokens").agg(F.collect_list(F.struct("seq", "n", "crc")).alias("chunks"))
    docs = whole.mapInArrow(sums, "shard int, row long, doc_id long, n_tokens long, ids_crc32 long")
    # Ids of all documents before: sums of whole shards, in order, then within each shard.
    sums_ = recipes.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    base = sums_.select(F.col("shard").alias("s"), F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.join(base, docs["shard"] == base["s"])
    return docs.select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids): the id sequence of every recipe, assembled from the chunks in the files."""
    table = spark.read.schema(SCHEMA).parquet(path)
    chunks = table.filter("kind = 'chunk'").select("digest", F.col("payload").alias("bytes"), F.col("n_tokens").alias("n"))
    parts = F.expr(f"transform(sequence(0, cast(length(payload) / {DIGEST} as int) - 1), i -> substring(payload, i * {DIGEST} + 1, {DIGEST}))")
    recipes = table.filter("kind = 'recipe'").withColumn("row", F.monotonically_increasing_id())
    parts = recipes.select("row", "doc_id", F.posexplode(parts).alias("seq", "part"))
    whole = parts.join(chunks, parts["part"] == chunks["digest"], "left").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "bytes", "n"))).alias("chunks"))

    def join(batches):
        for b in batches:
            out = [np.concatenate([np.frombuffer(c["bytes"], f"<u{len(c['bytes']) // c['n']}").astype(np.int64) for c in chunk]) for chunk in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return whole.select("doc_id", "chunks").mapInArrow(join, "doc_id long, ids array<long>")
