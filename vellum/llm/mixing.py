"""Mixing sources to target weights by Pfair scheduling of their blocks."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import settle

#: Slots of the schedule after which it repeats: weights are rounded to this many parts. A small weight makes the period longer, up to the second number.
PERIOD, MOST_PERIOD = 10_000, 1_000_000
#: The same for the sources that share a group.
INNER, MOST_INNER = 1_000, 10_000


def shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of each source in a period, by largest remainder; each source has one at least."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    gap = period - sum(out.values())
    for i in range(max(gap, 0)):
        out[order[i % len(order)]] += 1
    largest = [(-n, s) for s, n in out.items()]
    heapq.heapify(largest)
    for _ in range(max(-gap, 0)):
        n, s = heapq.heappop(largest)
        out[s] -= 1
        heapq.heappush(largest, (n + 1, s))
    return out


def schedule(share: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block of one period, one block a slot.

    Block j (from 0) of a source with k of n slots is released at floor(j n / k) and due by
    ceil((j + 1) n / k). Of the released blocks the one due first runs; ties go to the one whose
    window overlaps its next one, then to the source's name. Each block runs within its window, so
    at every time each source has had its weight's number of slots to within less than one.
    """
    n = sum(share.values())
    window = lambda s, j: (j * n // share[s], -(-(j + 1) * n // share[s]))
    waiting = [(window(s, 0)[0], s, 0) for s in sorted(share) if share[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            due = window(s, j)[1]
            heapq.heappush(ready, (due, 0 if (j + 1) * n % share[s] else 1, s, j))
        due, _, s, j = heapq.heappop(ready)
        out.append((s, j, window(s, j)[0], due, slot))
        if j + 1 < share[s]:
            heapq.heappush(waiting, (max(window(s, j + 1)[0], slot + 1), s, j + 1))
    return out


def period_for(target: dict[str, float], least: int = PERIOD, most: int = MOST_PERIOD) -> int:
    """A period in which the smallest weight has a slot, and every source ten on average; `most` at most, but ten for each source."""
    smallest = math.ceil(sum(target.values()) / min(target.values()))
    return max(least, 10 * len(target), min(smallest, most))


def _in_group(group: pd.DataFrame) -> pd.DataFrame:
    """The sources of a group with the slots that each has in a period of the group's own schedule."""
    target = dict(sorted(zip(group["s_key"], group["weight"])))
    share = shares(target, period_for(target, INNER, MOST_INNER)) if len(target) > 1 else dict.fromkeys(target, 1)
    common = math.gcd(*share.values())
    share = {s: k // common for s, k in share.items()}
    slots: dict[str, list[int]] = {s: [] for s in share}
    for s, _, _, _, slot in schedule(share):
        slots[s].append(slot)
    keys = group["s_key"]
    return group[["s_key", "unit", "n_blocks"]].assign(s_share=keys.map(share), s_period=sum(share.values()), s_slots=keys.map(slots))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_bytes: int = 65_536,
    power: float = 0.7,
    bucket_rows: int = 20_000,
    most_sources: int = 100_000,
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    whole: bool = False,
) -> DataFrame:
    """(doc_id, source, pass_no, block_no, slot, release, deadline, place): the mixed order of the documents.

    Each source's documents, in a fixed pseudo-random order, are cut into blocks of block_bytes of
    UTF-8 text (a document belongs to the block in which it starts). Blocks get slots of a Pfair
    schedule by the target weights; `weights` (source -> weight) or else the sources' sizes to the power `power`, which gives
    small sources more than their part. The mixture
    goes on until every source has been read whole once; a source that runs out first starts over
    (pass_no counts from 0), so that the mixture keeps its weights to the end and no document is lost.
    (slot, place) orders the rows.

    Sources are scheduled on two levels, whatever their number: each belongs to one of most_sources groups by a hash of its name;
    the groups, with their sources' summed weights, share the slots, and by the same rule a group's sources share the group's slots, in
    tasks. A source alone in its group, as nearly all are up to some hundreds, is scheduled as if there were no groups; others are within
    two blocks of their weight instead of one. A group's weight below a millionth (MOST_PERIOD) of all counts as that, a source's
    below a ten-thousandth (MOST_INNER) of its group's as that.

    A null source is a source of its own, shown as null; it can be given a weight under the key None.
    Null and empty texts have 0 bytes and stay with their neighbours. Repeated rows and null keys are
    placed like other rows. Sources missing in weights, or with a weight of 0 or less, get the
    smallest given weight (all the same, if none is positive). An empty table gives no rows. Other columns are read only if whole is
    set: then the result is the columns of docs alone, in files by slot and sorted by (slot, place).
    The driver and the broadcast table hold most_sources groups at most, and one period of their schedule
    (ten slots for each of these, PERIOD at least); nothing else goes there.
    """
    spark = docs.sparkSession
    keep = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole else []
    rows = docs.select(docs[key].alias("doc_id"), docs[source].alias("source"), F.coalesce(F.octet_length(docs[text].cast("string")), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(11), docs[key], docs[text].cast("string")).alias("hash"), *keep)
    # What the schedule knows: sources, or if there are too many, those of the largest weights and pools of the others.
    sizes = rows.groupBy("source").agg(F.sum("size").alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.greatest("bytes", F.lit(1)).cast("double"), F.lit(power)))
    else:
        least = min((w for w in weights.values() if w > 0), default=1.0)
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "w_source string, w double")
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "bytes", F.coalesce("w", F.lit(float(least))).alias("weight"))
    sizes = settle(sizes, "sizes")
    own = F.when(F.col("source").isNotNull(), F.concat(F.lit("s"), "source")).otherwise("")
    named = sizes.select(own.alias("s_key"), F.pmod(F.xxhash64("source"), F.lit(most_sources)).alias("unit"), "weight", F.greatest(F.ceil(F.col("bytes") / block_bytes), F.lit(1)).alias("n_blocks"))
    target = {r.unit: r.weight for r in named.groupBy("unit").agg(F.sum("weight").alias("weight")).collect()}
    if not target and whole:
        return docs
    if not target:
        return rows.select("doc_id", "source", *(F.lit(None).cast("long").alias(c) for c in ("pass_no", "block_no", "slot", "release", "deadline", "place"))).limit(0)
    share = shares(target, period_for(target))
    common = math.gcd(*share.values())
    share = {s: k // common for s, k in share.items()}
    n_slots = sum(share.values())
    table = spark.createDataFrame([(s, j, slot) for s, j, _, _, slot in schedule(share)], "p_unit long, p_block long, p_slot long")
    units = spark.createDataFrame(list(share.items()), "u_unit long, share long")
    sources = named.groupBy("unit").applyInPandas(_in_group, "s_key string, unit long, n_blocks long, s_share long, s_period long, s_slots array<long>")
    sources = settle(sources.join(F.broadcast(units), F.col("unit") == F.col("u_unit")).drop("u_unit"), "sources")

    # A run of a source is a place in its group's slots, and that a slot of all.
    place_of = lambda run: F.floor(run / F.col("s_share")) * F.col("s_period") + F.element_at("s_slots", (run % F.col("s_share") + 1).cast("int"))

    def slotted(df: DataFrame) -> DataFrame:
        met = df.withColumn("turn", place_of(F.col("run"))).withColumn("in_period", F.col("turn") % F.col("share"))
        met = met.join(F.broadcast(table), (F.col("unit") == F.col("p_unit")) & (F.col("in_period") == F.col("p_block")))
        return met.withColumn("slot", F.floor(F.col("turn") / F.col("share")) * n_slots + F.col("p_slot"))

    # Slots until each source has run all its blocks once.
    end = slotted(sources.withColumn("run", F.col("n_blocks") - 1)).agg(F.max("slot")).first()[0] + 1
    # Of the slots before the end a group has its part to within one, and a source its part of these.
    turns = F.floor(F.lit(end) * F.col("share") / n_slots) + 1
    sources = sources.withColumn("passes", F.ceil((F.floor(turns * F.col("s_share") / F.col("s_period")) + 1) / F.col("n_blocks")))

    # A source's documents stand in the order of their hashes, dealt into buckets by ranges of these, so that a hot source is many groups of bounded size and the order doesn't depend on their number.
    n_buckets = max(1, -(-docs.count() // bucket_rows))
    rows = rows.withColumn("key", own).withColumn("high", F.shiftrightunsigned("hash", 33)).withColumn("bucket", F.floor(F.col("high") * n_buckets / (1 << 31)))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("bytes"))
    before = sums.withColumn("before", F.sum("bytes").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("key").alias("b_key"), F.col("bucket").alias("b_bucket"), F.coalesce("before", F.lit(0)).alias("before")).join(sources.hint("merge"), F.col("b_key") == F.col("s_key"))
    order = Window.partitionBy("key", "bucket").orderBy("high", "hash", "doc_id", "size")
    same = Window.partitionBy("key", "bucket", "high").orderBy("hash", "doc_id", "size")
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("number", F.row_number().over(same))
    # The table of sums is small beside the rows: sources times buckets at most.
    placed = placed.join(before, (placed["key"] == before["b_key"]) & (placed["bucket"] == before["b_bucket"]))
    block = F.least(F.floor((F.col("before") + F.col("inner")) / block_bytes), F.col("n_blocks") - 1)
    placed = placed.withColumn("block_no", block).withColumn("pass_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)))
    out = slotted(placed.withColumn("run", F.col("pass_no") * F.col("n_blocks") + F.col("block_no"))).filter(F.col("slot") < end)
    if whole:
        n_files = max(1, -(-end * block_bytes // (64 << 20)))
        files = F.least(F.floor(F.col("slot") * n_files / end), F.lit(n_files - 1)).cast("int")
        place = F.struct("high", "number").alias("place")
        return out.select("row", "slot", place, files.alias("file")).repartitionById(n_files, F.col("file")).sortWithinPartitions("slot", "place").select("row.*")
    # The window of a run in its group's slots, and that of these in all.
    first = F.floor(F.col("run") * F.col("s_period") / F.col("s_share"))
    last = F.ceil((F.col("run") + 1) * F.col("s_period") / F.col("s_share"))
    release, deadline = F.floor(first * n_slots / F.col("share")), F.ceil(last * n_slots / F.col("share"))
    return out.select("doc_id", "source", "pass_no", "block_no", "slot", release.alias("release"), deadline.alias("deadline"), (F.col("high") * (1 << 32) + F.col("number")).cast("long").alias("place"))
