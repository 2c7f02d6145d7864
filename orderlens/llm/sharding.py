"""Sharding by minimax contiguous partition: groups of equal texts are atomic, ordered by
their hash, and cut into contiguous shards whose largest size is the smallest possible.

The capacity is found by binary search with a greedy check. The driver never holds the
groups: it starts from the totals of 4,096 hash ranges and asks Spark for exact group
boundaries only inside the few ranges where a greedy cut can fall (:func:`plan_cuts`).
Groups larger than an even share get a shard of their own first (at most n - 1 of them).
A row's shard follows from its own hash, so rows are never joined to groups.

Defined cases: a null text is empty (size 1); repeated rows are separate rows of one
group; an empty table gives an empty result; other columns are not needed or returned.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderlens.llm.shared import store, text_or_empty

SHARDS = 16
#: hash ranges of the first look (a fixed number, so the driver's part does not grow with the data)
BLOCKS = 4096
#: parts into which a range is cut when its inside is needed
PARTS = 64
#: buckets by doc_id within a shard for numbering its rows
SLOT_BUCKETS = 512


def _greedy(bounds: list[int], sure: list[bool], total: int, shards: int, capacity: int, hopeful: bool) -> tuple[bool, list[int]]:
    """Fill shards greedily up to ``capacity``; returns whether ``shards`` suffice, and the cuts.

    ``bounds`` are known group boundaries, ``sure[i]`` whether none is unknown between
    bounds[i] and bounds[i + 1]. A hopeful fill cuts unknown stretches anywhere.
    """
    at, cuts = 0, []
    for _ in range(shards):
        if at >= total:
            break
        reach = at + capacity
        if reach >= total:
            at = total
            cuts.append(at)
            break
        i = bisect_right(bounds, reach) - 1
        nxt = reach if hopeful and not sure[i] else bounds[i]
        if nxt <= at:
            return False, cuts
        at = nxt
        cuts.append(at)
    return at >= total, cuts


def _smallest(bounds, sure, total, shards, lo, hi, hopeful) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        if _greedy(bounds, sure, total, shards, mid, hopeful)[0]:
            hi = mid
        else:
            lo = mid + 1
    return lo


def plan_cuts(bounds: list[int], sure: list[bool], shards: int, inside) -> tuple[int, list[int]]:
    """Smallest capacity and greedy cuts over ordered atomic groups known by ``bounds``.

    ``inside(list of (start, end))`` returns, for stretches that are not sure, a dict from
    each to (boundaries strictly inside, sure flags of the pieces).
    """
    total = bounds[-1]
    while True:
        hi = _smallest(bounds, sure, total, shards, (total + shards - 1) // shards, total, False)
        lo = _smallest(bounds, sure, total, shards, (total + shards - 1) // shards, hi, True)
        if lo == hi:
            return hi, _greedy(bounds, sure, total, shards, hi, False)[1]
        low, high = _greedy(bounds, sure, total, shards, lo, False)[1], _greedy(bounds, sure, total, shards, hi, True)[1]
        wanted, last = set(), 0
        for j in range(shards):
            a, b = (low[j] if j < len(low) else last), (high[j] if j < len(high) else total)
            last = a
            for i in range(max(0, bisect_right(bounds, a) - 1), min(len(sure), bisect_right(bounds, b))):
                if not sure[i]:
                    wanted.add(i)
        if not wanted:  # every stretch that a cut can reach is known
            return hi, _greedy(bounds, sure, total, shards, hi, False)[1]
        found = inside([(bounds[i], bounds[i + 1]) for i in sorted(wanted)])
        new_bounds, new_sure = [bounds[0]], []
        for i in range(len(sure)):
            more, flags = found[(bounds[i], bounds[i + 1])] if i in wanted else ([], [sure[i]])
            new_bounds += [*more, bounds[i + 1]]
            new_sure += flags
        bounds, sure = new_bounds, new_sure


def _blocks(groups: DataFrame) -> DataFrame:
    return groups.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): shards hold nearly equal numbers of bytes,
    equal texts share a shard, and slots number each shard's rows without gaps from 0."""
    spark, t = docs.sparkSession, text_or_empty(text)
    rows = store(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                             F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h")), "rows")
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    groups = store(groups.withColumn("block", (F.shiftright("h", 52) + BLOCKS // 2).cast("int")), "groups")
    # groups over an even share of what is left: the largest n - 1 tell
    left, n_left, alone = groups.agg(F.sum("size")).first()[0] or 0, shards, []
    for h, size in [(r.h, r["size"]) for r in groups.orderBy(F.desc("size"), "h").limit(shards - 1).collect()]:
        if n_left > 1 and size * n_left >= left:
            alone.append(h)
            left, n_left = left - size, n_left - 1
        else:
            break
    rest = groups.where(~F.col("h").isin(alone)) if alone else groups
    totals = sorted((r.block, r["size"], r.n) for r in _blocks(rest).collect())
    start_of, bounds, sure = {}, [0], []
    for block, size, n in totals:
        start_of[block] = bounds[-1]
        bounds.append(bounds[-1] + size)
        sure.append(n == 1)
    at = F.sum("size").over(W.partitionBy("block").orderBy("h"))

    def table(pairs, names: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(pairs, names))  # bounded: 4,096 blocks, or stretches of n greedy cuts

    firsts = sorted(start_of.items(), key=lambda x: x[1])

    def block_of(start: int) -> int:
        return firsts[bisect_right([s for _, s in firsts], start) - 1][0]

    def ends(stretches: list[tuple[int, int]]) -> DataFrame:
        near = table([(block_of(a), start_of[block_of(a)], a, b) for a, b in stretches], "block int, first long, a long, b long")
        held = rest.where(F.col("block").isin(sorted({block_of(a) for a, _ in stretches})))
        return (held.withColumn("end", at).join(near, "block").withColumn("end", F.col("end") + F.col("first"))
                .where("end > a and end <= b"))

    def inside(stretches: list[tuple[int, int]]) -> dict:
        # the first group is a part of its own, so that every look learns something
        held = ends(stretches).withColumn("e", F.min("end").over(W.partitionBy("a", "b")))
        part = F.when(F.col("end") == F.col("e"), 0).otherwise(F.expr(f"(end - e - 1) * {PARTS} div (b - e) + 1"))
        got: dict = {s: [] for s in stretches}
        for r in held.groupBy("a", "b", part.alias("part")).agg(F.max("end").alias("end"), F.count("*").alias("n")).collect():
            got[(r.a, r.b)].append((r.end, r.n))
        return {s: ([e for e, _ in sorted(x)[:-1]], [n == 1 for _, n in sorted(x)]) for s, x in got.items()}

    cuts = plan_cuts(bounds, sure, n_left, inside)[1] if totals else []
    # the hash of the last group before each cut
    last = []
    if len(cuts) > 1:
        stretches = []
        for c in cuts[:-1]:
            i = bisect_right(bounds, c - 1) - 1
            stretches.append((bounds[i], c))
        last = sorted(r.h for r in ends(stretches).where("end = b").select("h", "end").distinct().collect())
    shard = F.lit(0)
    for h in last:
        shard = shard + (F.col("h") > h).cast("int")
    for k, h in enumerate(alone):
        shard = F.when(F.col("h") == h, F.lit(n_left + k)).otherwise(shard)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)).cast("int"))
    # number rows inside (shard, bucket); the buckets' offsets are at most shards * SLOT_BUCKETS rows
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "h")) - 1
    out = (placed.withColumn("inner", inner).join(F.broadcast(sizes.select("shard", "bucket", "before")), ["shard", "bucket"])
           .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inner")).alias("slot")))
    return out
