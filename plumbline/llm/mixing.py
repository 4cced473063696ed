"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's documents form blocks of about equal size. A share w gives a source's block j the release floor(j / w) and the deadline
ceil((j + 1) / w), in slots of one block each, from the exact rational share; earliest deadline first among the released blocks
then serves every source within one block of its share at every slot. The driver places blocks, not documents: one row for each
block, which a join on (source, block) gives to the documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import materialize, table

#: Slots of a pattern that repeats; a source gets at least one of them. mix() has no period.
PERIOD = 1024
#: Characters of a block, and the number of blocks that the driver schedules at most: blocks of a corpus of over 50 GB are larger.
BLOCK, SCHEDULED = 1 << 18, 200_000
#: Documents of a source that one task puts into blocks.
SHARD_ROWS = 4000


def quantised(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of a period for each source by largest remainders, at least one each."""
    if len(weights) > period // 2:
        raise ValueError("the period has too few slots for this many sources")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("a weight is not positive")
    total, free = sum(weights.values()), period - len(weights)
    exact = {s: w / total * free for s, w in weights.items()}
    slots = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(slots.values())]:
        slots[s] += 1
    return slots


def schedule(weights: Mapping[str, float], blocks: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The first blocks[s] blocks of each source by earliest deadline first among released blocks: (source, block, release, deadline, slot).

    Ties go to the later release, then the source. Each block's slot is at its release or after, and before its deadline: that
    holds for all blocks without end, so it holds for these. A source's next block waits for its last one, whose deadline is earlier.
    """
    if any(not w > 0 for w in weights.values()):
        raise ValueError("a weight is not positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(w.denominator for w in exact.values()))
    units = {s: int(w * scale) for s, w in exact.items()}
    total = sum(units.values())
    waiting = [(0, s, 0) for s in units if blocks.get(s, 0)]
    heapq.heapify(waiting)
    ready, out, slot = [], [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // units[s]), -release, s, j))
        deadline, release, s, j = heapq.heappop(ready)
        out.append((s, j, -release, deadline, slot))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * total // units[s], s, j + 1))
        slot += 1
    return out


def pattern(slots: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period of the schedule that has slots[s] blocks of each source."""
    return schedule(slots, slots)


def source_sizes(docs: DataFrame) -> dict[str, int]:
    """Each source's characters, plus one for each row: one row per source reaches the driver. A null source is the empty one."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("n")).collect()
    return {r["s"]: r["n"] for r in sizes}


def supply_weights(sizes: Mapping[str, int], flatten: float = 0.7) -> dict[str, float]:
    """Target weights from each source's characters to the power flatten."""
    return {s: float(n) ** flatten for s, n in sizes.items()}


def block_size(sizes: Mapping[str, int]) -> int:
    return max(BLOCK, -(-sum(sizes.values()) // SCHEDULED))


def mix(docs: DataFrame, weights: Mapping[str, float], block: int = BLOCK) -> DataFrame:
    """Adds block, release, deadline and slot to docs(doc_id, source, text): the place of each row's block in the mixed order.

    Every row is placed once. While all sources last, the first slots of any number hold each source's share by weight to less
    than one block; after a source has run out slots may stay empty, and the others keep their places within their shares. Blocks
    are runs of a source's rows in doc_id order within shards, cut where a running sum of characters plus one per row passes a multiple of
    block. A null source is the empty one; a source without a weight raises an error on the driver. Null texts count one
    character. Repeated rows are placed one by one; an empty table gives none. Other columns stay, save the four names.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c not in ("block", "release", "deadline", "slot")]
    key = {"source": F.coalesce(F.col("source"), F.lit("")), "doc": F.col("doc_id"), "hash": F.xxhash64("text")}
    size = F.coalesce(F.length("text"), F.lit(0)) + 1
    light = docs.select(*(c.alias(n) for n, c in key.items()), size.alias("size"))
    counts = light.groupBy("source").agg(F.count("*").alias("n"))
    unknown = [r[0] for r in counts.select("source").collect() if r[0] not in weights][:5]
    if unknown:
        raise ValueError(f"sources without a weight: {unknown}")
    shards = counts.select("source", F.ceil(F.col("n") / SHARD_ROWS).alias("shards"))
    sharded = light.join(F.broadcast(shards), "source").withColumn("shard", F.pmod(F.xxhash64("doc"), "shards"))  # one row per source
    upto = F.expr("sum(size) OVER (PARTITION BY source, shard ORDER BY doc, hash, size ROWS UNBOUNDED PRECEDING)")
    local = sharded.withColumn("local", F.floor((upto - F.col("size")) / block)).groupBy("source", "shard", "doc", "hash").agg(F.min("local").alias("local"))
    local = materialize(local, "mix-blocks")
    held = local.groupBy("source", "shard").agg((F.max("local") + 1).alias("blocks"))
    bases = held.selectExpr("source", "shard", "sum(blocks) OVER (PARTITION BY source ORDER BY shard) - blocks AS base")  # one row per shard
    placed = local.join(bases, ["source", "shard"]).withColumn("block", F.col("base") + F.col("local")).select("source", "doc", "hash", "block")
    blocks = {r[0]: r[1] for r in held.groupBy("source").agg(F.sum("blocks")).collect()}
    slots = pd.DataFrame(schedule(weights, blocks), columns=["source", "block", "release", "deadline", "slot"])
    slots = spark.createDataFrame(slots, "source string, block long, release long, deadline long, slot long")
    at = placed.join(slots, ["source", "block"])
    keyed = docs.select(F.struct(*names).alias("row"), *(c.alias(n) for n, c in key.items()))
    same = (keyed["source"] == at["source"]) & keyed["doc"].eqNullSafe(at["doc"]) & keyed["hash"].eqNullSafe(at["hash"])
    return keyed.join(at, same).select("row.*", "block", "release", "deadline", "slot")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs in mixed order: partitions are ranges of slots, sorted, so that files and the packing of each file hold the mixture."""
    columns = docs.columns
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = source_sizes(docs)
    out = mix(docs, supply_weights(sizes), block_size(sizes))
    return out.repartitionByRange(shards, "slot", "doc_id").sortWithinPartitions("slot", "doc_id").select(*columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = source_sizes(docs)
    return mix(docs, supply_weights(sizes), block_size(sizes)).select("doc_id", "source", "block", "release", "deadline", "slot")
