"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key goes to the first shard clockwise from its place on the ring that is not full. Keys come one group of equal texts after
another, in the order of a hash; a shard is full as soon as its load reaches its capacity, and keys that come later go on clockwise.
As a shard fills only once, the whole course is a few events, each the key with which a shard becomes full: between two of them a
key's shard follows from its arc of the ring alone. The events are found from counts of keys by arc and range of the order, narrowed
down range by range; no key is dealt on the driver but those of a range of at most LEAF_ROWS rows around an event.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import CRC_SQL, crc32_sql, drop_tables, materialize, table

#: Virtual nodes of a shard; bits of a place on the ring and of a place in the order of keys.
NODES, BITS = 64, 48
#: Ranges that one step narrows an event down to, and the rows of a range that are then dealt one by one.
RANGES, LEAF_ROWS = 64, 10_000
#: Rows of a partition of the ordered keys, about.
PART_ROWS = 1 << 20
ORDER = ("prio", "tie", "row")
LOWEST = -(1 << 63)


def _place(of: str) -> int:
    return int(hashlib.md5(of.encode()).hexdigest()[:12], 16)


class Ring:
    """Places of the virtual nodes, and for the arc before each the shards in the order in which they follow clockwise."""

    def __init__(self, shards: int, nodes: int = NODES):
        found = sorted((_place(f"{s}:{v}"), s) for s in range(shards) for v in range(nodes))
        self.shards, self.points = shards, np.array([p for p, _ in found], np.int64)
        clockwise = [s for _, s in found]
        self.follow = [list(dict.fromkeys(clockwise[k:] + clockwise[:k])) for k in range(len(found))]

    def arcs(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, places, side="left") % len(self.points)

    def targets(self, full: set[int]) -> np.ndarray:
        """The shard of each arc's keys while some are full; -1 if all are."""
        return np.array([next((s for s in order if s not in full), -1) for order in self.follow])


def keys(docs: DataFrame, ring: Ring) -> DataFrame:
    """The stored keys of docs(doc_id, text), in their order: (doc_id, size, text_crc32, arc, prio, tie, row, at). at ascends with the order and has the partition in its upper bits."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(text)
    part_of = lambda first: F.conv(F.substring(digest, first, BITS // 4), 16, 10).cast("long")
    arc = F.pandas_udf(lambda places: pd.Series(ring.arcs(places.to_numpy()).astype(np.int32)), "int")
    made = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        part_of(1).alias("place"),
        part_of(1 + BITS // 4).alias("prio"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Stored before it is put in order, so that the texts are read once and a row keeps its number.
    made = materialize(made.select("*", arc("place").alias("arc")).drop("place"), "keys")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made.count() // PART_ROWS))
    ordered = made.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    out = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    drop_tables(made)
    return out


class _Course:
    """The loads of all shards as keys come, and the key with which each becomes full."""

    def __init__(self, ring: Ring, capacity: list[int], load: str):
        self.ring, self.capacity, self.load = ring, capacity, load
        self.held, self.events = [0] * ring.shards, []
        self.full = {s for s, c in enumerate(capacity) if c <= 0}
        self.to = ring.targets(self.full)
        self.targets = [self.to]

    def one(self, arc: int, weight: int, key: tuple[int, ...]) -> None:
        s = int(self.to[arc])
        self.held[s] += weight
        if self.held[s] >= self.capacity[s]:
            self.full.add(s)
            self.events.append(key)
            self.to = self.ring.targets(self.full)
            self.targets.append(self.to)

    def through(self, rows: DataFrame, columns: tuple[str, ...], low: int, high: int) -> None:
        """Takes the rows whose first column is in [low, high), by ranges; one in which a shard becomes full is taken apart."""
        c, width = columns[0], max(1, -(-(high - low) // RANGES))
        inside = rows.where((F.col(c) >= low) & (F.col(c) < high) if high < 1 << 63 else F.col(c) >= low)
        span = F.floor((F.col(c).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        for r in inside.groupBy(span.alias("span"), "arc").agg(F.count("*").alias("n"), F.sum(self.load).alias("weight")).collect():  # RANGES times arcs
            counts.setdefault(r["span"], {})[r["arc"]] = (r["n"], r["weight"])
        for k in sorted(counts):
            more = np.zeros(self.ring.shards, object)
            for arc, (_, weight) in counts[k].items():
                more[self.to[arc]] += weight
            if all(m == 0 or h + m < cap for h, m, cap in zip(self.held, more, self.capacity, strict=True)):
                self.held = [h + int(m) for h, m in zip(self.held, more, strict=True)]
                continue
            lo, hi = low + k * width, min(high, low + (k + 1) * width)
            if sum(n for n, _ in counts[k].values()) <= LEAF_ROWS:
                some = inside.where((F.col(c) >= lo) & (F.col(c) < hi) if hi < 1 << 63 else F.col(c) >= lo)
                for r in some.select("arc", F.col(self.load).alias("weight"), *ORDER).orderBy(*ORDER).collect():  # LEAF_ROWS rows
                    self.one(r["arc"], r["weight"], tuple(r[x] for x in ORDER))
            elif width > 1:
                self.through(inside, columns, lo, hi)
            else:
                below = inside.where(F.col(c) == lo)
                first, last = below.agg(F.min(columns[1]), F.max(columns[1])).first()
                self.through(below, columns[1:], first, last + 1)


def sharded(docs: DataFrame, shards: int = 8, law: str = "rows", slack: float = 0.0, nodes: int = NODES) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard, home) of all docs(doc_id, text).

    law says what is balanced: with `rows` a shard's capacity is its part of the number of rows, so that counts differ by one at most;
    with `bytes` it is its part of all sizes, and no shard holds more than that and one document. slack widens capacities by that share
    of them: less balance, fewer keys away from home. size is a text's UTF-8 bytes and one; null texts are empty. home is the shard that
    the ring alone gives, slot the row's place in its shard, in the order of keys. Equal texts have one place on the ring and come together,
    so that no more groups than there are shards are split. Rows equal in doc_id and text are interchangeable; a null doc_id comes before
    others. An empty table gives no rows. Other columns are ignored. grown_shard is null: what stays in place when a shard is added is not fixed
    by a law, as loads decide.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    spark, ring = docs.sparkSession, Ring(shards, nodes)
    ordered_keys = keys(docs, ring)
    ordered = ordered_keys.withColumn("one", F.lit(1).cast("long"))
    weight = {"rows": "one", "bytes": "size"}[law]
    n, total = ordered.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    whole = int(total * (1 + slack)) if slack else total
    course = _Course(ring, [whole // shards + (s < whole % shards) for s in range(shards)], weight)
    if n:
        course.through(ordered, ORDER, 0, 1 << BITS)
    # What a key's arc and the events before it say: arcs times shards rows, whatever the data.
    epochs = [(arc, epoch, int(s), ring.follow[arc][0]) for epoch, to in enumerate(course.targets) for arc, s in enumerate(to)]
    epochs = spark.createDataFrame(epochs, "arc int, epoch int, shard int, home int")
    key = F.struct(*ORDER)
    passed = sum(((key > F.struct(*(F.lit(x).cast("long") for x in event))).cast("int") for event in course.events), F.lit(0))
    placed = ordered.withColumn("epoch", passed).join(F.broadcast(epochs), ["arc", "epoch"]).withColumn("part", F.shiftright("at", 33))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "home", "part", "at"), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard and partition
    bases = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at")) - 1
    out = placed.withColumn("rank", rank).join(bases, ["shard", "part"])
    out = out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home")
    out = materialize(out, "sharded")
    drop_tables(ordered_keys, placed)
    return out


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


#: Keys dealt one by one, each to the nearest virtual node clockwise of a shard that is not full.
SQL = f"""WITH RECURSIVE {CRC_SQL},
k AS (SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(coalesce(text, '')), 1, 12))::BIGINT AS place, row_number() OVER (ORDER BY substr(md5(coalesce(text, '')), 13, 12), doc_id NULLS FIRST) AS rn FROM documents),
nodes AS (SELECT s, ('0x' || substr(md5(s || ':' || v), 1, 12))::BIGINT AS p FROM range(8) a(s), range({NODES}) b(v)),
ways AS (SELECT rn, list(s ORDER BY away, s) AS way FROM (SELECT rn, s, min((p - place + {1 << BITS}) % {1 << BITS}) AS away FROM k, nodes GROUP BY rn, s) GROUP BY rn),
room AS (SELECT list_transform(range(8), lambda s: n // 8 + (s < n % 8)::BIGINT) AS room FROM (SELECT count(*) AS n FROM documents)),
dealt AS (SELECT 0::BIGINT AS rn, list_transform(range(8), lambda s: 0::BIGINT) AS held, NULL::BIGINT AS shard
  UNION ALL SELECT rn, list_transform(held, lambda h, i: h + (i = shard + 1)::BIGINT), shard FROM (SELECT w.rn, e.held, list_filter(w.way, lambda s: e.held[s + 1] < room[s + 1])[1] AS shard FROM dealt e JOIN ways w ON w.rn = e.rn + 1, room))
SELECT doc_id, strlen(t) + 1 AS size, {crc32_sql("t")} AS text_crc32, 'rows' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY rn) - 1 AS slot, NULL::INT AS grown_shard, way[1]::INT AS home
FROM k JOIN dealt USING (rn) JOIN ways USING (rn), crc"""
