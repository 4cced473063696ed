"""Interaction of document filters: what each of five filters removes at each place of each order, from one scan of the texts.

The scan works on the Arrow buffers of a batch: byte classes and their prefix sums give the counts of each document, sorted word
hashes, verified byte by byte, its distinct words. A document is then the set of filters it fails, five bits; masks are counted by part,
and those counts, 32 for a part at most, give every number of every order.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import drop_tables, materialize, mix, steps, table, words

FILTERS = "ABCDE"
#: Limits of the filters: words of a document at least; distinct words and capitals, in hundredths.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITAL, SYMBOL, BEGINS = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
CAPITAL[65:91] = True
SYMBOL[[ord(c) for c in "#$%&*|"]] = True
BEGINS[0x80:0xC0] = False
#: Bytes of a word that are hashed eight at a time; a longer word is hashed by itself.
LONG_WORD = 1024
#: Bits of a word's hash that are sorted; the upper ones hold its document's place in the step.
HASH_BITS = 44
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one integer; zeros follow the data."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end], equal for equal bytes."""
    lanes, size = _lanes(data), end - start
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    at, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] ^ (lanes[start[at] + done] & MASKS[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    return mix(out)


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether word a[i] has the bytes of word b[i]."""
    lanes, size = _lanes(data), end - start
    same = size[a] == size[b]
    for k in np.flatnonzero(same & (size[a] > LONG_WORD)).tolist():
        same[k] = bool((data[start[a[k]] : end[a[k]]] == data[start[b[k]] : end[b[k]]]).all())
    at, done = np.flatnonzero(same & (size[a] <= LONG_WORD)), 0
    while len(at):
        left = size[a[at]] - done
        equal = ((lanes[start[a[at]] + done] ^ lanes[start[b[at]] + done]) & MASKS[np.minimum(left, 8)]) == 0
        same[at[~equal]] = False
        at, done = at[equal & (left > 8)], done + 8
    return same


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The number of different words of each of n documents. Words of one document and one hash are compared; where two differ, that document is counted by its words themselves."""
    key = (row.astype(np.uint64) << np.uint64(HASH_BITS)) | (word_hash(data, start, end) >> np.uint64(64 - HASH_BITS))
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    out = np.bincount(row, minlength=n) - np.bincount(row[order[again]], minlength=n)
    clash = ~same_words(data, start, end, order[again - 1], order[again])
    for r in np.unique(row[order[again[clash]]]).tolist():
        own = np.flatnonzero(row == r).tolist()
        out[r] = len({data[start[k] : end[k]].tobytes() for k in own})
    return out


def scan_step(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row of a flat text buffer: words, distinct words, capitals, symbols, code points."""

    def per_row(marks: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(data) + 1, np.int64)
        np.cumsum(marks, out=upto[1:])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    start, end, row = words(data, offsets)
    return {
        "n_words": np.bincount(row, minlength=len(offsets) - 1),
        "n_distinct": distinct_words(data, start, end, row, len(offsets) - 1),
        "n_capitals": per_row(CAPITAL[data]),
        "n_symbols": per_row(SYMBOL[data]),
        "n_points": per_row(BEGINS[data]),
    }


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The filters A to D that each row fails, a bit for each."""
    marks = (
        counts["n_words"] < LEAST_WORDS,
        100 * counts["n_distinct"] < LEAST_DISTINCT * counts["n_words"],
        100 * counts["n_capitals"] > MOST_CAPITALS * counts["n_points"],
        counts["n_symbols"] > 0,
    )
    return sum(m.astype(np.int32) << k for k, m in enumerate(marks))


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask, digest) of docs(doc_id, source, text): the filters A to D that a document fails, and 16 bytes of its text's hash."""
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")

    def run(batches):
        for b in batches:
            for part, data, offsets in steps(b, "text"):
                whole = memoryview(data)
                digest = [hashlib.blake2b(whole[lo:hi], digest_size=16).digest() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(failed(scan_step(data, offsets)), pa.int32()), pa.array(digest, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return taken.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of each part that fail just these filters, and those of them whose labels say so.

    Filter E, a copy of a smaller doc_id's text, is found without gathering a text's copies: the smallest doc_id of a text is an aggregate,
    and rows meet it by text and doc_id together. A document without doc_id has no label and is a copy of nothing. Rows of one doc_id and
    one text count one by one, none a copy of the other. A doc_id with several labels is good, or toxic, if one of them says so.
    """
    counted = materialize(scan(docs).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "scanned")
    known, unknown = counted.where("doc_id IS NOT NULL"), counted.where("doc_id IS NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    whole = F.when(F.col("is_first").isNull(), F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))).otherwise(F.col("mask"))
    marked = known.join(firsts, ["digest", "doc_id"], "left").join(said, "doc_id", "left").select("part", whole.alias("mask"), "n", "good", "toxic")
    none = F.lit(None).cast("int")
    both = marked.unionByName(unknown.select("part", "mask", "n", none.alias("good"), none.alias("toxic")))
    times = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    out = materialize(both.groupBy("part", "mask").agg(F.sum("n").alias("n"), times("good"), times("toxic")), "masks")
    drop_tables(counted)
    return out


def places(spark: SparkSession) -> DataFrame:
    """What each of the 32 masks means at each step of each of the 120 orders: 19,200 rows, whatever the data. share: the orders in which a document with the mask is removed by the step's filter."""
    rows = []
    for order in permutations(FILTERS):
        for step, letter in enumerate(order):
            bit, before = 1 << FILTERS.index(letter), sum(1 << FILTERS.index(x) for x in order[:step])
            for mask in range(32):
                fails, gone = bool(mask & bit), bool(mask & before)
                rows.append(("".join(order), step + 1, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == bit), 120 // mask.bit_count() if fails else 0))
    return spark.createDataFrame(rows, "filter_order string, step int, mask int, stays int, goes int, gone int, only int, share int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 for each source of docs.

    Null texts are empty, a null source is the part "", as an empty one is. An empty table has no part and so no rows. Columns other than
    doc_id, source and text, or doc_id, quality and toxic, are not read. A text of any length is scanned whole, as one step.
    """
    found = masks(docs, labels).join(F.broadcast(places(docs.sparkSession)), "mask")

    def total(mark: str, what: str, name: str) -> Column:
        return F.sum(F.col(mark) * F.col(what)).alias(name)

    return found.groupBy("part", "filter_order", "step").agg(
        total("stays", "n", "kept"),
        total("goes", "n", "removed"),
        total("gone", "n", "redundant"),
        total("only", "n", "unique_fails"),
        total("goes", "good", "good_lost"),
        total("goes", "toxic", "toxic_lost"),
        total("share", "n", "shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
s AS (SELECT x, 1 << i AS bit FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([0, 1, 2, 3, 4]) AS i)),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.x || b.x || c.x || d.x || e.x AS filter_order FROM s a, s b, s c, s d, s e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
p AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS before FROM o, range(1, 6) t(step)),
z AS (SELECT part, filter_order, step::INT AS step, bit, sum(CASE WHEN mask & (bit | before::INT) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & before::INT > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before::INT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r, p GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM z"""
