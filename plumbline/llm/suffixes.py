"""Removal of long repeated passages by a logarithmic family of sparse suffix arrays.

A string of `least` bytes is found by the suffix that begins at its mark: the position, among the string's `key`-byte grams, with the
least hash. Equal strings have the same mark, so marked suffixes, about one position in sixteen, stand for all. They are dealt to
buckets by their first `key` bytes, and within a bucket kept in the order of those, then of what a string around the mark can hold.

An index is a folder of levels, each a table with one sorted array a bucket. A new batch of documents gets its own arrays, which are
merge-scanned against every level; then it becomes a level, and levels of the same rank are merged, two by two, so a suffix is written
again only as often as the logarithm of the number of batches. A context (all bytes around a mark that a string with it can hold) that
an earlier document has is removed whole; where contexts of one mark differ, the strings in them are compared one by one.
"""

from __future__ import annotations

import gc
import hashlib
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import drop_tables, materialize, mix, prefix_hash, shared_dir, span_hash, steps, table

LEAST, KEY = 50, 20
#: Batches in which a whole table is added, in doc_id order.
BATCHES = 4
#: Buckets for each shuffle partition, and bytes of text for each bucket: the larger number counts.
BUCKETS, BUCKET_BYTES = 2, 1 << 26
#: Text bytes whose suffixes are found and packed together.
PACK_BYTES = 1 << 19
#: Bytes of text hashed at a time, whatever a text's length.
HASHED = 1 << 20
#: Contexts that a task remembers as held by several documents, so that it passes each on once; when full, it begins again.
REMEMBERED = 200_000
#: Documents whose marks tell which are hot, and the share of them that a hot mark is in; hot marks are dealt by context.
SAMPLE, HOT = 4000, 0.02
#: Differing contexts of one mark that a task compares; those of a mark with more are dealt string by string.
CONTEXTS = 10_000
ALL = np.uint64((1 << 64) - 1)


def _slide(a: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over each run of width values."""
    have = 1
    while 2 * have <= width:
        a = take(a[:-have], a[have:])
        have *= 2
    rest = width - have
    return take(a[: len(a) - rest], a[rest:]) if rest else a


def marks(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Marks of all strings of a flat buffer that lie within a row: (position, row, hash, context start, context end, context hash)."""
    found = [_marks_of(data, offsets, lo, min(lo + HASHED, len(data)), least, key) for lo in range(0, max(len(data), 1), HASHED)]
    if len(found) == 1:
        return found[0]
    at, row, grams, lo, hi, context = (np.concatenate(c) for c in zip(*found, strict=True))
    at, first = np.unique(at, return_index=True)
    return at, row[first], grams[first], lo[first], hi[first], context[first]


def _marks_of(data: np.ndarray, offsets: np.ndarray, begin: int, stop: int, least: int, key: int) -> tuple[np.ndarray, ...]:
    """Marks of the strings that start from begin to stop; their contexts lie less than two lengths beyond."""
    base = max(0, begin - least)
    data, whole = data[base : stop + 3 * least], offsets
    offsets = np.clip(offsets - base, 0, len(data))
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    grams = _order_of(data, key)
    grams[np.arange(len(grams)) + key > end_of[: len(grams)]] = ALL
    span = least - key + 1
    mins = _slide(grams, span, np.minimum)
    own = np.arange(len(mins))
    mins = np.where((own + least <= end_of[: len(mins)]) & (own >= begin - base) & (own < stop - base), mins, np.uint64(0))
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero((_slide(np.concatenate((edge, mins, edge)), span, np.maximum) == grams) & (grams != ALL))
    row = np.searchsorted(whole, at + base, side="right") - 1
    lo, hi = np.maximum(at - (least - key), whole[row] - base), np.minimum(at + least, whole[row + 1] - base)
    prefix = prefix_hash(data)
    return at + base, row, span_hash(prefix, at, at + key), lo + base, hi + base, span_hash(prefix, lo, hi) >> np.uint64(8)


def _order_of(data: np.ndarray, key: int) -> np.ndarray:
    """A number for the key bytes from each position on, which only decides where marks are: mixed from the 8-byte words in them."""
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.zeros(len(data) - key + 1, np.uint64)
    for k, at in enumerate([*range(0, key - 8, 8), key - 8]):
        out += words[at : at + len(out)] * np.uint64(0x9E3779B97F4A7C15 + 2 * (k * 0x632BE59BD9B4E019 & 0x3FFFFFFFFFFFFFFF))
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.minimum(out, ALL - np.uint64(1))


def _planes(a: np.ndarray, n: int) -> bytes:
    """The n low bytes of 64-bit integers, byte by byte, which compresses well where they are sorted or small."""
    return a.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :n] = planes.T
    return out.view(np.uint64).ravel()


def _pair(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(mix(key) ^ context)


PACKED = "bucket int, base long, keys binary, contexts binary, owners binary, doc_id long"
TYPES = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())


def hot_marks(docs: DataFrame, least: int, key: int) -> np.ndarray:
    """Hashes of the marks in many documents of a sample of about SAMPLE. They only steer the dealing: results are the same without."""
    one_in = max(1, -(-docs.count() // SAMPLE))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")

    def run(batches):
        for b in batches:
            for _, data, offsets in steps(b, "text", PACK_BYTES):
                _, row, grams, *_ = marks(data, offsets, least, key)
                pairs = np.unique(np.stack((grams, row.astype(np.uint64))), axis=1)[0]
                found, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    counted = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > max(50, int(HOT * SAMPLE))).select("key").collect()  # bounded by the marks of the sample
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def packed_suffixes(docs: DataFrame, buckets: int, hot: np.ndarray, least: int, key: int) -> DataFrame:
    """Rows of PACKED: the marked suffixes of some documents that fall into a bucket, one owner for each context; and, in buckets below
    zero, contexts of a document that a smaller one in the same task has too, which need no look into the index."""
    def run(batches):
        many: dict[int, int] = {}  # contexts seen with several documents: the least of them
        for b in batches:
            for part, data, offsets in steps(b, "text", PACK_BYTES):
                _, row, grams, _, _, context = marks(data, offsets, least, key)
                if not len(grams):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                owner, pairs = ids[row], _pair(grams, context)
                order = np.lexsort((owner, pairs))
                grams, context, owner, pairs = grams[order], context[order], owner[order], pairs[order]
                new = np.append(True, pairs[1:] != pairs[:-1])
                first = owner[new]
                if many:
                    known = np.array(list(many), np.uint64)
                    at = np.flatnonzero(np.isin(pairs[new], known))
                    first[at] = np.minimum(first[at], [many[int(x)] for x in pairs[new][at]])
                least_owner = first[np.cumsum(new) - 1]
                later = owner > least_owner
                ends = np.append(np.flatnonzero(new)[1:], len(new)) - 1
                repeated = owner[ends] > first
                if len(many) > REMEMBERED:
                    many.clear()
                many.update(zip(pairs[new][repeated].tolist(), first[repeated].tolist(), strict=True))
                found = [(-1 - who % buckets, 0, b"", c, b"", who) for who, c in zip(*_by_owner(owner[later], context[later]), strict=True)]
                sent = new & ~later
                base = int(ids.min())
                grams, context, owner = grams[sent], context[sent], (owner[sent] - base).view(np.uint64)
                spread = np.where(np.isin(grams, hot), _pair(grams, context), grams)
                bucket = ((spread >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                low = grams & np.uint64((1 << 48) - 1)
                order = np.lexsort((low, bucket))
                low, context, owner = low[order], context[order], owner[order]
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                found += [(k, base, _planes(low[i:j], 6), _planes(context[i:j], 7), _planes(owner[i:j], 8), None) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), TYPES, strict=True)], names=["bucket", "base", "keys", "contexts", "owners", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _by_owner(owner: np.ndarray, context: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Each owner and its distinct contexts, as bytes."""
    order = np.lexsort((context, owner))
    owner, context = owner[order], context[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (context[1:] != context[:-1])
    owner, context = owner[new], context[new]
    ids, cuts = np.unique(owner, return_index=True)
    ends = np.append(cuts, len(owner))[1:]
    return ids.tolist(), [context[i:j].tobytes() for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]


def scanned(key: np.ndarray, context: np.ndarray, owner: np.ndarray, levels: list[tuple[np.ndarray, ...]], hot: np.ndarray) -> tuple[tuple, tuple, tuple]:
    """Merge-scans a batch's suffixes against levels of sorted (key, context, owner), whose owners are smaller.

    Returns (owner, context) of suffixes whose context an earlier document has; (owner, context) of those, in the batch or a level,
    whose key has several contexts; and the sorted (key, context, owner) of contexts that no level has.
    """
    order = np.lexsort((owner, context, key))
    key, context, owner = key[order], context[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    first = owner[new]
    group, k, c = np.cumsum(new) - 1, key[new], context[new]
    many = np.isin(k, hot)
    same = k[1:] == k[:-1]
    many[1:] |= same
    many[:-1] |= same
    known, several = np.zeros(len(k), bool), []
    for level_key, level_context, level_owner in levels:
        # Places of the batch's keys in the level, both in one order; a key's run of contexts is walked from its start.
        lo, hi = np.searchsorted(level_key, k, side="left"), np.searchsorted(level_key, k, side="right")
        here, equal = np.flatnonzero(hi > lo), np.zeros(len(k), bool)
        for step in range(int((hi - lo).max(initial=0)).bit_length()):  # halves each run: contexts are in order too
            mid = (lo[here] + hi[here]) >> 1
            live = lo[here] < hi[here]
            below = live & (level_context[np.minimum(mid, len(level_key) - 1)] < c[here])
            lo[here] = np.where(below, mid + 1, lo[here])
            hi[here] = np.where(live & ~below, mid, hi[here])
        at = np.minimum(lo, len(level_key) - 1) if len(level_key) else lo
        if len(level_key):
            equal = (level_key[at] == k) & (level_context[at] == c)
        first[equal] = np.minimum(first[equal], level_owner[at[equal]])
        known |= equal
        differ = np.zeros(len(k), bool)
        differ[here] = ~equal[here]
        many |= differ
        old = np.isin(level_key, k[differ])
        several.append((level_owner[old], level_context[old]))
    removed = owner > first[group]
    several.append((first[many & ~known], c[many & ~known]))
    return (owner[removed], context[removed]), tuple(np.concatenate(x) for x in zip(*several, strict=True)), (k[~known], c[~known], first[~known])


FOUND = "kind int, bucket int, doc_id long, keys binary, contexts binary, owners binary"
KNOWN, OPEN, LEVEL = range(3)


class SuffixIndex:
    """A logarithmic family of levels in a folder. levels are (path, rank), and a level of rank r holds 2^r batches; with them, the same
    buckets and hot marks, an index is opened again."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = 64, levels: list[tuple[str, int]] | None = None, hot: np.ndarray | None = None, least: int = LEAST, key: int = KEY):
        self.spark, self.folder, self.buckets, self.least, self.key = spark, folder or f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}", buckets, least, key
        self.levels, self.hot = list(levels or []), np.zeros(0, np.uint64) if hot is None else hot

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch docs(doc_id, text) whose ids are greater than all before. Returns rows (doc_id, kind, contexts): KNOWN, contexts of
        the document that an earlier one has; OPEN, contexts, of this batch or an earlier one, whose marks have others too."""
        hot, least, key, low_hot = self.hot, self.least, self.key, np.unique(self.hot & np.uint64((1 << 48) - 1))
        levels, merged, rank = list(self.levels), [], 0
        for path, r in reversed(levels):
            if r != rank:
                break
            merged.append(path)
            rank += 1

        def run(key_: tuple, t: pa.Table) -> pa.Table:
            bucket = key_[0].as_py()
            rows = []
            if bucket < 0:
                rows = [(KNOWN, bucket, who, None, c, None) for who, c in zip(t.column("doc_id").to_pylist(), t.column("contexts").to_pylist(), strict=True)]
            else:
                batch, *have = (_arrays(t.filter(pc.equal(t.column("level"), k))) for k in range(-1, len(levels)))
                known, several, fresh = scanned(*batch, have, low_hot)
                for kind, pairs in ((KNOWN, known), (OPEN, several)):
                    rows += [(kind, bucket, who, None, c, None) for who, c in zip(*_by_owner(*pairs), strict=True)]
                k, c, o = (np.concatenate(x) for x in zip(fresh, *have[len(levels) - rank :], strict=True))
                order = np.lexsort((c, k))
                rows.append((LEVEL, bucket, None, _planes(k[order], 6), _planes(c[order], 7), _planes(o[order].view(np.uint64), 8)))
            return pa.Table.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "doc_id", "keys", "contexts", "owners"])

        path = f"{self.folder}/level-{uuid.uuid4().hex}"
        packed = packed_suffixes(docs, self.buckets, hot, least, key).withColumn("level", F.lit(-1))
        for k, (old, _) in enumerate(levels):
            packed = packed.unionByName(self.arrays(old).select("bucket", F.lit(0).cast("long").alias("base"), "keys", "contexts", "owners", F.lit(None).cast("long").alias("doc_id"), F.lit(k).alias("level")))
        packed.groupBy("bucket").applyInArrow(run, FOUND).write.partitionBy("kind").parquet(path)
        self.levels = [x for x in levels if x[0] not in merged] + [(path, rank)]
        for old in merged:
            self._delete(old)
        return self.spark.read.schema(FOUND).parquet(path).where(F.col("kind") < LEVEL).select("doc_id", "kind", "contexts")

    def _delete(self, path: str) -> None:
        """Removes a level's arrays; what it found stays."""
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={LEVEL}")
        gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def drop(self) -> None:
        """Removes all levels."""
        for path, _ in self.levels:
            self._delete(path)
        self.levels = []

    def arrays(self, path: str) -> DataFrame:
        """Rows (bucket, keys, contexts, owners) of a level: one sorted array a bucket."""
        return self.spark.read.schema(FOUND).parquet(path).where(F.col("kind") == LEVEL).select("bucket", "keys", "contexts", "owners")


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, contexts and owners of packed rows."""
    if not t.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([_unplaned(x, 6) for x in t.column("keys").to_pylist()])
    contexts = np.concatenate([_unplaned(x, 7) for x in t.column("contexts").to_pylist()])
    owners = np.concatenate([_unplaned(x, 8).view(np.int64) + b for x, b in zip(t.column("owners").to_pylist(), t.column("base").to_pylist(), strict=True)])
    return keys, contexts, owners


def _runs(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Overlapping or touching intervals joined: rows (start, end) by start."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    starts = np.flatnonzero(new)
    return np.stack((lo[starts], hi[np.append(starts[1:], len(lo)) - 1]), axis=1).astype(np.int64)


def _hashed(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings of a width at ascending starts, a stretch of data at a time."""
    out, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        hi = int(np.searchsorted(start, start[lo] + HASHED, side="right"))
        base = start[lo]
        part = data[base : start[hi - 1] + width]
        out[lo:hi] = span_hash(prefix_hash(part), start[lo:hi] - base, start[lo:hi] - base + width)
        lo = hi
    return out


def apply_contexts(docs: DataFrame, found: DataFrame, least: int, key: int) -> DataFrame:
    """Rows (doc_id, version, runs, places, keys, texts): what the known contexts remove, and where and what the contexts are whose strings are to be compared."""
    lists = found.groupBy("doc_id").agg(F.collect_list(F.when(F.col("kind") == KNOWN, F.col("contexts"))).alias("known"), F.collect_list(F.when(F.col("kind") == OPEN, F.col("contexts"))).alias("open"))
    joined = docs.join(lists, "doc_id").select("doc_id", "version", "text", "known", "open")
    schema = "doc_id long, version long, runs binary, places array<long>, keys array<long>, texts array<binary>"

    def run(batches):
        for b in batches:
            for part, data, offsets in steps(b, "text", PACK_BYTES):
                at, row, grams, lo, hi, context = marks(data, offsets, least, key)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                raw, out = data.tobytes(), []
                for k, (known, opened) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    own, base = slice(cuts[k], cuts[k + 1]), int(offsets[k])
                    gone = np.isin(context[own], np.frombuffer(b"".join(known), np.uint64))
                    left = np.flatnonzero(np.isin(context[own], np.frombuffer(b"".join(opened), np.uint64)) & ~gone) + cuts[k]
                    runs = _runs(lo[own][gone] - base, hi[own][gone] - base)
                    out.append((runs.tobytes(), (lo[left] - base).tolist(), grams[left].view(np.int64).tolist(), [raw[x:y] for x, y in zip(lo[left].tolist(), hi[left].tolist(), strict=True)]))
                columns, types = list(zip(*out, strict=True)), (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "version", "runs", "places", "keys", "texts"])

    return joined.mapInArrow(run, schema)


def _strings(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All strings of some texts: (number of the text, place in it, hash)."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    n = np.maximum(np.diff(offsets) - least + 1, 0)
    row = np.repeat(np.arange(len(texts)), n)
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, shift, _hashed(np.frombuffer(b"".join(texts), np.uint8), offsets[row] + shift, least)


def _later_strings(ids: np.ndarray, versions: np.ndarray, places: np.ndarray, texts: list[bytes], least: int) -> list[tuple[int, int, bytes]]:
    """Rows (doc_id, version, runs) of the strings in some documents' texts that a smaller one of them has too."""
    row, shift, strings = _strings(texts, least)
    order = np.lexsort((ids[row], strings))
    row, shift, strings = row[order], shift[order], strings[order]
    if not len(row):
        return []
    new = np.append(True, strings[1:] != strings[:-1])
    gone = ids[row] > ids[row][np.flatnonzero(new)][np.cumsum(new) - 1]
    row, at = row[gone], places[row[gone]] + shift[gone]
    order = np.lexsort((at, versions[row], ids[row]))
    row, at = row[order], at[order]
    if not len(row):
        return []
    cuts = np.flatnonzero(np.append(True, (ids[row][1:] != ids[row][:-1]) | (versions[row][1:] != versions[row][:-1])))
    ends = np.append(cuts, len(row))[1:]
    return [(int(ids[row[i]]), int(versions[row[i]]), _runs(at[i:j], at[i:j] + least).tobytes()) for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)]


RUNS = "doc_id long, version long, runs binary"


def _runs_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "version", "runs"])


def compare_strings(applied: DataFrame, buckets: int, least: int) -> DataFrame:
    """Rows (doc_id, version, runs) of the strings in applied's contexts that a smaller document has too. Contexts of one mark are compared
    together; where a mark has over CONTEXTS, their strings are dealt one by one, so that no task has all of them."""
    each = applied.select("doc_id", "version", F.explode(F.arrays_zip("places", "keys", "texts")).alias("x"))
    opened = each.select("doc_id", "version", F.col("x.keys").alias("key"), F.col("x.places").alias("place"), F.col("x.texts").alias("text"))
    crowded = materialize(opened.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CONTEXTS).select("key"), "crowded")
    few = opened.join(crowded, "key", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("key")
        keys = t.column("key").to_numpy()
        ends, out, lo = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)), [], 0
        while lo < len(keys):  # whole marks, up to twice CONTEXTS of their contexts at a time
            hi = int(ends[min(np.searchsorted(ends, lo + CONTEXTS), len(ends) - 1)])
            part = t.slice(lo, hi - lo)
            out += _later_strings(*(part.column(c).to_numpy() for c in ("doc_id", "version", "place")), part.column("text").to_pylist(), least)
            lo = hi
        return _runs_table(out)

    def one_by_one(batches):
        for b in batches:
            row, shift, strings = _strings(b.column(3).to_pylist(), least)
            taken = [b.column(k).take(pa.array(row)) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(b.column(2).to_numpy()[row] + shift), pa.array(strings.view(np.int64))], names=["doc_id", "version", "place", "string"])

    def joined(batches):
        for b in batches:
            starts = [np.array(x, np.int64) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_runs(x, x + least).tobytes() for x in starts], pa.binary())], names=["doc_id", "version", "runs"])

    many = opened.join(crowded, "key", "left_semi").select("doc_id", "version", "place", "text").mapInArrow(one_by_one, "doc_id long, version long, place long, string long")
    first = many.groupBy("string").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("string", "first")
    gone = many.join(first, "string").where("doc_id > first").groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return few.groupBy("bucket").applyInArrow(together, RUNS).unionByName(gone.mapInArrow(joined, RUNS))


def _release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are done, which stay until the driver collects its garbage."""
    for _ in range(2):  # the driver's Python lets go of a plan first, the JVM's collector after that
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def repeated_runs(docs: DataFrame, least: int = LEAST, key: int = KEY, batches: int = BATCHES) -> DataFrame:
    """Rows (doc_id, version, runs) of documents with bytes to remove: runs lists 64-bit (start, end) pairs that may overlap between list entries; version is the xxhash64 of the text."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    size, cuts = docs.agg(F.sum(F.octet_length("text").cast("long")), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()
    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BUCKET_BYTES))
    index, found = SuffixIndex(spark, buckets=buckets, hot=hot_marks(docs, least, key), least=least, key=key), None
    edges = [None, *sorted(set(cuts or [])), None]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = docs if lo is None else docs.where(F.col("doc_id") > lo)
        new = index.add(part if hi is None else part.where(F.col("doc_id") <= hi))
        found = new if found is None else found.unionByName(new)
        _release(spark)
    index.drop()
    applied = materialize(apply_contexts(docs, found, least, key), "applied")
    _release(spark)
    runs = compare_strings(applied, buckets, least).unionByName(applied.select("doc_id", "version", "runs"))
    runs = runs.where(F.octet_length("runs") > 0).groupBy("doc_id", "version").agg(F.collect_list("runs").alias("runs"))
    runs = materialize(runs, "runs")
    drop_tables(applied)
    _release(spark)
    return runs


def without_repeats(docs: DataFrame, least: int = LEAST, key: int = KEY, value: str = "digest") -> DataFrame:
    """docs(doc_id, text) without each byte that a string of least bytes covers which also starts in a document of a smaller doc_id.

    Strings are judged on the whole input; they lie within a document. Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), or with
    value text the remaining bytes as binary kept in the digest's place. Null and empty texts have no bytes; a row without doc_id
    keeps its text; rows of one doc_id do not remove from each other. Positions count UTF-8 bytes. Other columns are ignored.
    """
    runs = repeated_runs(docs, least, key)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(runs, ["doc_id", "version"], "left").select("doc_id", "text", "runs")
    last, kind = ("kept_sha256", pa.string()) if value == "digest" else ("kept", pa.binary())

    def run(batches):
        for b in batches:
            out = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = text.encode()
                pairs = np.frombuffer(b"".join(found or []), np.int64).reshape(-1, 2)
                merged = _runs(pairs[:, 0], pairs[:, 1])
                kept, at = [], 0
                for lo, hi in merged.tolist():
                    kept.append(raw[at:lo])
                    at = hi
                kept = b"".join(kept) + raw[at:]
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest() if value == "digest" else kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return joined.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if value == 'digest' else 'binary'}")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
