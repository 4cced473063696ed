"""Best-fit packing of token pieces by residual packing.

Each partition packs its own pieces best-fit, longest first, and closes nearly full bins. The pieces of all other bins are packed
best-fit again over all partitions at once: lengths are small integers, so a table of the count of each length is all that this takes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.encoding import REMEMBERED, encoder
from plumbline.llm.shared import materialize, spare, table

CAPACITY = 2048
#: Rows that a partition packs at a time.
RUN = 200_000


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin and offset, and each bin's load. Equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []  # distinct free spaces of open bins, ascending
    loads: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = len(loads), capacity
            loads.append(0)
        else:
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        bins[k], offsets[k] = b, loads[b]
        loads[b] += size
        if room > size:
            if room - size not in open_bins:
                open_bins[room - size] = []
                insort(rooms, room - size)
            open_bins[room - size].append(b)
    return bins, offsets, np.array(loads, np.int64)


Batches = Iterator[pa.RecordBatch]


def _cutter(path: str, end_id: int, capacity: int, by_words: bool, value: str, remembered: int) -> tuple[Callable[[Batches], Batches], str]:
    """What makes batches of pieces() from batches (doc_id, text), and their schema."""
    kind, arrow = {"ids": ("binary", pa.binary()), "crc32": ("long", pa.int64())}[value]

    def run(batches):
        encode, end = encoder(path, by_words, remembered).encode, np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for lo in range(0, len(doc_ids), 512):
                out: list[tuple] = []
                for doc_id, text in zip(doc_ids[lo : lo + 512], b.column(1).slice(lo, 512).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(part) // 4, part if value == "ids" else zlib.crc32(part)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), arrow), strict=True)], names=["doc_id", "piece", "start", "length", value])

    return run, f"doc_id long, piece int, start long, length long, {value} {kind}"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, by_words: bool = True, value: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """Rows (doc_id, piece, start, length, value) of docs(doc_id, text): each whole text's ids and end_id in pieces of capacity, the last shorter.

    value is ids (binary, little-endian unsigned 32-bit) or crc32 of them. Null and empty texts give the end id alone. remembered:
    the distinct words whose ids a worker keeps; fewer take less memory and more time.
    """
    return _texts(docs).mapInArrow(*_cutter(path, end_id, capacity, by_words, value, remembered))


def pack_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, by_words: bool = True, value: str = "ids", remembered: int = REMEMBERED) -> DataFrame:
    """pack() of pieces(). Both are done by one Python worker of a task: as two steps of Spark, they take two, which stay as long as their executor's others do."""
    make, schema = _cutter(path, end_id, capacity, by_words, value, remembered)
    return _pack(_texts(docs), make, StructType.fromDDL(schema), capacity)


def best_fit_counts(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing of counts[size] items of each size, in runs: rows (size, first item, first bin, items a bin, offset).

    Item k of a size is in the last run whose first item is not above k; the run's bins take its items in turn, items a bin
    each. A run takes up a bin's room to less than the size, so a bin is in a run for every halving of its room at most, and the
    number of runs depends on the number of sizes alone.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # by free space: ranges (first, number) of bins
    rooms: list[int] = []
    out, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((first, n))

    for size in sorted(counts, reverse=True):
        item, left = 0, counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, first, n = capacity, made, -(-left // (capacity // size))
                made += n
            else:
                room = rooms[at]
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            each = room // size
            taken = min(left, n * each)
            full, rest = divmod(taken, each)
            out.append((size, item, first, each, capacity - room))
            put(room, first + full + (rest > 0), n - full - (rest > 0))
            put(room - each * size, first, full)
            put(room - rest * size, first + full, int(rest > 0))
            item, left = item + taken, left - taken
    return np.array(out, np.int64).reshape(-1, 5)


def _occurrence(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each value how many equal ones come before it; before has those of earlier calls, and is added to."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.searchsorted(ordered, ordered)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - first + before[ordered]
    before += np.bincount(values, minlength=len(before))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to items(length, ...): each item's bin and its place there, without gaps, as few bins as best fit finds.

    slack: the free space up to which a partition closes its bins (1/256 of the capacity); the items of every other bin are packed
    over all partitions. Lengths must be from 1 to capacity; a null or other length raises an error in its task. Items are written to
    the shared folder once; other columns stay, those named sequence_id or offset are replaced. The driver holds one count for each
    length; the items of one length are numbered by partition, so no task takes all of them.
    """
    items = items.drop("sequence_id", "offset")
    return _pack(items, lambda batches: batches, items.schema, capacity, slack)


def _pack(rows_: DataFrame, make: Callable[[Batches], Batches], items: StructType, capacity: int, slack: int | None = None) -> DataFrame:
    """pack() of the items that make gives for batches of rows_."""
    slack = capacity // 256 if slack is None else slack
    names = items.names
    bin_, turn_, part_, of_, length_, n_, base_ = (spare(c, names) for c in ("_bin", "_turn", "_part", "_of", "_length", "_n", "_base"))
    schema = StructType(list(items)).add(bin_, "long").add("offset", "long").add(turn_, "long").add(part_, "integer")
    at = names.index("length")

    def local(batches):
        part, made, before = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64)
        held, rows = [], 0

        def flush():
            nonlocal made, held, rows
            whole = pa.Table.from_batches(held).combine_chunks()
            sizes = whole.column(at).to_numpy().astype(np.int64) if whole.num_rows else np.zeros(0, np.int64)
            if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
                raise ValueError("an item's length is not from 1 to the capacity")
            bins, offsets, loads = best_fit(sizes, capacity)
            ids = (part << 32) + made + bins
            made += len(loads)
            left = np.flatnonzero((capacity - loads > slack)[bins])
            turns = np.full(len(sizes), -1, np.int64)
            turns[left] = _occurrence(sizes[left], before)
            held, rows = [], 0
            for name, column in ((bin_, ids), ("offset", offsets), (turn_, turns), (part_, np.full(len(bins), part, np.int32))):
                whole = whole.append_column(name, pa.array(column))
            return whole.to_batches(max_chunksize=10_000)

        for b in make(batches):
            held.append(b)
            rows += b.num_rows
            if rows >= RUN:
                yield from flush()
        if held:
            yield from flush()

    packed = materialize(rows_.mapInArrow(local, schema), "packed")
    left = packed.where(F.col(turn_) >= 0).groupBy(part_, F.col("length").cast("long").alias(length_)).agg(F.count("*").alias(n_))
    counts = materialize(left, "packed-counts")  # one row per partition and length
    before = Window.partitionBy(length_).orderBy(part_).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(part_).alias(of_), length_, F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(base_))
    runs = best_fit_counts({r[0]: r[1] for r in counts.groupBy(length_).agg(F.sum(n_)).collect()}, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    joined = packed.join(bases, (packed[part_] == bases[of_]) & (packed["length"] == bases[length_]), "left")
    numbered = joined.select(*(packed[c] for c in names), bin_, "offset", F.when(F.col(turn_) >= 0, F.col(base_) + F.col(turn_)).otherwise(-1).alias(turn_))

    def placed(batches):
        size, first, start, each, offset = runs.T
        keys = (size << 44) + first
        for b in batches:
            n = len(names)
            ids, offsets, turns = (b.column(n + k).to_numpy().copy() for k in range(3))
            left = np.flatnonzero(turns >= 0)
            if len(left):
                lengths = b.column(at).to_numpy()[left].astype(np.int64)
                run = np.searchsorted(keys, (lengths << 44) + turns[left], side="right") - 1
                k = turns[left] - first[run]
                ids[left] = (1 << 62) + start[run] + k // each[run]
                offsets[left] = offset[run] + k % each[run] * lengths
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(ids), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return numbered.mapInArrow(placed, StructType(list(items)).add("sequence_id", "long").add("offset", "long"))


def packed_documents(docs: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """The contract's digest of docs(doc_id, text), packed."""
    import public_tokenizers

    packed = pack_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, value="crc32", remembered=remembered)
    return packed.withColumnRenamed("crc32", "ids_crc32").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
