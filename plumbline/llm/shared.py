"""Helpers shared by the training-data operators: the shared folder, lineage cuts, components, text buffers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step handles at a time; a longer single text is a step of its own.
STEP_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


#: Rows of a file, where a table's number of rows is bounded by what is known; and the least number of files for each core.
FILE_ROWS, FILES_A_CORE = 20_000, 2


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cuts the lineage of df by a Parquet table in the shared folder. With a bound on its rows it gets no more files than they need, however
    many partitions the session sets for shuffles: many rounds of many tiny files cost more than their rows."""
    if rows is not None:
        df = df.coalesce(max(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Removes the files of tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(rows: DataFrame, small: DataFrame, on: str, how: str = "inner", limit: int = 20_000) -> DataFrame:
    """rows joined with a stored table of one row for each group: broadcast up to limit rows, counted first; beyond that Spark chooses."""
    return rows.join(F.broadcast(small) if small.count() <= limit else small, on, how)


#: Rows of whole texts in a batch between Spark and a Python worker, at most.
BATCH_ROWS = 1500


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's batches to Python workers: both sides hold several copies of a batch, and its rows are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def spare(wanted: str, taken) -> str:
    """A column name like wanted that is none of those taken, in any case."""
    taken = {c.lower() for c in taken}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a, b): rows (node, component), component the smallest reachable node.

    Alternating large-star and small-star rounds. A round relinks each edge to a minimum, so the number of edges never
    grows, whatever a component's size; each round ends in a table in the shared folder. Rows with a null end and loops
    are ignored; a node that only has loops is not returned. Repeated edges count once.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    now, mark, bound = materialize(now, name), None, None
    while True:
        n, x = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, x) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark, bound = (n, x), 2 * n
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, name, bound)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        following = materialize(small, name, bound)
        drop_tables(now, large)
        now = following


#: For DuckDB: a table of one row, the 256 remainders of the checksum that crc32 gives.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS remainders)"""


def crc32_sql(text: str) -> str:
    """For DuckDB: the unsigned crc32 of a string's UTF-8 bytes, beside the table of CRC_SQL."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, remainders[1 + (xor(a, b) & 255)]), 4294967295::BIGINT), 4294967295)"


# ---------------------------------------------------------------- texts as flat byte arrays

#: ASCII white space: space, tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A span is hashed by two polynomials modulo the prime 2^31 - 1.
PRIME = (1 << 31) - 1
BASES = (0x2F0B4C47, 0x5A1D9E63)
#: Spans up to this length are hashed by them, many at a time; longer ones one by one, by a cryptographic hash.
LONG_SPAN = 1 << 14
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def steps(batch: pa.RecordBatch, column: str | pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch of about limit text bytes: (rows, all their bytes, start offsets of the rows and the end). Null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column)) if isinstance(column, str) else column
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
        part = texts.slice(lo, hi - lo)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + hi - lo + 1]
        data = part.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield batch.slice(lo, hi - lo), data, offsets - offsets[0]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, or the prime itself for zero; x below 2^63."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return (x & np.uint64(PRIME)) + (x >> np.uint64(31))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse, modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size, both = max(n, 1 << 16), []
        for b in (base, pow(base, -1, PRIME)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate((out, _folded(out * np.uint64(pow(b, len(out), PRIME))) % np.uint64(PRIME)))
            both.append(out[:size].astype(np.uint32))
        have = _powers[base] = tuple(both)
    return have


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each base, prefix sums of (byte + 1) times the base's powers; one longer than data, which has at most 2^24 bytes."""
    if len(data) > 1 << 24:
        raise ValueError("too long for one prefix hash")
    raised, out = data.astype(np.uint64) + np.uint64(1), []
    for base in BASES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(raised * powers(len(data), base)[0][: len(data)], out=sums[1:])
        out.append(sums)
    return tuple(out)


def span_hash(prefix: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand; 62 bits of two prime moduli, and the length."""
    halves = []
    for sums, base in zip(prefix, BASES, strict=True):
        inverse = powers(len(sums), base)[1]
        half = _folded(_folded(sums[end] - sums[start]) * inverse[start])
        half[half == PRIME] = 0
        halves.append(half)
    return mix((halves[0] << np.uint64(32) | halves[1]) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the disjoint, ascending spans data[start:end]; memory beyond the result does not grow with data."""
    out = np.empty(len(start), np.uint64)
    large = end - start > LONG_SPAN
    for k in np.flatnonzero(large).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    small = np.flatnonzero(~large)
    first, last = start[small], end[small]
    lo = 0
    while lo < len(small):
        hi = max(lo + 1, int(np.searchsorted(last, first[lo] + STEP_BYTES, side="right")))
        part = data[first[lo] : last[hi - 1]]
        out[small[lo:hi]] = span_hash(prefix_hash(part), first[lo:hi] - first[lo], last[lo:hi] - first[lo])
        lo = hi
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are not white space, cut at row ends: (start, end, row) of each."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
