"""Token files: flat unsigned integers and 64-bit document offsets, written by ranges of documents and read through memory maps.

A folder holds, for each range of documents, tokens-N.bin (ids, little-endian, 16 bits where the vocabulary allows, else 32) and
index-N.bin (64-bit little-endian integers: the number of documents n, n + 1 offsets into the tokens, n document ids). The
manifest, one row per range, gives each range's base: the ids of all ranges before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.encoding import column_encoder, tokenizer
from plumbline.llm.shared import materialize, shared_dir, table

MANIFEST = "shard int, folder string, wide boolean, n_docs long, n_tokens long"
#: Ids that the reader hands on at a time.
READ_IDS = 1 << 21
#: UTF-8 bytes of text in a shard, about: the number of files grows with the text, and what a task holds does not.
SHARD_BYTES = 1 << 28


def write_tokens(docs: DataFrame, path: str, end_id: int, by_words: bool = False, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Encodes docs(doc_id, text) with the tokenizer file at path, appends end_id to each, and writes the files in ascending doc_id order.

    Returns the manifest (shard, folder, wide, n_docs, n_tokens, base). Null and empty texts give the end id alone. Rows of one
    doc_id stand side by side in the order of their texts; rows without doc_id come first and are written as -1. An empty table
    gives an empty manifest. Other columns are ignored. A task that runs again replaces its files by equal ones.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    wide = tokenizer(path).get_vocab_size(with_added_tokens=True) > 65536 or end_id > 65535
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        encode, kind = column_encoder(path, by_words).encode, "<u4" if wide else "<u2"
        place, at = arrow_fs.FileSystem.from_uri(folder)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        ids_of, sizes, out = [], [], None
        for b in batches:
            if out is None:
                place.create_dir(at, recursive=True)
                out = place.open_output_stream(f"{at}/.{attempt}-tokens")
            for ids, counts in encode(b, "text"):
                out.write(np.insert(ids.astype(kind), np.cumsum(counts), end_id).tobytes())
                sizes.append(counts + 1)
            ids_of.append(b.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype("<i8")
        with place.open_output_stream(f"{at}/.{attempt}-index") as index:
            index.write(np.array([len(offsets) - 1], "<i8").tobytes() + offsets.tobytes() + np.concatenate(ids_of).tobytes())
        for name in ("tokens", "index"):
            place.move(f"{at}/.{attempt}-{name}", f"{at}/{name}-{shard:06d}.bin")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "folder": [folder], "wide": [wide], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file, not per document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _part_of(place: arrow_fs.FileSystem, name: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """Reads items lo to hi of a file: through a memory map on a local disk, by ranges elsewhere."""
    if isinstance(place, arrow_fs.LocalFileSystem):
        mapped = np.memmap(name, kind, mode="r") if place.get_file_info(name).size else np.zeros(0, kind)
        return lambda lo, hi: mapped[lo:hi]
    f, width = place.open_input_file(name), np.dtype(kind).itemsize
    return lambda lo, hi: np.frombuffer(f.read_at((hi - lo) * width, lo * width), kind)


def read_tokens(manifest: DataFrame, value: str = "ids") -> DataFrame:
    """Rows (doc_id, start, n_tokens, value) from the files of a manifest; value is ids (array of ints) or crc32 (of the ids as unsigned 32-bit integers)."""
    kind = {"ids": "array<int>", "crc32": "long"}[value]
    arrow = {"ids": pa.list_(pa.int32()), "crc32": pa.int64()}[value]

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                place, at = arrow_fs.FileSystem.from_uri(row["folder"])
                tokens = _part_of(place, f"{at}/tokens-{row['shard']:06d}.bin", "<u4" if row["wide"] else "<u2")
                index = _part_of(place, f"{at}/index-{row['shard']:06d}.bin", "<i8")
                n = int(index(0, 1)[0])
                offsets, doc_ids = np.array(index(1, n + 2)), np.array(index(n + 2, 2 * n + 2))
                lo = 0
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + READ_IDS, side="right")) - 1)
                    ids = tokens(int(offsets[lo]), int(offsets[hi])).astype("<u4")
                    cuts = offsets[lo : hi + 1] - offsets[lo]
                    if value == "crc32":
                        raw = memoryview(ids.tobytes())
                        found = pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], arrow)
                    else:
                        found = pa.ListArray.from_arrays(cuts.astype(np.int32), ids.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi]), pa.array(row["base"] + offsets[lo:hi]), pa.array(np.diff(offsets[lo : hi + 1])), found], names=["doc_id", "start", "n_tokens", value])
                    lo = hi

    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(shards, "shard").mapInArrow(read, f"doc_id long, start long, n_tokens long, {value} {kind}")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(materialize(manifest, "manifest"), "crc32").withColumnRenamed("crc32", "ids_crc32")
