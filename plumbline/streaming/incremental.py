"""Incremental passes as streams: each run takes what has arrived since the last one, some files at a time, then ends.

A pass writes to stored tables and indexes, batch by batch, and the checkpoint keeps which batches are done. A run that fails is started
again with the same checkpoint: it repeats the batch that failed, whose writes replace those of the first try, and goes on; batches that
are done are not read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.text import content_hash
from plumbline.operators.chunking import build_chunks
from plumbline.operators.embedding import Encoder, embed
from plumbline.operators.lexical_index import LexicalIndex
from plumbline.operators.symbols import SYMBOL, extract_symbols
from plumbline.sources.stored import StoredTable, exists

CHUNKS = "doc_id long, strategy string, ordinal int, chunk_id long, text string"


def process_new(spark: SparkSession, source: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], files: int | None = None) -> StreamingQuery:
    """Runs work(rows, number) on micro-batches of new Parquet files under source, of that many files each where given."""
    reader = spark.readStream.schema(schema)
    stream = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(source)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _staged(made: DataFrame, target: str) -> DataFrame:
    """What a batch has made, written below target and read back: it is worked out once, though several steps read it. The next batch writes over it."""
    path = f"{target}/staged"
    made.write.mode("overwrite").parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def chunk_table(spark: SparkSession, target: str) -> StoredTable:
    """The chunks under target, in partitions of their documents."""
    return StoredTable(spark, f"{target}/chunks", CHUNKS, ("doc_id", "strategy", "ordinal"), bucketed=("doc_id",))


def index_new_documents(spark: SparkSession, source: str, target: str, checkpoint: str, strategies: tuple[str, ...] = ("fixed",), files: int | None = None, config: str = "simple") -> StreamingQuery:
    """Chunks new or changed documents(doc_id, text), indexes the chunks, and stores them: of a document that was there the old chunks go, whatever their number.

    A batch should hold a document once. What it removes is written down before anything else, so that a repeated batch removes the same.
    """
    chunks, index = chunk_table(spark, target), LexicalIndex(spark, f"{target}/index", ("strategy",), config)

    def work(batch: DataFrame, number: int) -> None:
        docs, gone = batch.select("doc_id").distinct(), f"{target}/gone/{number:08d}"
        if not exists(spark, f"{gone}/_SUCCESS"):
            chunks.touched(docs).join(docs, "doc_id", "left_semi").select("strategy", "chunk_id").write.mode("overwrite").parquet(gone)
        made = _staged(build_chunks(batch.select("doc_id", "text"), strategies).withColumn("chunk_id", F.xxhash64("doc_id", "strategy", "ordinal")), target)
        index.add(made.select("strategy", "chunk_id", "text"), number, spark.read.schema("strategy string, chunk_id long").parquet(gone))
        chunks.replace(made, ("doc_id",), docs)

    return process_new(spark, source, "doc_id long, text string", checkpoint, work, files)


def encode_new_chunks(spark: SparkSession, source: str, target: str, checkpoint: str, encoder: Encoder, files: int | None = None) -> StreamingQuery:
    """Vectors of new chunks(chunk_id, text) merged into the table vectors(chunk_id, embedding) under target."""
    vectors = StoredTable(spark, f"{target}/vectors", "chunk_id long, embedding array<float>", ("chunk_id",))

    def work(batch: DataFrame, number: int) -> None:
        vectors.replace(_staged(embed(batch.select("chunk_id", "text"), encoder), target), ("chunk_id",))

    return process_new(spark, source, "chunk_id long, text string", checkpoint, work, files)


def extract_new_symbols(spark: SparkSession, source: str, target: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Symbols of new or changed source files(path, content) in the table symbols under target; those that a file had before go."""
    table = StoredTable(spark, f"{target}/symbols", SYMBOL, ("source_file", "seq"), bucketed=("source_file",))

    def work(batch: DataFrame, number: int) -> None:
        table.replace(_staged(extract_symbols(batch), target), ("source_file",), batch.select(F.col("path").alias("source_file")))

    return process_new(spark, source, "path string, content string", checkpoint, work, files)


def changed(new: DataFrame, old: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of new whose text is not the one that old has under the key."""
    had = old.select(F.col(key).alias("_k"), content_hash(F.col("text")).alias("_h"))
    return new.join(had, (new[key] == F.col("_k")) & (content_hash(new["text"]) == F.col("_h")), "left_anti")
