"""Tables kept as Parquet: keyed upserts, replacement by key, latest rows, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows after the upsert, with change: inserted, updated or kept. A new row replaces the old one whole, nulls included."""
    had = old.select(*keys).withColumn("_old", F.lit(True))
    fresh = new.join(had, keys, "left").withColumn("change", F.when(F.col("_old"), "updated").otherwise("inserted")).drop("_old")
    rest = old.join(new.select(*keys), keys, "left_anti").withColumn("change", F.lit("kept"))
    return rest.unionByName(fresh)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of any key that new has, and all of new: delete, then insert."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def delete_by_key(table: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(keys_of.select(*keys).distinct(), keys, "left_anti")


def latest(df: DataFrame, value: str, *order: str) -> DataFrame:
    """One row: the value of the row that is last by order."""
    return df.agg(F.max_by(value, F.struct(*order)).alias(value))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(key), key, "left_anti")


def ordered_texts(chunks: DataFrame, strategy: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, texts): the texts of each document's chunks of a strategy, in order."""
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "text")))
    return chunks.where(F.col("strategy") == strategy).groupBy(key).agg(F.transform(listed, lambda x: x["text"]).alias("texts"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def health(documents: DataFrame, chunks: DataFrame, symbols: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row (documents, chunks, embedded, symbols, ok)."""
    one = documents.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks"), F.count(embedding).alias("embedded"))).crossJoin(symbols.agg(F.count("*").alias("symbols")))
    return one.withColumn("ok", F.col("embedded") > 0)
