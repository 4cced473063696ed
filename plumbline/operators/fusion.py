"""Ranked lists: ranks, top k, reciprocal rank fusion, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; Spark limits each partition before the shuffle."""
    return ranked(df, keys, *order).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, limit: int | None = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, query_id, chunk_id, score, ranks, rank) of lists(*by, query_id, source, rank, chunk_id), best first; ties to the smaller chunk_id."""
    if k <= 0:
        raise ValueError("k must be positive")
    fused = lists.groupBy(*by, "query_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.col("rank").cast("int"))))).alias("ranks"),
    )
    out = ranked(fused, [*by, "query_id"], F.desc("score"), F.asc("chunk_id"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def fit_budget(spans: DataFrame, budget: int) -> DataFrame:
    """Of spans(query_id, rank, cost, ...), best first, those that still fit the budget; one that does not fit is skipped, not the end."""
    item = "struct<rank:int,cost:bigint>"
    listed = spans.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int"), F.col("cost").cast("bigint")))).cast(f"array<{item}>").alias("items"))
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).cast("bigint").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, F.array_append(acc["kept"], x["rank"])).otherwise(acc["kept"]).alias("kept"), (acc["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"))

    kept = listed.select("query_id", F.explode(F.aggregate("items", start, step, lambda acc: acc["kept"])).alias("rank"))
    return spans.join(kept, ["query_id", "rank"])
